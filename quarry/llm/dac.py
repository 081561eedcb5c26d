"""Token-id files of directly addressable codes.

An id is split into chunks of CHUNK_BITS bits. Level k holds the k-th chunk of every id that has
one, a bitmap that says which of them continue on level k + 1, and a rank directory (ones before
each block of the bitmap), so id i is reached by one rank per level and no block is ever decoded.

Documents are dealt to ranges of their key by Spark's sampled range partitioning, which splits equal keys
by a row number, sorted, encoded with an end id appended, and
written as shards of DOCS_PER_SHARD documents or SHARD_IDS ids below spark.checkpoint.dir; each file is renamed into place whole,
so a lost or repeated task does no harm. A manifest row per file gives its counts; ids of all earlier
documents are summed over ranges in two levels, the upper one of RANGES / 64 rows.

With added=True a text that holds the content of an added token of the file (<|endoftext|>) is encoded by
the tokenizers library with its defaults, which give that token's id; else it is spelled out.

Null text counts as empty (the end id alone). Null keys sort first. Repeated rows are separate
documents. An empty table writes no file and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import filesystem, no_collections, publish, work_dir
from .packing import added_tokens

CHUNK_BITS = 8
#: Bits of a bitmap between two entries of its rank directory.
RANK_BLOCK = 512
#: Documents and, but for a longer document, ids of a file, and key ranges that documents are dealt to, at most; a range can fill many files.
DOCS_PER_SHARD, SHARD_IDS, RANGES = 4096, 16 << 20, 50_000
#: Bytes of white-space words and of pieces of them, as they are held, that a worker keeps before it starts that memo afresh.
WORD_BYTES, PIECE_BYTES = 192 << 20, 128 << 20
#: Bytes that an entry takes besides its characters (up to four bytes each) and ids.
ENTRY_BYTES = 200
MAGIC = b"QDAC0001"


# the codes


class Codes:
    """Random access to ids: levels are (chunks, bitmap bytes or None, ones before each block)."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def build(cls, ids: np.ndarray) -> Codes:
        rest, levels = np.asarray(ids, dtype=np.uint64), []
        while True:
            more = rest >> np.uint64(CHUNK_BITS)
            goes_on = more > 0
            bits = np.packbits(goes_on, bitorder="little")
            block = RANK_BLOCK // 8
            padded = np.zeros(-(-max(1, len(bits)) // block) * block, dtype=np.uint8)
            padded[: len(bits)] = bits
            ones = np.bitwise_count(padded.reshape(-1, block)).sum(axis=1, dtype=np.uint64)
            levels.append(((rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), padded, np.concatenate([[0], ones.cumsum()[:-1]]).astype(np.uint64)))
            rest = more[goes_on]
            if not len(rest):
                return cls(len(ids), levels)

    def rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before position i."""
        _, bits, before = self.levels[level]
        block = min(i // RANK_BLOCK, len(before) - 1)
        start, end = block * RANK_BLOCK // 8, i // 8
        n = int(before[block]) + int(np.bitwise_count(bits[start:end]).sum())
        return n + (int(bits[end]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << CHUNK_BITS * level
            if not bits[i // 8] >> i % 8 & 1:
                return value
            i, level = self.rank(level, i), level + 1

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end: one rank per level finds where the range begins on the next."""
        out = np.zeros(end - start, dtype=np.uint64)
        where = np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunks[start:end].astype(np.uint64) << np.uint64(CHUNK_BITS * level)
            first = start // 8
            on = np.unpackbits(bits[first : -(-end // 8)], bitorder="little")[start - first * 8 : end - first * 8].astype(bool)
            next_start = self.rank(level, start)
            where, start, end = where[on], next_start, next_start + int(on.sum())
        return out

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QI", self.n, len(self.levels))]
        for chunks, bits, before in self.levels:
            out += [struct.pack("<QQQ", len(chunks), len(bits), len(before)), chunks.tobytes(), bits.tobytes(), before.astype("<u8").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: memoryview) -> Codes:
        n, count = struct.unpack_from("<QI", data)
        at, levels = 12, []
        for _ in range(count):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            level = []
            for size, kind in zip(sizes, ("u1", "u1", "<u8"), strict=True):
                level.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
                at += level[-1].nbytes
            levels.append(tuple(level))
        return cls(n, levels)


def write_shard(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A shard's file: magic, documents, keys, their validity, ends of documents, codes."""
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    valid = np.array([k is not None for k in keys], dtype=np.uint8)
    values = np.array([k or 0 for k in keys], dtype="<i8")
    return MAGIC + struct.pack("<Q", len(keys)) + values.tobytes() + valid.tobytes() + ends.tobytes() + Codes.build(np.concatenate(ids)).to_bytes()


class Shard:
    """A shard's file, opened: keys, ends and random access to every id of every document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        (n,) = struct.unpack_from("<Q", data, 8)
        values, valid = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "u1", n, 16 + 8 * n)
        self.keys = [int(k) if v else None for k, v in zip(values, valid, strict=True)]
        self.ends = np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)
        self.codes = Codes.from_bytes(memoryview(data)[16 + 17 * n :])

    def document(self, k: int) -> np.ndarray:
        return self.codes.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# the tokens


class WordIds:
    """Ids of a word-level BPE tokenizer by way of a bounded memo of white-space words.

    The file's normaliser (NFC, spaces folded, lower case) and its pattern never join characters
    across white space, so a word's ids do not depend on its neighbours. Texts for which that
    does not hold plainly go through the tokenizer whole.
    """

    #: Of the pattern in the tokenizer's file; fixed values.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, definition: str, added: bool = False):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not added
        self.added = added_tokens(definition) if added else lambda text: None
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.find = regex.compile(self.PATTERN).findall
        self.odd = regex.compile(r"[\x1c-\x1fΣ]").search
        self.cuts = self.PATTERN in definition.replace("\\\\", "\\") and '"Lowercase"' in definition and '"NFC"' in definition
        self.model, self.code = self.tokenizer.model, "H" if self.width == "<u2" else "I"
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.word_bytes = self.piece_bytes = 0

    def piece(self, piece: str) -> bytes:
        """Ids of a normalised piece: the model alone, on the characters that stand for its bytes."""
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(self.shown.__getitem__, piece.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def word(self, word: str) -> bytes:
        out, pieces = [], self.pieces
        # one run of ASCII letters is one piece; the pattern decides about all else
        for p in (word,) if word.isascii() and word.isalpha() else self.find(word):
            if (got := pieces.get(p)) is None:
                pieces[p] = got = self.piece(p)
                self.piece_bytes += ENTRY_BYTES + len(p) * (1 if p.isascii() else 4) + len(got)
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids in little-endian bytes, two or four each."""
        if not self.cuts or self.added(text):
            return self.whole(text)
        lower = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        if not lower.isascii() and (self.odd(text) or not unicodedata.is_normalized("NFC", lower)) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        memo, parts = self.words, lower.split()
        if self.word_bytes > WORD_BYTES:
            memo.clear()
            self.word_bytes = 0
        if self.piece_bytes > PIECE_BYTES:
            self.pieces.clear()
            self.piece_bytes = 0
        for w in {*parts}.difference(memo):
            memo[w] = got = self.word(w)
            self.word_bytes += ENTRY_BYTES + len(w) * (1 if w.isascii() else 4) + len(got)
        return b"".join(map(memo.__getitem__, parts))


_coder: tuple[object, WordIds] | None = None


def _worker_coder(shared) -> WordIds:
    global _coder
    if _coder is None or _coder[0] != shared.value:
        _coder = (shared.value, WordIds(*shared.value))
    return _coder[1]


# the operator


MANIFEST = "shard int, part int, path string, n_docs bigint, n_ids bigint"


def write(df: DataFrame, vocabulary: str, folder: str, end: int = 1, docs_per_shard: int = DOCS_PER_SHARD, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Writes the files; returns the manifest: shard, part, path, n_docs, n_ids, and start, the ids of all files before."""
    spark = df.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast((f.read(), added))
    width = "<u2" if Tokenizer.from_str(shared.value[0]).get_vocab_size() <= 1 << 16 else "<u4"
    n = df.select(key).count()
    ranges = max(1, min(RANGES, -(-n // docs_per_shard)))
    # rows of one key are told apart by their number, so they fill as many ranges as they need
    numbered = df.select(key, text).withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(ranges, key, "_row").sortWithinPartitions(key, "_row").drop("_row")

    def store(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        coder, tail = _worker_coder(shared), np.array([end], dtype=width).tobytes()
        shard, part, held, keys, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def close():
            path = f"{root}/ids-{shard:05d}-{part:06d}.dac"
            publish(fs, path, write_shard(keys, ids))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(keys)], "n_ids": [sum(map(len, ids))]})
            keys.clear()
            ids.clear()
            return row

        for batch in batches:
            with no_collections():
                made = [np.frombuffer(coder.encode(t.as_py() or "") + tail, dtype=width) for t in batch.column(text)]
            for k, x in zip(batch.column(key).to_pylist(), made, strict=True):
                keys.append(k)
                ids.append(x)
                held += len(x)
                if len(keys) >= docs_per_shard or held >= SHARD_IDS:
                    yield close()
                    part, held = part + 1, 0
        if keys:
            yield close()

    manifest_path = f"{folder}/manifest"
    dealt.mapInArrow(store, MANIFEST).write.parquet(manifest_path)
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path).withColumn("block", F.expr("shard div 64"))
    blocks = manifest.groupBy("block").agg(F.sum("n_ids").alias("in_block"))
    blocks = blocks.select("block", (F.sum("in_block").over(Window.orderBy("block")) - F.col("in_block")).alias("before_block"))
    inside = F.sum("n_ids").over(Window.partitionBy("block").orderBy("shard", "part")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(blocks, "block").select("shard", "part", "path", "n_docs", "n_ids", (F.col("inside") + F.col("before_block")).alias("start"))


def read(manifest: DataFrame, key: str = "doc_id", files_per_task: int = 1) -> DataFrame:
    """Reads the files back: key, start, n_tokens, ids_crc32 of each document, all long."""
    spark = manifest.sparkSession

    def load(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    shard = Shard(f.read())
                begins = np.concatenate([[0], shard.ends[:-1]])
                sums = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(len(shard.keys))]
                columns = [pa.array(shard.keys, pa.int64()), pa.array(begins + start), pa.array(shard.ends - begins), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32"])

    tasks = max(1, min(10_000, manifest.count() // files_per_task))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(load, f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(df: DataFrame, vocabulary: str, end: int = 1, docs_per_shard: int = DOCS_PER_SHARD, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    return read(write(df, vocabulary, work_dir(df.sparkSession, "token-ids"), end, docs_per_shard, key, text, added), key)
