"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a whole pre-token that is itself a
vocabulary entry resolves with one hash, one displacement and one comparison. Tier two merges the
bytes of any other pre-token over a doubly linked list, taking the lowest rank (leftmost first) from
a heap; stale heap entries are recognised when popped.

Texts are cut at single spaces between non-space characters before the pattern is applied, because
no pre-token crosses such a cut; results of chunks and pre-tokens are memoised per worker in
tables of bounded bytes. Texts in which spaces touch other white space take the pattern over the whole text.

Null text counts as empty: no ids, and the digests of zero bytes. Every row yields one row, repeats
included; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import arrow_rows, no_collections, schema_of

#: Bytes of chunks and of pre-tokens, as they are held, that a worker keeps before it starts that memo afresh.
CHUNK_BYTES, PIECE_BYTES = 224 << 20, 224 << 20
#: Bytes that an entry takes besides its characters (up to four bytes each) and ids.
ENTRY_BYTES, ID_BYTES = 200, 8


class PerfectHash:
    """Hash-and-displace over a fixed key set: n keys, n slots, n / 2 displacements.

    A displacement d >= 0 picks slot (a + d * b) mod n from two parts of the key's hash; a negative
    one names the slot itself, which suits buckets of one key.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.seed = 0
        while not self._build(keys, n):
            self.seed += 1

    def _build(self, keys: list[bytes], n: int) -> bool:
        self.buckets = n // 2 + 1
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key, self.seed)
            groups[h % self.buckets].append((h, i))
        self.slots, self.displace = [-1] * n, [0] * self.buckets
        free = n - 1
        for g in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            members = groups[g]
            if len(members) > 1:
                for d in range(1 << 20):
                    at = [self._slot(h, d) for h, _ in members]
                    if len(set(at)) == len(at) and all(self.slots[s] < 0 for s in at):
                        break
                else:
                    return False
                self.displace[g] = d
                for s, (_, i) in zip(at, members, strict=True):
                    self.slots[s] = i
            elif members:
                while self.slots[free] >= 0:
                    free -= 1
                self.displace[g], self.slots[free] = -free - 1, members[0][1]
        return True

    def _slot(self, h: int, d: int) -> int:
        return -d - 1 if d < 0 else ((h >> 16) + d * ((h >> 40) | 1)) % self.n

    def index(self, key: bytes) -> int:
        """The only entry that key can be; the caller compares the entry's own bytes."""
        h = xxhash.xxh64_intdigest(key, self.seed)
        return self.slots[self._slot(h, self.displace[h % self.buckets])]


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens in order of rank from lines of base64 and rank."""
    pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, data.splitlines()) if t)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class ByteBPE:
    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.tokens, self.table = tokens, table or PerfectHash(tokens)
        self.find = regex.compile(pattern).findall
        self.uneven = re.compile(r" \s|[^\S ] ").search
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = [rank[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                left, right = rank.get(t[:k]), rank.get(t[k:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = i
        self.decimals = [str(i) for i in range(len(tokens))]
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunk_bytes = self.piece_bytes = 0

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        raw = text.encode("utf-8", "surrogatepass")
        i = self.table.index(raw)
        return (i,) if self.tokens[i] == raw else self.merge(raw)

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals, over linked bytes."""
        pairs, ids, n = self.pairs.get, list(map(self.byte_ids.__getitem__, raw)), len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [pairs(a << 20 | b) for a, b in pairwise(ids)]  # the rank that the pair at k has now
        due.append(None)
        heap = [r << 32 | k for k, r in enumerate(due) if r is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            k, rank = top & 0xFFFFFFFF, top >> 32
            if due[k] != rank:
                continue
            ids[k], gone = rank, after[k]
            due[gone] = None
            after[k] = j = after[gone]
            if j < n:
                before[j] = k
                due[k] = r = pairs(rank << 20 | ids[j])
                if r is not None:
                    heappush(heap, r << 32 | k)
            else:
                due[k] = None
            if (i := before[k]) >= 0:
                due[i] = r = pairs(ids[i] << 20 | rank)
                if r is not None:
                    heappush(heap, r << 32 | i)
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = after[k]
        return tuple(out)

    def chunk(self, text: str) -> tuple[int, ...]:
        pieces, out = self.pieces, []
        for p in self.find(text):
            if (got := pieces.get(p)) is None:
                got = self.piece(p)
                self.piece_bytes += ENTRY_BYTES + len(p) * (1 if p.isascii() else 4) + ID_BYTES * len(got)
                if self.piece_bytes > PIECE_BYTES:
                    pieces.clear()
                    self.piece_bytes = 0
                pieces[p] = got
            out.append(got)
        return out[0] if len(out) == 1 else tuple(chain.from_iterable(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if text[0].isspace() or text[-1].isspace() or self.uneven(text):
            return list(self.chunk(text))
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else None
        if parts is None:
            return list(self.chunk(text))
        memo = self.chunks
        if self.chunk_bytes > CHUNK_BYTES:
            memo.clear()
            self.chunk_bytes = 0
        for p in {*parts}.difference(memo):
            memo[p] = got = self.chunk(p)
            self.chunk_bytes += ENTRY_BYTES + len(p) * (1 if p.isascii() else 4) + ID_BYTES * len(got)
        return list(chain.from_iterable(map(memo.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listing(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids))


_coder: tuple[object, ByteBPE] | None = None


def _worker_coder(shared) -> ByteBPE:
    """One coder per Python worker and vocabulary."""
    global _coder
    key, tokens, pattern, table = shared.value
    if _coder is None or _coder[0] != key:
        _coder = (key, ByteBPE(tokens, pattern, table))
    return _coder[1]


def _shared(df: DataFrame, vocabulary: str, pattern: str):
    with open(vocabulary, "rb") as f:
        data = f.read()
    tokens = read_ranks(data)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(data + pattern.encode()).hexdigest(), tokens, pattern, PerfectHash(tokens)))


def encode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) of each row's whole text. The vocabulary file fixes what is broadcast."""
    shared = _shared(df, vocabulary, pattern)

    def run(batches):
        coder = _worker_coder(shared)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column(text).to_pylist()]
            yield arrow_rows(batch, [key], {"ids": (ids, pa.list_(pa.int32()))})

    return df.select(key, text).mapInArrow(run, schema_of(df, [key], "ids array<int>"))


def decode(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, data (binary) of each row's ids; null ids give zero bytes."""
    shared = _shared(df, vocabulary, pattern)

    def run(batches):
        coder = _worker_coder(shared)
        for batch in batches:
            data = [coder.decode(i or []) for i in batch.column(ids).to_pylist()]
            yield arrow_rows(batch, [key], {"data": (data, pa.binary())})

    return df.select(key, ids).mapInArrow(run, schema_of(df, [key], "data binary"))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each whole text, decodes its ids, and returns counts and digests instead of both.

    Columns: key, n_tokens long, ids_sha256 (of the decimal ids joined by a space), decoded_sha256
    (of the decoded bytes). No shuffle: ids of one document at a time are in memory.
    """
    shared = _shared(df, vocabulary, pattern)

    def run(batches):
        coder, sha = _worker_coder(shared), hashlib.sha256
        for batch in batches:
            count, listed, decoded = [], [], []
            with no_collections():
                for t in batch.column(text):
                    ids = coder.encode(t.as_py() or "")
                    count.append(len(ids))
                    listed.append(sha(coder.listing(ids).encode()).hexdigest())
                    decoded.append(sha(coder.decode(ids)).hexdigest())
            yield arrow_rows(batch, [key], {"n_tokens": (count, pa.int64()), "ids_sha256": (listed, pa.string()), "decoded_sha256": (decoded, pa.string())})

    return df.select(key, text).mapInArrow(run, schema_of(df, [key], "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
