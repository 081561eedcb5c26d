"""Cost-balanced packing of token streams into sequences of bounded length.

Every document becomes its token ids and an end id. Whole capacities are cut off the front of long
documents and fill sequences of their own; what remains of each document is an item of less than
one capacity. A group of items (about GROUP_TOKENS tokens of one task, so memory is bounded) opens
as many full-capacity sequences as its tokens fill, and powers of two for the rest, which training
need not pad. Items go in descending order of estimated attention cost, linear plus quadratic in
length, to the sequence of lowest cost that still has room; an item that fits nowhere is cut over
the sequences of lowest cost, so that no token is lost and no sequence is padded.

Groups never cross tasks, so the operator needs no shuffle, and a repeated task repeats its result.
With added=True a text that holds the content of an added token of the file (<|endoftext|>) is encoded by
the tokenizers library with its defaults, which give that token's id; else it is spelled out.

Null text counts as empty: its document is the end id alone. Repeated rows are separate documents;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import schema_of

CAPACITY = 1024
#: Tokens that a task gathers before it packs them.
GROUP_TOKENS = 2_000_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Sequence ids of a task start at its number shifted by so many bits.
TASK_BITS = 33


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file in the tokenizers library's JSON form.

    The ids must follow the order of the merges, as ranks do; otherwise ValueError.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    if ids != sorted(ids):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t) and i < 256 + len(pairs)}


def added_tokens(definition: str) -> Callable[[str], object]:
    """Tells texts that may hold an added token of the file; any may where a token meets the normalised text."""
    added = json.loads(definition).get("added_tokens") or []
    if any(t["normalized"] for t in added):
        return lambda text: True
    return re.compile("|".join(re.escape(t["content"]) for t in added)).search if added else lambda text: None


class Tokens:
    def __init__(self, ranks: dict[bytes, int], pattern: str, definition: str | None = None):
        self.coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_str(definition) if definition else None
        self.added = added_tokens(definition) if definition else lambda text: None

    def encode(self, text: str, end: int) -> np.ndarray:
        if self.added(text):
            return np.array([*self.library.encode(text, add_special_tokens=False).ids, end], dtype=np.uint32)
        ids = self.coder.encode_to_numpy(text, disallowed_special=())
        return np.append(ids.astype(np.uint32, copy=False), np.uint32(end))


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, capacity: int) -> list[int]:
    """Full sequences, then the binary parts of what is left; their sum is total."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for items shorter than capacity; sequences count from 0."""
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    size, load, pieces, late = room.copy(), np.zeros(len(room)), [], []

    def put(item: int, start: int, n: int, s: int) -> None:
        pieces.append((item, start, n, s, int(size[s] - room[s])))
        room[s] -= n
        load[s] += cost(n)

    for item in sorted(range(len(lengths)), key=lambda i: (-cost(lengths[i]), i)):
        n = lengths[item]
        fits = np.where(room >= n, load, np.inf)
        s = int(fits.argmin())
        if fits[s] < np.inf:
            put(item, 0, n, s)
        else:
            late.append(item)
    for item in late:
        start, n = 0, lengths[item]
        while start < n:
            s = int(np.where(room > 0, load, np.inf).argmin())
            take = min(int(room[s]), n - start)
            put(item, start, take, s)
            start += take
    return pieces


def pack_group(ids: list[np.ndarray], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for whole documents of any length."""
    whole = [(d, k * capacity, capacity) for d, x in enumerate(ids) for k in range(len(x) // capacity)]
    out = [(d, start, n, s, 0) for s, (d, start, n) in enumerate(whole)]
    rest = [(d, len(x) % capacity) for d, x in enumerate(ids) if len(x) % capacity]
    for item, start, n, s, offset in assign([n for _, n in rest], capacity):
        d, length = rest[item]
        out.append((d, len(ids[d]) - length + start, n, len(whole) + s, offset))
    return out


_coder: tuple[object, Tokens] | None = None


def fingerprint(path: str, *more: object) -> str:
    """Names a vocabulary by its bytes and what else decides about ids."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + repr(more).encode()).hexdigest()


def _worker_coder(shared) -> Tokens:
    """One coder per Python worker and vocabulary."""
    global _coder
    key, ranks, pattern, definition = shared.value
    if _coder is None or _coder[0] != key:
        _coder = (key, Tokens(ranks, pattern, definition))
    return _coder[1]


def pack(df: DataFrame, vocabulary: str, pattern: str, end: int = 0, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, key: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long).

    A sequence's length is capacity, or a power of two below it.
    """
    definition = None
    if added:
        with open(vocabulary, encoding="utf-8") as f:
            definition = f.read()
    shared = df.sparkSession.sparkContext.broadcast((fingerprint(vocabulary, pattern, added), read_vocabulary(vocabulary), pattern, definition))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        coder, first = _worker_coder(shared), TaskContext.get().partitionId() << TASK_BITS
        keys, ids, held = [], [], 0

        def flush():
            nonlocal first, held
            pieces = pack_group(ids, capacity)
            rows = [(s, n, zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()), len(ids[d]), first + q, o) for d, s, n, q, o in pieces]
            first += 1 + max(q for *_, q, _ in pieces)
            arrays = [pa.array([keys[p[0]] for p in pieces], type=kind)] + [pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)]
            keys.clear()
            ids.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=[key, *names])

        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            for k, t in zip(batch.column(key), batch.column(text), strict=True):
                keys.append(k.as_py())
                ids.append(coder.encode(t.as_py() or "", end))
                held += len(ids[-1])
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    return df.select(key, text).mapInArrow(run, schema_of(df, [key], ", ".join(f"{n} bigint" for n in names)))
