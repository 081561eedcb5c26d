"""Hashed word shingles of whole texts, straight from Arrow buffers.

Words are runs of bytes other than space and 0x09 to 0x0D, A-Z in lower case. A word's hash is a
polynomial over random values of its bytes, taken for all words of a block at once from running sums;
a shingle's hash mixes those of its words. Hashes have 64 bits: two of a million different shingles
meet with a chance of about one in forty million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end, and the number of words before each text's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = ends[(ends > 0) & (ends < n)]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    return mix((total[stop] - total[start]) * down[start]), np.searchsorted(start, ends)


def text_blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of consecutive texts, and where each ends among them; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
        to = min(max(at + 1, to), len(column))
        yield data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than width is one shingle."""
    step = np.uint64(_STEP)
    for data, ends in text_blocks(column):
        words, until = word_hashes(data, ends)
        if len(words) >= width:
            h = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                h = h * step + words[k : len(words) - width + 1 + k]
            h = mix(h)
        begin = 0
        for end in until.tolist():
            n = end - begin
            if n >= width:
                yield np.unique(h[begin : end - width + 1])
            elif n:
                x = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in words[begin:end]:
                        x = x * step + w
                yield mix(np.array([x], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            begin = end
