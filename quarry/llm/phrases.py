"""Phrase collocations by Apriori's levels: the frequent (k-1)-grams are broadcast, a k-gram is counted only where both
(k-1)-grams in it are frequent, and the cuts of a phrase are scored from the level tables.

Texts are read once a level. A task hashes the words of some texts at a time, tests the hashes of all (k-1)-grams at once and
counts what is left; the phrases themselves, not their hashes, are what is shuffled and counted, after counts are merged in
each task. What is broadcast is a bit field with a bit for the hash of each frequent (k-1)-gram, of at most MOST_BITS bits
however many there are: it lets every k-gram through that can be frequent, and the few others that share a bit are
dropped by their count. So levels are exact at any size of their tables.

Texts are cut at PIECES and there into words, runs other than space and tab, with A-Z in lower case; phrases lie within
pieces, occurrences may overlap. Null texts are empty, a null language is `und`. Rows that repeat count again; other columns do
not matter. Of cuts with the same score the first counts; phrases of the same score and count are ranked by their bytes. Within some 2 MB of
texts phrases are told apart by 64-bit hashes; two different ones of a million meet with a chance of one in forty million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import _STEP, _VALUES, _powers, mix, text_blocks

LEAST_COUNT, LONGEST, TOP = 30, 4, 2000
#: Hundredths of a phrase's occurrences that lie in one longer phrase if it is no phrase of its own.
INSIDE_PERCENT = 80
SCALE = 2_000_000
#: Bits for each frequent phrase, and bits at most (128 MB).
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Parts of a language that are ranked by themselves first.
SLOTS = 64
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of texts that lie end to end: where they start and stop, their hashes, and whether the next one is in the same piece."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, salts: np.ndarray):
        n = len(data)
        solid = ~_GAP[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cut = ends[(ends > 0) & (ends < n)]
        first[cut], last[cut - 1] = solid[cut], solid[cut - 1]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(ends, self.start, side="right")
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.stop] - total[self.start]) * down[self.start]) ^ salts[self.text]
        del total, solid, first, last
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)
        self.tied = (breaks[self.start[1:]] == breaks[self.stop[:-1] - 1]) & (self.text[1:] == self.text[:-1])
        # a space to join words by
        self.data = np.append(_LOWER[data], np.uint8(32))

    def grams(self, size: int) -> np.ndarray:
        """The hash of the words from each place."""
        n = max(0, len(self.hash) - size + 1)
        h = self.hash[:n].copy()
        for k in range(1, size):
            h = h * np.uint64(_STEP) + self.hash[k : n + k]
        return mix(h)

    def whole(self, size: int) -> np.ndarray:
        """Whether the words from each place lie in one piece."""
        n = max(0, len(self.hash) - size + 1)
        ok = np.ones(n, dtype=bool)
        for k in range(size - 1):
            ok &= self.tied[k : n + k]
        return ok

    def names(self, places: np.ndarray, size: int) -> pa.Array:
        """The phrases from places, words joined by one space."""
        kind = np.int32 if 2 * size * len(self.data) < 1 << 31 else np.int64
        begin = np.full((len(places), 2 * size - 1), len(self.data) - 1, dtype=kind)
        length = np.ones_like(begin)
        for k in range(size):
            begin[:, 2 * k] = self.start[places + k]
            length[:, 2 * k] = self.stop[places + k] - self.start[places + k]
        offsets = np.zeros(len(places) + 1, dtype=np.int64)
        np.cumsum(length.sum(axis=1), out=offsets[1:])
        begin, length = begin.ravel(), length.ravel()
        # where each byte comes from
        at = np.repeat(begin - (np.cumsum(length, dtype=kind) - length), length)
        at += np.arange(offsets[-1], dtype=kind)
        out = self.data[at]
        return pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """The words of some texts of a batch, the number of each text's language, and languages."""
    codes = batch.column("lang").dictionary_encode()
    langs, number = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    salts, at = np.array([_salt(x) for x in langs], dtype=np.uint64), 0
    for data, ends in text_blocks(batch.column("text")):
        own = number[at : at + len(ends)]
        at += len(ends)
        if len(data):
            yield Words(data, ends, salts[own]), own, langs


def _tested(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _count(size: int, field: Broadcast | None):
    """Counts of phrases of `size` words in batches of (lang, text); the row without a phrase has a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(field.value, dtype=np.uint8) if field else None
        for batch in batches:
            for words, number, langs in _parts(batch):
                ok = words.whole(size)
                if bits is not None:
                    part = _tested(bits, words.grams(size - 1))
                    ok &= part[:-1] & part[1:] if len(part) else ok
                places = np.flatnonzero(ok)
                _, first, n = np.unique(words.grams(size)[places], return_index=True, return_counts=True)
                places = places[first]
                lang, phrase = number[words.text[places]], words.names(places, size)
                if size == 1:
                    each = np.bincount(number[words.text], minlength=len(langs))
                    used = np.flatnonzero(each)
                    lang, n, phrase = np.append(lang, used), np.append(n, each[used]), pa.concat_arrays([phrase, pa.nulls(len(used), pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang)), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    return run


def bit_field(level: DataFrame, size: int, rows: int) -> Broadcast:
    """A bit for the hash of each of the level's phrases, as a broadcast of at most MOST_BITS bits."""
    spark, n_bits = level.sparkSession, 1 << 12
    while n_bits < min(MOST_BITS, BITS_EACH * rows):
        n_bits *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for words, _, _ in _parts(batch):
                begins = np.flatnonzero(np.diff(words.text, prepend=-1))
                found.append(words.grams(size)[begins] & np.uint64(n_bits - 1))
            slot = np.concatenate(found).astype(np.int64)
            one = (np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(one)], names=["lane", "bits"])

    lanes = level.select("lang", F.col("phrase").alias("text")).mapInArrow(slots, "lane bigint, bits bigint").groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(n_bits >> 6, dtype=np.int64)
    field[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy()
    return spark.sparkContext.broadcast(field.tobytes())


def levels(df: DataFrame, longest: int = LONGEST, least_count: int = LEAST_COUNT, lang: str = "lang", text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and the tables (lang, phrase, f) of frequent phrases of 1 to `longest` words."""
    given, tables, field, totals = df.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text")), [], None, None
    for size in range(1, longest + 1):
        counted = given.mapInArrow(_count(size, field), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        held = written(counted.filter((F.col("f") >= least_count) | F.col("phrase").isNull()))
        if size == 1:
            totals = held.filter("phrase is null").select("lang", F.col("f").alias("n"))
            held = held.filter("phrase is not null")
        tables.append(held)
        if size < longest:
            field = bit_field(held, size, held.count())
    return totals, tables


def _words(size: int, first: int, until: int):
    """The words from place `first` to `until` of a phrase of `size` words."""
    return F.substring_index(F.substring_index("phrase", " ", until), " ", first - until)


def cuts(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, size, a, k, l, r and score: the lowest-scoring cut of each phrase of two words or more."""
    every, pieces = None, None
    for size, level in enumerate(tables, 1):
        every = level if every is None else every.unionByName(level)
        if size > 1:
            each = F.array(*[F.struct(F.lit(k).alias("k"), _words(size, 0, k).alias("head"), _words(size, k, size).alias("tail")) for k in range(1, size)])
            cut = level.select("lang", "phrase", F.lit(size).alias("size"), F.col("f").alias("a"), F.inline(each))
            pieces = cut if pieces is None else pieces.unionByName(cut)
    # a word that begins many phrases is a frequent key of the left side only, which adaptive joins split
    met = pieces.join(every.toDF("lang", "head", "l"), ["lang", "head"]).join(every.toDF("lang", "tail", "r"), ["lang", "tail"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    return met.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.*")


def inside(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase and longer, the count of the most frequent longer phrase that holds it."""
    parts = None
    for size, level in enumerate(tables[2:], 3):
        held = F.array(*[_words(size, i, i + n) for n in range(2, size) for i in range(size - n + 1)])
        part = level.select("lang", F.col("f"), F.explode(held).alias("phrase"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return tables[0].select("lang", "phrase", F.col("f").alias("longer")).limit(0)
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(df: DataFrame, top: int = TOP, longest: int = LONGEST, least_count: int = LEAST_COUNT, inside_percent: int = INSIDE_PERCENT, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of two to `longest` words."""
    totals, tables = levels(df, longest, least_count, lang, text)
    within = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(inside_percent) * F.col("a"), F.lit(False))
    own = cuts(tables).join(inside(tables), ["lang", "phrase"], "left").filter(~within)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    slot = F.pmod(F.xxhash64("phrase"), F.lit(SLOTS))
    first = own.withColumn("slot", slot).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    # one row for each language
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
