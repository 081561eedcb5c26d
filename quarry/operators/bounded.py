"""PPMI neighbours by bounds, without counting all pairs.

Among the neighbours of a term a, those with the largest n / df_b come first, n being the documents that hold both; no share is
above min(df_a, df_b) / df_b. Terms lie in the order of their document counts, so that bounds cut a document's terms to a prefix:

* Terms of many documents soon have k neighbours of share 1, the most there is, and ties go to the first in term order. Owners b
  meet them in slices of that order, and it ends for a term with its k-th such neighbour (`_within`).
* Terms of few documents, and others left open, count their own documents' terms up to the bound that the k-th share so far sets
  (`_around`).
* Pairs of two terms of very many documents are counted by partial sums, for no task could hold their documents: tasks that hold
  some of the documents add up the counts of some owners with all such terms (`_busy`). Owners are those that still lack neighbours,
  and those that come before the last neighbour of one that has them.

Tasks get an owner's documents whole, each document once for all of a task's owners. More pairs mean more tasks; results do not
depend on any of the numbers below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .settle import settled, small_batches, stored

#: Up to so many documents, a term counts its own documents' terms; above, it first meets owners in term order.
NARROW = 32
#: A task holds the documents of an owner, so terms of more documents own nothing.
OWNER = 1024
#: Shares of the vocabulary, in term order, that the slices of owners end at.
SLICES = (1 / 256, 1 / 32, 1 / 8, 1 / 4, 1.0)
#: Document counts that partners of terms of few documents go up to, in turn, while a higher one can still matter.
TIERS = (64, 1024)
#: Pairs of an owner's document and one of its terms for a task.
COST = 1 << 30
#: Numbers of documents' terms that a task holds, and the most parts, as a power of two times the cores, that are tried for it.
TASK, DOUBLED = 1 << 24, 24
#: Packed rows of documents that Python gets at a time: a group's rows would stand several times in an executor's memory.
AT_ONCE = 4
#: Parts that documents are dealt to at a time, or as many as there are cores.
ROUND = 12
#: Counts of owners with terms of very many documents that a task adds up at a time.
CELLS = 1 << 23
#: Documents of an owner whose terms a task has in memory as numbers at a time.
SPREAD = 512
#: So many terms have few enough pairs for every task to count all that it meets.
FEW = 1024
#: Found neighbours that a task holds before it keeps the best of each term, and that it returns at a time.
HELD, RETURNED = 1 << 21, 1 << 17

_LOW = (1 << 32) - 1
_ALL = (0, 1 << 32)
_BITS = 1 << 15
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _squeezed(a: np.ndarray) -> bytes:
    """Byte by byte of all values, which are alike in their upper ones."""
    return pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), "zstd", asbytes=True)


def _whole(b: bytes | pa.Buffer, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def pack(n: int, lengths: np.ndarray, codes: np.ndarray, numbers: np.ndarray) -> tuple:
    """n documents: their lengths and, of the codes (sorted, each once), the numbers of those that each holds, as steps."""
    return n, _squeezed(lengths.astype(np.int32)), len(codes), _squeezed(codes), len(numbers), _squeezed(np.diff(numbers.astype(np.int32), prepend=np.int32(0)))


PACKED = "n int, lengths binary, n_codes int, codes binary, n_numbers int, numbers binary"


def unpack(lengths: pa.Scalar, n: int, numbers: pa.Scalar, n_numbers: int) -> tuple[np.ndarray, np.ndarray]:
    return _whole(lengths.as_buffer(), n, np.int32), np.cumsum(_whole(numbers.as_buffer(), n_numbers, np.int32), dtype=np.int32)


def _unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lengths, codes and numbers of each row."""
    n, n_codes, n_numbers = (batch.column(c).to_pylist() for c in ("n", "n_codes", "n_numbers"))
    lengths, codes, numbers = (batch.column(c) for c in ("lengths", "codes", "numbers"))
    for i in range(batch.num_rows):
        sizes, found = unpack(lengths[i], n[i], numbers[i], n_numbers[i])
        yield sizes, _whole(codes[i].as_buffer(), n_codes[i], np.int64), found


def table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.strip().split(" ") for c in schema.split(",")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types, strict=True)], list(names))


def packed(held: DataFrame) -> DataFrame:
    """Documents' sorted codes t, many documents a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            codes, numbers = np.unique(t.flatten().to_numpy(), return_inverse=True)
            yield table([pack(len(t), pc.list_value_length(t).to_numpy(zero_copy_only=False), codes, numbers)], PACKED)

    return held.select("t").mapInArrow(run, PACKED)


def unpacked(docs: DataFrame) -> DataFrame:
    """Their codes t again, a document a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, codes, numbers in _unpacked(batch):
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[numbers]))], ["t"])

    return docs.mapInArrow(run, "t array<bigint>")


def _marked(terms: DataFrame, size: int) -> np.ndarray:
    """A bit for each place: is it one of a's?"""
    place = F.col("a").bitwiseAND(_LOW)
    bits = np.zeros((size // _BITS + 1) * _BITS // 8, np.uint8)
    for r in terms.groupBy(F.shiftright(place, 15).alias("g")).agg(F.expr(f"bitmap_construct_agg(a & {_BITS - 1})").alias("m")).collect():
        bits[r["g"] * _BITS // 8 :][: _BITS // 8] = np.frombuffer(r["m"], np.uint8)
    return bits


@dataclass
class _Ask:
    """Pairs to be counted: owners by document count, place and mark; partners by document count and, if given, mark."""

    owners: tuple[int, int]
    places: tuple[int, int]
    partners: tuple[int, int]
    owners_marked: np.ndarray | None = None
    partners_marked: np.ndarray | None = None

    @staticmethod
    def _chosen(codes: np.ndarray, df: tuple[int, int], marked: np.ndarray | None) -> np.ndarray:
        d, p = codes >> 32, codes & _LOW
        chosen = (d > df[0]) & (d <= df[1])
        return chosen if marked is None else chosen & (marked[p >> 3] >> (p & 7) & 1).astype(bool)

    def sides(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = codes & _LOW
        own = self._chosen(codes, self.owners, self.owners_marked) & (p >= self.places[0]) & (p < self.places[1])
        return own, self._chosen(codes, self.partners, self.partners_marked)

    def parts(self, docs: DataFrame) -> int:
        """Tasks for the pairs; more where documents are too many for a task to hold, by the share of a document's owners that a part has."""
        least = docs.sparkSession.sparkContext.defaultParallelism

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lengths, codes, numbers in _unpacked(batch):
                    own, met = self.sides(codes)
                    of = np.repeat(np.arange(len(lengths)), lengths)
                    x, y = np.bincount(of[own[numbers]], minlength=len(lengths)), np.bincount(of[met[numbers]], minlength=len(lengths))
                    held = [int(np.ceil((y * (1 - (1 - 1 / (least << i)) ** x)).sum())) for i in range(DOUBLED)]
                    yield pa.RecordBatch.from_pydict({"pairs": [int((x * y).sum())], "held": [held]})

        sums = docs.mapInArrow(run, "pairs bigint, held array<bigint>").agg(F.sum("pairs"), *(F.sum(F.col("held")[i]) for i in range(DOUBLED))).first()
        pairs, held = sums[0] or 0, [x or 0 for x in sums[1:]]
        parts = least << next((i for i, x in enumerate(held) if x <= TASK), DOUBLED - 1)
        return max(parts, -(-pairs // COST))


_DEALT = f"part int, {PACKED}, counts binary, n_own int, own binary"


def _dealt(docs: DataFrame, parts: int, first: int, last: int, ask: _Ask) -> DataFrame:
    """Documents with owners and their partners, packed for each part from first to last that has such an owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, codes, numbers in _unpacked(batch):
                owner, partner = ask.sides(codes)
                part_of = (codes & _LOW) % parts
                owner &= (part_of >= first) & (part_of < last)
                of = np.repeat(np.arange(len(lengths)), lengths)
                own = np.flatnonzero(owner[numbers])
                met = partner[numbers]
                kept, sizes = numbers[met], np.bincount(of[met], minlength=len(lengths))
                ends, part = np.cumsum(sizes), part_of[numbers[own]]
                own = own[np.argsort(part, kind="stable")]
                cuts = np.flatnonzero(np.diff(np.sort(part))) + 1
                rows = []
                for mine in np.split(own, cuts) if len(own) else []:
                    at, counts = np.unique(of[mine], return_counts=True)
                    some = sizes[at]
                    taken = kept[np.arange(some.sum()) + np.repeat(ends[at] - np.cumsum(some), some)]
                    used = np.zeros(len(codes), bool)
                    used[taken] = used[numbers[mine]] = True
                    number = np.cumsum(used, dtype=np.int32) - 1
                    steps = np.diff(number[numbers[mine]], prepend=np.int32(0))
                    rows.append((int(part_of[numbers[mine[0]]]), *pack(len(at), some, codes[used], number[taken]), _squeezed(counts.astype(np.int32)), len(mine), _squeezed(steps)))
                if rows:
                    yield table(rows, _DEALT)

    return docs.mapInArrow(run, _DEALT).repartitionById(last - first, "part")


def _in_rounds(docs: DataFrame, ask: _Ask, count: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What all parts count. A round deals documents to a number of parts, so that their copies on disk do not grow with parts."""
    parts, out = ask.parts(docs), None
    step = max(ROUND, docs.sparkSession.sparkContext.defaultParallelism)
    for first in range(0, parts, step):
        more = _dealt(docs, parts, first, min(first + step, parts), ask).groupBy("part").applyInArrow(count, _FOUND)
        more = settled(more) if parts > step else more
        out = more if out is None else out.unionByName(more)
    return out


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a step is settled, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _repeated(numbers: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values found `least` times or more, and how often."""
    s = np.sort(numbers)
    again = s[: len(s) - least + 1][s[least - 1 :] == s[: len(s) - least + 1]]  # all but least - 1 of each run
    first = np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1]])) if len(again) else np.empty(0, np.int64)
    return again[first], np.diff(np.append(first, len(again))) + least - 1


class _Part:
    """The owners of a part, with the documents of each, whose partners are numbers of known codes in their order."""

    def __init__(self, table: pa.Table):
        packed, n_codes = table.column("codes"), table.column("n_codes").to_pylist()
        self.codes = np.unique(np.concatenate([_whole(c.as_buffer(), n, np.int64) for c, n in zip(packed, n_codes, strict=True)]))
        self.df, self.place = self.codes >> 32, self.codes & _LOW
        own, at, sizes, before, filled = [], [], [], 0, 0
        self.numbers = np.empty(sum(table.column("n_numbers").to_pylist()), np.int32)
        for i, (lengths, codes, some) in enumerate(_unpacked(table)):
            known = np.searchsorted(self.codes, codes).astype(np.int32)
            counts = _whole(table.column("counts")[i].as_buffer(), len(lengths), np.int32)
            steps = _whole(table.column("own")[i].as_buffer(), table.column("n_own")[i].as_py(), np.int32)
            own.append(codes[np.cumsum(steps, dtype=np.int32)])
            at.append(np.repeat(np.arange(before, before + len(lengths), dtype=np.int32), counts))
            sizes.append(lengths)
            self.numbers[filled : filled + len(some)] = known[some]
            before, filled = before + len(lengths), filled + len(some)
        self.ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        owners, docs = np.concatenate(own), np.concatenate(at)
        order = np.argsort(owners, kind="stable")
        self.docs = docs[order]
        self.owners, self.first = np.unique(owners[order], return_index=True)

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each owner and the numbers that its documents hold."""
        firsts, begin = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends, np.append(self.first, len(self.docs)).tolist()
        for i, owner in enumerate(self.owners.tolist()):
            docs = self.docs[begin[i] : begin[i + 1]]
            yield owner, np.concatenate([self.numbers[a:b] for a, b in zip(firsts[docs].tolist(), self.ends[docs].tolist(), strict=True)])


def _best(a: np.ndarray, b: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k of highest share for each a, ties to the first in term order."""
    order = np.lexsort((b & _LOW, -n / (b >> 32), a))
    a, b, n = a[order], b[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return a[rank < k], b[rank < k], n[rank < k]


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Table:
    """In pieces, for the executor takes over one at a time."""
    whole = pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": n.astype(np.int64)})
    return pa.Table.from_batches(whole.to_batches(RETURNED), whole.schema)


_FOUND = "a bigint, b bigint, n bigint"


def _within(k: int, least: int, busy: int) -> Callable[[pa.Table], pa.Table]:
    """Terms whose documents include all of an owner's; any share counts for terms of more than `busy` documents."""

    def run(rows: pa.Table) -> pa.Table:
        part, kept, held = _Part(rows), [], 0
        done = tuple(np.empty(0, np.int64) for _ in range(3))
        for owner, numbers in part.groups():
            df = owner >> 32
            at, n = _repeated(numbers, least)
            good = ((n == df) | (part.df[at] > busy)) & (part.df[at] >= df) & (part.codes[at] != owner)
            at, n = at[good], n[good]
            kept.append((part.codes[at], np.full(len(at), owner), n))
            held += len(at)
            if held >= HELD:
                done = _best(*(np.concatenate([d, *x]) for d, x in zip(done, zip(*kept), strict=True)), k)
                kept, held = [], 0
        if kept:
            done = _best(*(np.concatenate([d, *x]) for d, x in zip(done, zip(*kept), strict=True)), k)
        return _rows(*done)

    return run


def _around(k: int, least: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """The neighbours of the owners among the partners."""

    def run(rows: pa.Table) -> pa.Table:
        part, out, some, held = _Part(rows), [_rows(*(np.empty(0, np.int64),) * 3)], [], 0
        kept = lambda: _rows(*_best(*(np.concatenate(x) for x in zip(*some, strict=True)), k))  # noqa: E731  an owner is met once
        for owner, numbers in part.groups():
            at, n = _repeated(numbers, least)
            own = part.codes[at] != owner
            at, n = at[own], n[own]
            if len(at) > k:
                share = n / part.df[at]
                good = share >= np.partition(share, -k)[-k]
                at, n = at[good], n[good]
            some.append((np.full(len(at), owner), part.codes[at], n))
            held += len(at)
            if held >= most:
                out.append(kept())
                some, held = [], 0
        return pa.concat_tables([*out, kept()] if some else out)

    return run


@dataclass
class _Busy:
    """Terms of very many documents: codes in order, which of them are open, and for the others the place of their last neighbour."""

    codes: np.ndarray
    open: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, codes: DataFrame, open_: DataFrame, full: DataFrame) -> _Busy:
        known = np.sort(codes.toArrow().column("a").to_numpy())
        last, ended = np.zeros(len(known), np.int64), full.select("a", "p").toArrow()
        last[np.searchsorted(known, ended.column("a").to_numpy())] = ended.column("p").to_numpy()
        lacking = np.isin(known, open_.select("a").toArrow().column("a").to_numpy())
        return cls(known, lacking, np.where(lacking, 0, last))

    def owners(self) -> np.ndarray:
        """The numbers of terms whose counts are asked for: a neighbour of share 1 is in no more documents than its term."""
        df = self.codes >> 32
        later = np.maximum.accumulate(self.last[::-1])[::-1][np.searchsorted(df, df)] if len(df) else self.last
        return np.flatnonzero(self.open | ((self.codes & _LOW) < later))

    def counts(self, owners: np.ndarray, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """For each part of the owners, their counts with all terms in a task's documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(owners), len(self.codes)), np.int32)
            row = np.full(len(self.codes), -1, np.int64)
            row[owners] = np.arange(len(owners))
            for batch in batches:
                for lengths, codes, numbers in _unpacked(batch):
                    at = np.searchsorted(self.codes, codes)
                    at[codes != np.append(self.codes, -1)[at]] = -1
                    of, term = np.repeat(np.arange(len(lengths)), lengths), at[numbers]
                    of, term = of[term >= 0], term[term >= 0]
                    sizes = np.bincount(of, minlength=len(lengths))
                    firsts = np.cumsum(sizes) - sizes
                    mine = np.flatnonzero(row[term] >= 0)
                    mine = mine[np.argsort(row[term[mine]], kind="stable")]
                    for some in np.split(mine, np.flatnonzero(np.diff(row[term[mine]])) + 1) if len(mine) else []:
                        for at in range(0, len(some), SPREAD):
                            docs = of[some[at : at + SPREAD]]
                            n = sizes[docs]
                            held = np.arange(n.sum()) + np.repeat(firsts[docs] - np.cumsum(n) + n, n)
                            found[row[term[some[0]]]] += np.bincount(term[held], minlength=len(self.codes)).astype(np.int32)
            for part in range(min(parts, len(owners))):
                if found[part::parts].any():
                    yield table([(part, _squeezed(np.ascontiguousarray(found[part::parts]).reshape(-1)))], _SUMS)

        return run

    def neighbours(self, owners: np.ndarray, parts: int, k: int, least: int) -> Callable[[pa.Table], pa.Table]:
        """The best neighbours of an open owner; other terms that an owner is a neighbour of share 1 to, before their last one."""
        df, place = self.codes >> 32, self.codes & _LOW

        def run(rows: pa.Table) -> pa.Table:
            mine = owners[rows.column("part")[0].as_py() :: parts]
            n = sum(_whole(x.as_buffer(), len(mine) * len(df), np.int32) for x in rows.column("counts")).reshape(len(mine), len(df))
            out = []
            for x, found in zip(mine.tolist(), n, strict=True):
                to = (found == df[x]) & (place[x] < self.last)
                to[x] = False
                out.append((self.codes[to], np.full(to.sum(), self.codes[x]), found[to]))
                if self.open[x]:
                    good = found >= least
                    good[x] = False
                    out.append(_best(np.full(good.sum(), self.codes[x]), self.codes[good], found[good], k))
            return _rows(*(np.concatenate(x) for x in zip(*out, strict=True)))

        return run


_SUMS = "part int, counts binary"


def _busy(docs: DataFrame, busy: _Busy, k: int, least: int) -> DataFrame | None:
    """Pairs of terms of very many documents, in rounds of owners."""
    owners, out = busy.owners(), None
    tasks = max(ROUND, docs.sparkSession.sparkContext.defaultParallelism)
    step = max(1, CELLS // max(1, len(busy.codes)))
    for first in range(0, len(owners), step):
        some = owners[first : first + step]
        sums = docs.coalesce(tasks).mapInArrow(busy.counts(some, tasks), _SUMS).repartitionById(tasks, "part")
        more = settled(sums.groupBy("part").applyInArrow(busy.neighbours(some, tasks, k, least), _FOUND))
        out = more if out is None else out.unionByName(more)
    return out


def top(docs: DataFrame, codes: DataFrame, k: int, least: int, counted: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """a, b and n, with the k best neighbours b of every a among them.

    docs: packed documents, of codes (document count in the upper half, place in term order in the lower); codes: all of them,
    as code; counted(held, least): n of all pairs a < b of documents' sorted codes t.
    """
    df, place = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(_LOW)
    codes = settled(codes.select(F.col("code").alias("a")))
    size, most = codes.agg(F.count("*"), F.max(df("a"))).first()
    both_ways = lambda p: p.select(F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))).alias("p")).select("p.*")
    if size <= FEW:
        return both_ways(counted(unpacked(docs), least))
    by = Window.partitionBy("a").orderBy(F.desc(F.col("n") / df("b")), place("b"))
    best = lambda more, found: settled((more if found is None else more.unionByName(found)).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).drop("r"))
    with tidied(docs.sparkSession):
        docs, found, before = stored(docs), None, 0
        with small_batches(docs.sparkSession, AT_ONCE):
            # terms above so many documents still have fewer than k neighbours of share 1
            open_ = codes.filter(df("a") > NARROW)
            full = codes.select("a", F.lit(0).alias("p")).limit(0)
            for share in SLICES:
                end = int(np.ceil(size * share))
                high = open_.agg(F.max(df("a"))).first()[0] or 0
                low = OWNER if share == SLICES[-1] else NARROW  # the others count their own documents' terms
                if high > low and end > before:
                    ask = _Ask((0, min(OWNER, high)), (before, end), (low, high), partners_marked=_marked(open_, size))
                    found = best(_in_rounds(docs, ask, _within(k, least, OWNER)), found)
                    before = end
                    full = found.filter(F.col("n") == df("b")).groupBy("a").agg(F.count("*").alias("c"), F.max(place("b")).alias("p")).filter(F.col("c") >= k)
                    open_ = settled(open_.join(full, "a", "left_anti"))
            high = open_.agg(F.max(df("a"))).first()[0] or 0
            # partners of many documents are counted only while they can be among the k best
            asked = settled(codes.filter(df("a") <= NARROW).unionByName(open_.filter(df("a") <= OWNER)))
            out = found.join(asked, "a", "left_anti") if found is not None else None
            around, low = None, 0
            for end in [*(t for t in TIERS if t < most), most]:
                top_owner = asked.agg(F.max(df("a"))).first()[0] or 0
                if not top_owner:
                    break
                more = _in_rounds(docs, _Ask((0, top_owner), _ALL, (low, end), owners_marked=_marked(asked, size)), _around(k, least, min(HELD, RETURNED)))
                around = settled(more) if around is None else best(more, around)  # a part has all of its owners' documents
                # a term of more than `end` documents has a share below df_a / end
                done = around.groupBy("a").agg(F.count("*").alias("c"), F.min(F.col("n") / df("b")).alias("s")).filter((F.col("c") >= k) & (F.col("s") * end >= df("a")))
                asked, low = settled(asked.join(done, "a", "left_anti")), end
            if around is not None:
                out = around if out is None else out.unionByName(around)
        if most > OWNER:
            many = lambda c: c.filter(df("a") > OWNER)
            busy = _Busy.of(many(codes), many(open_), many(full))
            with small_batches(docs.sparkSession, AT_ONCE):
                pairs = _busy(docs, busy, k, least)
            out = pairs if out is None else out if pairs is None else out.unionByName(pairs)
        return settled(out) if out is not None else docs.sparkSession.createDataFrame([], _FOUND)
