"""Exact Jaccard join of word-shingle sets: universe partition, pigeonhole and one-deletion neighbourhoods.

Sizes fall into bands so that a partner of a set lies in its own band or the next. For a band, k is
the largest number of elements in which a qualifying pair can differ. The universe of shingles is
dealt to segments by hash. A segment of weight 1 is indexed by its subset of the set, one of weight 2
by that subset and by the subset less each one of its elements; a pair that shares no signature of a
segment differs there in at least as many elements as its weight. With weights adding up to
k + 1 + slack, a qualifying pair shares signatures of segments that weigh at least 1 + slack, so a set
may leave out thin segments (which would match by chance) of up to slack in weight; a set with more
thin segments indexes all of them. How many segments of either weight, and how much slack, is chosen
for each band by estimated cost from its number of sets.

Shingles that a great share of documents hold (passages, licence lines, large groups of copies) would
fill segments that match by chance, so allocation gives them no weight: three universes are kept. Sets
of mostly rare shingles index segments of those alone. Sets with more than k, but fewer, rare shingles
index the first k + 1 of them in a fixed order. Sets with few rare shingles index segments of all. The
ranges overlap by k, so that every qualifying pair meets in one universe: no link is lost whatever
counts as frequent.

Sets that are equal are one class from the start. A signature that SHARED sets of a task's chunk hold
is dealt by their ids to slots of it, about one for SLOT_ROWS rows of the table, and one of the sets stands for the chunk in
slot 0: so no slot grows as a group of near copies does, and the smallest ids of a signature's slots are tied together.

Candidates pass a bound first: a set's odd sketch has one bit for each class of its elements' hashes, set if
the class holds an odd number of them, so two sketches differ in at most as many bits as their sets in
elements. What can still be similar is verified on whole sets. First every set meets the smallest of
the ids that lead its slots, then those that lead the slots whose leader is still in another
component; links make components; then only pairs of a signature that are still in different
components are verified: as rows for signatures of up to HOT sets, and for larger ones block against block of
the sets that such signatures tie together, where only links that join two components leave the task. So
thousands of near copies never become a row for each pair, and no connection is lost.

Defined cases: null or blank text has an empty set and links with nothing; a text of fewer words than
the shingle is one shingle; rows that share a doc_id are one node; a null doc_id has no component; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_rows, checkpoint, join_unique, small_enough, written
from .components import components

WIDTH = 4
#: Least similarity, in hundredths.
PERCENT = 85
#: Ids (of 8 bytes) that are broadcast at most; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: A shingle is frequent if about one in FREQUENT documents holds it; counted in stretches of STRETCH shingles.
FREQUENT = 1000
STRETCH = 2_000_000
#: Share of rare shingles, in hundredths of a band's least size, from which their segments are indexed.
RARE_PERCENT = 75
#: Rows of the table for each slot of a signature, and low bits of it that number slots at most.
SLOT_ROWS, SLOT_BITS = 1000, 16
#: Sets of a chunk of about CHUNK signatures that share one before it is dealt to slots.
SHARED, CHUNK = 4, 400_000
#: Signatures of more than one in GIANT of all rows are at most that many, so they are broadcast.
GIANT, GIANT_ROWS = 1_000_000, 256
#: Sets of a bucket whose pairs become rows at most; larger buckets go by blocks of about so many sets or bytes.
HOT = 16
BLOCK_SETS, BLOCK_BYTES = 512, 4 << 20
#: Columns of an overlap that are multiplied at a time.
COLUMNS = 8192
#: Elements below which a segment of weight 1 or 2 is thin.
THIN = {1: 2, 2: 3}


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    light: int  # segments of weight 1
    heavy: int  # segments of weight 2, which come first
    slack: int

    @property
    def segments(self) -> int:
        return self.light + self.heavy


def band_limits(largest: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(least size, largest size) of each band up to one that holds `largest`."""
    out, low = [], 1
    while low <= largest:
        out.append((low, max(low, 100 * low // percent)))
        low = out[-1][1] + 1
    return out


def differences(high: int, percent: int = PERCENT) -> int:
    """Elements in which a qualifying pair whose smaller set has at most `high` can differ."""
    other = 100 * high // percent
    return (100 - percent) * (high + other) // (100 + percent)


def _tail(mean: float, over: float) -> float:
    """Chance, by a Poisson sum, of more than `over`."""
    if mean <= 0:
        return 0.0
    term = total = math.exp(-mean)
    for i in range(1, int(over) + 1):
        term *= mean / i
        total += term
    return max(0.0, 1 - total)


def allocate(number: int, low: int, high: int, percent: int = PERCENT) -> Band:
    """The mix of weights and slack with the fewest signatures: segments, and the prefixes of sets with too many thin ones."""
    need = differences(high, percent) + 1
    best = None
    for share in (0, 1 / 8, 1 / 4, 1 / 2, 1) if need <= 8 else (0,):
        for slack in range(0, need // 2 + 3):
            total = need + slack
            heavy = math.ceil(total * share / 2)
            light = max(0, total - 2 * heavy)
            fill = (low + high) / 2 / (light + heavy)
            thin = [sum(math.exp(-fill) * fill**i / math.factorial(i) for i in range(THIN[w])) for w in (1, 2)]
            if light + heavy == 1:
                thin = [float(low < THIN[1]), float(low < THIN[2])]
            over = _tail(light * thin[0] + heavy * thin[1], slack if not heavy else slack / (1 + heavy / (heavy + light)))
            # a shared shingle is a likelier chance match than a shared segment of several, so it costs more
            cost = light + heavy * (1 + fill) + over * need * 10
            if best is None or cost < best[0]:
                best = (cost, light, heavy, 2 * heavy + light - need)
    return Band(number, low, high, *best[1:])


def segments(u: np.ndarray, band: Band, universe: int) -> tuple[np.ndarray, bool]:
    """The signatures of a set's segments under a band's partition, and whether too many were left out as thin."""
    m = np.uint64(band.segments)
    h = shingles.mix(u + np.uint64((band.number * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    at = ((h >> np.uint64(32)) % m).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, h = at[order], h[order]
    count = np.bincount(at, minlength=band.segments)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    total = np.zeros(band.segments, np.uint64)
    there = np.flatnonzero(count)
    if len(there):
        total[there] = np.add.reduceat(h, begin[there])
    name = shingles.mix(np.arange(band.segments, dtype=np.uint64) + np.uint64((band.number << 32) + (universe << 56)))
    weight = np.ones(band.segments, np.int64)
    weight[: band.heavy] = 2
    thin = count < np.where(weight == 2, THIN[2], THIN[1])
    # a partner's segment of weight 2 may have one element fewer, so those just below the bound stay
    use = ~thin | (weight == 2) & (count == THIN[2] - 1)
    out = [total[use] ^ name[use]]
    if band.heavy:
        mine = use[at] & (at < band.heavy)
        out.append((total[at[mine]] - h[mine]) ^ name[at[mine]])
    return shingles.mix(np.concatenate(out)), int(weight[thin].sum()) > band.slack


def prefix(u: np.ndarray, k: int, band: Band, universe: int) -> np.ndarray:
    """The signatures of a set's first k + 1 shingles in the order of their mixed values."""
    return shingles.mix(np.sort(shingles.mix(u))[: k + 1] + np.uint64((band.number << 32) + (universe << 56)))


def signatures(u: np.ndarray, band: Band, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set in the universes that its count of rare shingles asks for."""
    k = differences(band.high, percent)
    rare = u
    if len(frequent):
        near = np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)
        rare = u[frequent[near] != u]
    n, enough = len(rare), -(-RARE_PERCENT * band.low // 100)
    out, over = [], False
    if n >= enough:
        found, over = segments(rare, band, 0)
        out.append(found)
    if k < n and (over or n < enough + k):
        out.append(prefix(rare, k, band, 1))
    if n <= 2 * k and n - k < enough:
        found, over = segments(u, band, 2)
        out.append(found)
        if over:
            out.append(prefix(u, k, band, 3))
    return np.unique(np.concatenate(out))


def bands_of(n: int, bands: list[Band], percent: int = PERCENT) -> list[Band]:
    """The band of a size, and the one before if a smaller partner can lie there."""
    k = next(i for i, b in enumerate(bands) if n <= b.high)
    return bands[k - 1 : k + 1] if k and 100 * bands[k - 1].high >= percent * n else bands[k : k + 1]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def odd_sketch(u: np.ndarray) -> bytes:
    """Parities of the classes of a set's hashes: a power of two of them, at least twice its size."""
    bits = max(64, 1 << (2 * len(u) - 1).bit_length())
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Elements in which the sets of two sketches differ, at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # the parity of two classes together
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sketches (doc_id, n_shingles, sketch) allow them to be similar."""
    met = pairs.join(sketches.toDF("a", "na", "x"), "a").join(sketches.toDF("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")

    def bound(batches):
        for batch in batches:
            n, x, y = np.add(batch.column("na").to_numpy(), batch.column("nb").to_numpy()), batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = [least_difference(p, q) * (100 + percent) <= m * (100 - percent) for m, p, q in zip(n.tolist(), x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return checkpoint(met.mapInArrow(bound, "a bigint, b bigint").distinct())


def _only(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join on doc_id; the ids are broadcast if they are few."""
    return df.join(F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids, "doc_id", how)


def _cut(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id and members (sorted hashes) of the documents that are asked for."""

    def load(batches):
        for batch in batches:
            found = [u.tobytes() for u in shingles.sets(batch.column("text"), width)]
            yield arrow_rows(batch, ["doc_id"], {"members": (found, pa.binary())})

    return _only(docs.select("doc_id", "text"), checkpoint(ids.distinct()), "left_semi").mapInArrow(load, "doc_id bigint, members binary")


def _verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough.

    The set of b is cut where its text is read, once for each of its pairs, and meets that of a in one shuffle.
    """
    asked = pairs.select("a", F.col("b").alias("doc_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(asked) if small_enough(asked, BROADCAST_IDS) else asked, "doc_id")

    def load(batches):
        for batch in batches:
            found = [u.tobytes() for u in shingles.sets(batch.column("text"), width)]
            yield arrow_rows(batch, ["a", "doc_id"], {"y": (found, pa.binary())})

    right = rows.select("a", "doc_id", "text").mapInArrow(load, "a bigint, doc_id bigint, y binary")
    left = _cut(docs, pairs.select(F.col("a").alias("doc_id")), width).toDF("a", "x")

    def compare(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return right.join(left, "a").select("a", F.col("doc_id").alias("b"), "x", "y").mapInArrow(compare, "a bigint, b bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of their incidence matrices."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), COLUMNS):
        part, sides = both[at : at + COLUMNS], []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for r, u in enumerate(side):
                near = np.minimum(np.searchsorted(part, u), len(part) - 1)
                m[r, near[part[near] == u]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def spanning_links(left: tuple[list, list, list], right: tuple[list, list, list], percent: int) -> list[tuple[int, int]]:
    """Links between similar sets of two blocks (ids, components, sets), but those that join nothing new."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = [np.array([len(u) for u in side[2]]) for side in (left, right)]
    both = overlaps(left[2], right[2])
    rows, columns = np.nonzero(100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))
    out = []
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        x, y = find(left[1][i]), find(right[1][j])
        if x != y:
            parent[x] = y
            out.append((left[0][i], right[0][j]))
    return out


def _by_blocks(docs: DataFrame, hot: DataFrame, heads: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the sets of large buckets (doc_id, hub, component) that are in different components; heads tie hubs."""
    ties = hot.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).union(heads).filter("a <> b").distinct()
    cluster = components(ties).toDF("doc_id", "cluster")
    placed = hot.select("doc_id", "component").distinct().join(cluster, "doc_id")
    held = checkpoint(placed.join(_cut(docs, placed.select("doc_id"), width), "doc_id"))
    rows, many = held.count(), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.length("members")) / BLOCK_BYTES)).alias("blocks")
    # a component that fills blocks has blocks of its own, which need not meet each other; the others share some
    own = held.groupBy("cluster", "component").agg(many).filter("blocks > 1")
    marked = checkpoint(join_unique(held, own, ["cluster", "component"], rows))
    shared = marked.filter("blocks is null").drop("blocks")
    shared = join_unique(shared, checkpoint(shared.groupBy("cluster").agg(many)), ["cluster"], rows)
    dealt = marked.filter("blocks is not null").withColumn("own", F.col("component")).unionByName(shared.withColumn("own", F.lit(None).cast("bigint")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    packed = checkpoint(dealt.groupBy("cluster", "own", "block").agg(F.collect_list(F.struct("doc_id", "component", "members")).alias("sets")))
    # numbers of blocks alone are paired; their sets follow by equality
    last = checkpoint(packed.groupBy("cluster", "own").agg(F.max("block").alias("last")))
    pairs = last.toDF("cluster", "p", "m").join(last.toDF("cluster", "q", "n"), "cluster").filter("p is null or p < q")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), "m"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), "n"))).filter("q is not null or i <= j")
    side = lambda t, sets: packed.select(F.col("cluster").alias(f"{t}_cluster"), F.col("own").alias(f"{t}_own"), F.col("block").alias(f"{t}_block"), F.col("sets").alias(sets))
    same = lambda t, own, block: (F.col("cluster") == F.col(f"{t}_cluster")) & F.col(own).eqNullSafe(F.col(f"{t}_own")) & (F.col(block) == F.col(f"{t}_block"))
    pairs = pairs.select("cluster", "p", "i", "q", "j").join(side("b", "y"), same("b", "q", "j")).join(side("a", "x"), same("a", "p", "i")).select("x", "y")

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for c in ("x", "y"):
                    x = batch.column(c)[k].values
                    ids, comps, members = (x.field(n) for n in ("doc_id", "component", "members"))
                    sides.append((ids.to_pylist(), comps.to_pylist(), [np.frombuffer(m, np.uint64) for m in members.to_pylist()]))
                found = spanning_links(*sides, percent)
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return pairs.repartition(F.xxhash64(F.col("x")[0]["doc_id"], F.col("y")[0]["doc_id"])).mapInArrow(compare, "a bigint, b bigint")


def _counted(stretches: list[bytes]) -> pa.RecordBatch:
    n = len(stretches)
    return pa.RecordBatch.from_pydict({"doc_id": pa.nulls(n, pa.int64()), "n_shingles": pa.array([-1] * n, pa.int64()), "name": pa.nulls(n, pa.binary()), "sketch": pa.nulls(n, pa.binary()), "often": pa.array(stretches, pa.binary())})


def _frequent(often: DataFrame, documents: int) -> np.ndarray:
    """The sorted shingles that about one in FREQUENT documents or more hold.

    Their number is at most that of a mean set times 2 * FREQUENT; beyond BROADCAST_IDS of them the
    bound is doubled until they fit. Any choice is right, as long as all sets are dealt by the same.
    """

    def unpack(batches):
        for batch in batches:
            for x in batch.column("often"):
                found, times = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["shingle", "n"])

    total = checkpoint(often.mapInArrow(unpack, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(20, documents // (2 * FREQUENT))))
    least = 20
    while (few := total.filter(F.col("n") >= least)).count() > BROADCAST_IDS:
        least *= 2
    return np.sort(few.select("shingle").toArrow().column("shingle").to_numpy().view(np.uint64)) if not few.isEmpty() else np.zeros(0, np.uint64)


def join(df: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def measure(batches):
        """Sizes and names of sets; then, with n_shingles -1, the shingles of each stretch that look frequent."""
        held, most = [], 0

        def often() -> list[bytes]:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            there = times >= max(3, len(held) // (2 * FREQUENT))
            held.clear()
            return [np.stack([found[there], times[there].astype(np.uint64)]).tobytes()]

        for batch in batches:
            size, name, sketch, counted = [], [], [], []
            for u in shingles.sets(batch.column("text"), width):
                size.append(len(u))
                sketch.append(odd_sketch(u) if len(u) else None)
                name.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                held.append(u)
                most += len(u)
                if most >= STRETCH:
                    counted, most = counted + often(), 0
            yield arrow_rows(batch, ["doc_id"], {"n_shingles": (size, pa.int64()), "name": (name, pa.binary()), "sketch": (sketch, pa.binary()), "often": ([None] * len(size), pa.binary())})
            yield _counted(counted)
        if held:
            yield _counted(often())

    measured = written(docs.mapInArrow(measure, "doc_id bigint, n_shingles bigint, name binary, sketch binary, often binary"))
    rows = measured.filter("n_shingles >= 0").select("doc_id", "n_shingles", "name")
    sketches = measured.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "sketch")
    total = rows.count()
    frequent = _frequent(measured.filter("n_shingles < 0").select("often"), total)
    classes = rows.filter("doc_id is not null and name is not null").groupBy("name").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1")
    classes = checkpoint(classes.select("name", "class_id"))
    # neither a class of many copies nor a hub of many stars meets in one task
    members = join_unique(rows, classes, ["name"], total).select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    members = checkpoint(members)
    # a doc_id of several different rows ties their classes together
    mixed = checkpoint(members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).filter("a <> z"))
    ties = members.join(mixed.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b")).filter("a <> b").distinct()

    largest = members.agg(F.max("n_shingles")).first()[0] or 0
    limits = band_limits(largest, percent)
    bands = [allocate(i, low, high, percent) for i, (low, high) in enumerate(limits)]

    known = docs.sparkSession.sparkContext.broadcast(frequent)
    slots = (1 << min(SLOT_BITS, max(1, (total // SLOT_ROWS).bit_length()))) - 1

    def index(batches):
        """Rows of a chunk of whole sets: (signature and slot in one number, doc_id)."""
        ids, found, held = [], [], 0

        def chunk():
            of = np.repeat(np.array(ids, np.int64), [len(x) for x in found])
            names, at, n = np.unique(np.concatenate(found) & ~np.uint64(slots), return_inverse=True, return_counts=True)
            dealt = n[at] >= SHARED
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, at[dealt], of[dealt])
            stand = np.flatnonzero(n >= SHARED)
            slot = shingles.mix(of.view(np.uint64)) % np.uint64(slots) + np.uint64(1)
            names_of = np.where(dealt, names[at] | slot, names[at])
            ids.clear()
            found.clear()
            for rows, docs_ in ((names_of, of), (names[stand], least[stand])):
                yield pa.RecordBatch.from_arrays([pa.array(rows.view(np.int64)), pa.array(docs_)], names=["slot", "doc_id"])

        for batch in batches:
            for i, u in zip(batch.column("doc_id").to_pylist(), shingles.sets(batch.column("text"), width), strict=True):
                if len(u):
                    ids.append(i)
                    found.append(np.unique(np.concatenate([signatures(u, b, known.value, percent) for b in bands_of(len(u), bands, percent)])))
                    held += len(found[-1])
                if held >= CHUNK:
                    yield from chunk()
                    held = 0
        if ids:
            yield from chunk()

    # a doc_id that has another text besides stays, for no row but its own may stand for that
    copies = members.filter("doc_id <> class_id").select("doc_id").distinct().join(mixed.filter("z = doc_id").select("doc_id"), "doc_id", "left_anti")
    single = _only(docs.filter("doc_id is not null"), copies, "left_anti")
    indexed = single.mapInArrow(index, "slot bigint, doc_id bigint")
    by = Window.partitionBy("slot")
    led = indexed.withColumns({"hub": F.min("doc_id").over(by), "top": F.max("doc_id").over(by)}).withColumn("part", F.col("slot").bitwiseAND(slots))
    buckets = led.filter("hub <> top or part > 0").select((F.col("slot") - F.col("part")).alias("signature"), "part", "doc_id", "hub")
    # in columns, which take half the room of a checkpoint's rows
    buckets = written(buckets)
    # the hubs of a dealt signature's slots, at most one for each
    parted = buckets.filter("part > 0").select("signature", "hub").distinct()
    hubs = parted.union(buckets.filter("part = 0 and doc_id = hub").select("signature", "hub").join(parted.select("signature").distinct(), "signature", "left_semi"))
    heads = hubs.join(hubs.groupBy("signature").agg(F.min("hub").alias("a")), "signature").select("signature", "a", F.col("hub").alias("b")).filter("a <> b")
    heads = checkpoint(heads.distinct())
    stars = checkpoint(buckets.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).union(heads.select("a", "b")).filter("a <> b").distinct())
    # one pair for each set first: of its hubs the smallest; then only what that left apart
    first = checkpoint(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = checkpoint(_verify(docs, _possible(first, sketches, percent), width, percent).union(ties))
    found = checkpoint(components(links))
    at = lambda c: found.toDF(c, f"c{c}")
    apart = checkpoint(stars.join(first, ["a", "b"], "left_anti"))
    apart = join_unique(apart, at("a"), ["a"], total).join(at("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    apart = _possible(apart, sketches, percent)
    if not apart.isEmpty():
        links = checkpoint(links.union(_verify(docs, apart, width, percent)))
        found = checkpoint(components(links))

    placed = buckets.join(found.toDF("doc_id", "component"), "doc_id", "left").select("signature", "doc_id", "hub", F.coalesce("component", "doc_id").alias("component"))
    # minima and counts are taken before the shuffle, and rows of frequent signatures do not meet in one task after it;
    # two sets have met as a star
    open_ = placed.groupBy("signature").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).filter("least <> most and n > 2")
    open_ = checkpoint(open_.select("signature", "n"))
    many = max(GIANT_ROWS, (open_.agg(F.sum("n")).first()[0] or 0) // GIANT)
    giant = F.broadcast(open_.filter(F.col("n") > many))
    few = placed.join(giant.select("signature"), "signature", "left_anti").join(open_.filter(F.col("n") <= many), "signature")
    rows_of = checkpoint(few.unionByName(placed.join(giant, "signature")))
    cold, hot = rows_of.filter(F.col("n") <= HOT).drop("n", "hub"), rows_of.filter(F.col("n") > HOT).drop("n")
    left, right = cold.toDF("signature", "a", "ca"), cold.toDF("signature", "b", "cb")
    rest = left.join(right, "signature").filter("a < b and ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    rest, more = _possible(rest, sketches, percent), None
    if not rest.isEmpty():
        more = _verify(docs, rest, width, percent)
    if not hot.isEmpty():
        own = heads.join(open_.filter(F.col("n") > HOT), "signature", "left_semi").select("a", "b")
        dense = _by_blocks(docs, hot, own, width, percent)
        more = more.union(dense) if more else dense
    if more:
        links = checkpoint(links.union(more.distinct()))
        found = checkpoint(components(links))
    reached = found.toDF("class_id", "component")
    return join_unique(members, reached, ["class_id"], total).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")).alias("component_id"))


def keep_one(df: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of df less all but the smallest doc_id of each component; all columns stay."""
    joined = join(df, width, percent)
    gone = checkpoint(joined.filter("doc_id <> component_id").select("doc_id").distinct())
    kept = df.join(F.broadcast(gone) if small_enough(gone, BROADCAST_IDS) else gone, "doc_id", "left_anti")
    repeated = not df.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
    if repeated:
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept.select(*df.columns)
