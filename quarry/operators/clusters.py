"""Dense top-k over a stored index: unit vectors in rings around centroids, pruned by the triangle inequality of angles.

Each vector belongs to its nearest centroid. A block holds vectors of one centroid whose angles to it lie between two bounds, so a
query at angle t to the centroid is at no less than max(0, low - t, t - high) from any of them, which bounds its
cosines. A search reads the blocks of best bound first, and then those that can still beat the k-th cosine found: results are those of
vector.top_cosine. Vectors are normalised and packed once, when the index is made.

Centroids are fitted on a bounded sample; every vector is indexed. Blocks are cut along all tasks in the order of
centroid and angle, so one centroid may hold any share of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .settle import settled, stored
from .vector import BROADCAST_QUERIES, PLACES, _matrix, top_cosine

#: Vectors of a block, of the sample that centroids are fitted on, centroids at most and rounds of fitting.
BLOCK, SAMPLE, MOST_CENTROIDS, ROUNDS = 512, 8192, 512, 4
#: What rounding can change of a bound.
SLACK = 1e-9


@dataclass
class VectorIndex:
    """blocks: block, cluster (-1: vectors without a direction), low, high, n, ids and data."""

    blocks: DataFrame
    centroids: np.ndarray
    dims: int


def _wide(rows: list, dims: int) -> np.ndarray:
    m = _matrix(rows)
    return np.pad(m, ((0, 0), (0, dims - m.shape[1]))) if m.shape[1] < dims else m[:, :dims]


def _centroids(sample: np.ndarray, n: int) -> np.ndarray:
    found = sample[:n].copy()
    for _ in range(ROUNDS):
        near = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        found = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], found)
    return found


def build(vectors: DataFrame) -> VectorIndex:
    """The index of (id, vec); null vectors are left out."""
    given, kind = vectors.select("id", "vec").filter("vec is not null"), vectors.schema["id"].dataType
    n, dims = given.agg(F.count("*"), F.max(F.size("vec"))).first()
    dims = dims or 1
    rows = [r["vec"] for r in given.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").collect()]
    sample = _wide(rows, dims)
    sample = sample[(sample * sample).sum(axis=1) > 0.5]
    centroids = _centroids(sample, max(1, min(MOST_CENTROIDS, n // BLOCK))) if len(sample) else np.zeros((0, dims))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit, c = _wide(part.column("vec").to_pylist(), dims), shared.value
                cosines = unit @ c.T if len(c) else np.zeros((len(unit), 1))
                near, sound = cosines.argmax(axis=1), (unit * unit).sum(axis=1) > 0.5
                angle = np.arccos(np.clip(cosines[np.arange(len(unit)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.where(sound, near, -1), pa.int32()), pa.array(np.where(sound, angle, 0.0)), pa.array([v.tobytes() for v in unit], pa.binary())], names=["id", "cluster", "angle", "data"])

    placed = given.mapInArrow(place, StructType([StructField("id", kind), StructField("cluster", IntegerType()), StructField("angle", DoubleType()), StructField("data", BinaryType())]))
    dealt = settled(placed).repartitionByRange("cluster", "angle", "id").sortWithinPartitions("cluster", "angle", "id")

    def cut(batches):
        first, made, held = TaskContext.get().partitionId() << 33, 0, []

        def block():
            nonlocal made
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            made += 1
            low, high = part.column("angle")[0].as_py(), part.column("angle")[-1].as_py()
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id").combine_chunks())
            data = b"".join(part.column("data").to_pylist())
            columns = [pa.array([first + made], pa.int64()), pa.array([part.column("cluster")[0].as_py()], pa.int32()), pa.array([low]), pa.array([high]), pa.array([part.num_rows], pa.int32()), ids, pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "cluster", "low", "high", "n", "ids", "data"])

        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            at = 0
            while at < batch.num_rows:
                if held and held[0].column("cluster")[0].as_py() != cluster[at]:
                    yield block()
                room = BLOCK - sum(b.num_rows for b in held)
                until = min(at + room, int(np.searchsorted(cluster, cluster[at], side="right")))
                held.append(batch.slice(at, until - at))
                at = until
                if sum(b.num_rows for b in held) == BLOCK:
                    yield block()
        if held:
            yield block()

    schema = StructType([StructField("block", LongType()), StructField("cluster", IntegerType()), StructField("low", DoubleType()), StructField("high", DoubleType()), StructField("n", IntegerType()), StructField("ids", ArrayType(kind)), StructField("data", BinaryType())])
    return VectorIndex(stored(dealt.mapInArrow(cut, schema)), centroids, dims)


def _bounds(q: np.ndarray, c: np.ndarray, cluster: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and block the largest cosine that a vector of the block can have."""
    angle = np.arccos(np.clip(q @ c.T, -1, 1))[:, cluster] if len(c) else np.zeros((len(q), len(cluster)))
    out = np.cos(np.maximum(0, np.maximum(low - angle, angle - high)))
    out[:, cluster < 0] = 1
    out[(q * q).sum(axis=1) < 0.5] = 1
    return out


def search(index: VectorIndex, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """query_id, id, cosine and rank, as vector.top_cosine has them; and query_id and n_read, the vectors read for it.

    Up to BROADCAST_QUERIES queries are broadcast; more of them go through all vectors in blocks.
    """
    spark, key = queries.sparkSession, queries.schema["query_id"].dataType
    asked = queries.select("query_id", "vec").filter("vec is not null")
    kind = index.blocks.schema["ids"].dataType.elementType
    if asked.count() > BROADCAST_QUERIES:
        unit = index.blocks.select(F.explode(F.arrays_zip("ids", F.sequence(F.lit(0), F.size("ids") - 1).alias("at"))).alias("x"), "data")
        dims = index.dims

        def unpack(batches):
            for batch in batches:
                rows = [np.frombuffer(d, count=dims, offset=8 * dims * i) for d, i in zip(batch.column("data").to_pylist(), batch.column("at").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["id", "vec"])

        vectors = unit.select(F.col("x.ids").alias("id"), F.col("x.at").alias("at"), "data").mapInArrow(unpack, StructType([StructField("id", kind), StructField("vec", ArrayType(DoubleType()))]))
        n = index.blocks.agg(F.sum("n").alias("n_read"))
        return top_cosine(vectors, asked, k), asked.select("query_id").crossJoin(F.broadcast(n))
    rows = asked.collect()
    q = np.ascontiguousarray(_wide([r["vec"] for r in rows], index.dims)) if rows else np.zeros((0, index.dims))
    shared = spark.sparkContext.broadcast((q, index.centroids))
    outline = settled(index.blocks.select("block", "cluster", "low", "high", "n"))
    some = max(2, 2 * -(-k // BLOCK))

    def best(batches):
        for batch in batches:
            q, c = shared.value
            bound = _bounds(q, c, *[batch.column(x).to_numpy() for x in ("cluster", "low", "high")])
            at = np.argsort(-bound, axis=1, kind="stable")[:, :some]
            r, b = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), batch.column("block").take(pa.array(b)), pa.array(bound[r, b])], names=["q", "block", "bound"])

    by = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    first = settled(outline.mapInArrow(best, "q int, block bigint, bound double").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= some).select("q", "block"))

    def score(limits=None):
        """The k best of each block; with limits (cosine, id) of each query only what comes before those."""

        def run(batches):
            for batch in batches:
                q, _ = shared.value
                for row in range(batch.num_rows):
                    ids, who = batch.column("ids")[row].values, np.array(batch.column("qs")[row].as_py())
                    v = np.frombuffer(batch.column("data")[row].as_py()).reshape(len(ids), -1)
                    scores, named = np.round(q[who] @ v.T, PLACES), np.array(ids.to_pylist())
                    order = np.lexsort((np.broadcast_to(named, scores.shape), -scores), axis=1)[:, :k]
                    r, c = np.repeat(np.arange(len(who)), order.shape[1]), order.ravel()
                    if limits:
                        least, last = limits.value
                        keep, ties = scores[r, c] > least[who[r]], np.flatnonzero(scores[r, c] == least[who[r]])
                        keep[ties] = [named[c[i]] < last[who[r[i]]] for i in ties]
                        r, c = r[keep], c[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(who[r], pa.int32()), ids.take(pa.array(c)), pa.array(scores[r, c])], names=["q", "id", "cosine"])

        return run

    top = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    schema = StructType([StructField("q", IntegerType()), StructField("id", kind), StructField("cosine", DoubleType())])
    # at most BROADCAST_QUERIES numbers a block
    paired = lambda pairs: index.blocks.select("block", "ids", "data").join(pairs.groupBy("block").agg(F.collect_list("q").alias("qs")), "block").select("ids", "data", "qs")
    found = settled(ranked(paired(first).mapInArrow(score(), schema)))
    least, last = np.full(len(q), -np.inf), [None] * len(q)
    for r in found.filter(F.col("rank") == k).select("q", "cosine", "id").collect():  # one row a query
        least[r["q"]], last[r["q"]] = r["cosine"], r["id"]
    limits = spark.sparkContext.broadcast((least, last))

    def left(batches):
        for batch in batches:
            q, c = shared.value
            bound = _bounds(q, c, *[batch.column(x).to_numpy() for x in ("cluster", "low", "high")])
            r, b = np.nonzero(bound + SLACK >= limits.value[0][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), batch.column("block").take(pa.array(b))], names=["q", "block"])

    rest = settled(outline.mapInArrow(left, "q int, block bigint").join(first, ["q", "block"], "left_anti"))
    names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], StructType([StructField("q", IntegerType()), StructField("query_id", key)]))
    out = ranked(found.drop("rank").unionByName(paired(rest).mapInArrow(score(limits), schema))).join(F.broadcast(names), "q").select("query_id", "id", "cosine", "rank")
    read = first.unionByName(rest).join(outline, "block").groupBy("q").agg(F.sum("n").alias("n_read"))
    return out, read.join(F.broadcast(names), "q").select("query_id", "n_read")
