"""Dense vectors: normalisation, cosine, top-k over batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

#: Queries whose blocks are broadcast at most, and decimal places of a cosine that count.
BROADCAST_QUERIES, PLACES = 16_384, 12


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """x / |x|, or x itself where the squares sum to less than 1e-12."""
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(squares < 1e-12, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / F.sqrt(squares)))


def _matrix(rows: list) -> np.ndarray:
    """Unit rows of vectors, filled up with zeros to the longest; see normalise."""
    lengths = [len(r) for r in rows]
    out = np.zeros((len(rows), max(lengths, default=0)))
    for k, r in enumerate(rows):
        out[k, : lengths[k]] = [0.0 if x is None else x for x in r] if None in r else r
    squares = (out * out).sum(axis=1)
    return out / np.where(squares < 1e-12, 1.0, np.sqrt(squares))[:, None]


def top_cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024) -> DataFrame:
    """query_id, id, cosine, rank: brute force of a stated set of queries against all vectors, block against block.

    A row of either side is a block of up to `block` vectors; Spark broadcasts the queries' blocks while they are
    few and pairs the blocks in tasks beyond. A pair is one matrix product, of which k rows for each query leave the task.
    """
    key, held = queries.schema["query_id"].dataType, vectors.schema["id"].dataType

    def packed(names: tuple[str, str]):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    part = batch.slice(at, block)
                    part = part.take(pc.sort_indices(part.column(names[0])))  # ties then go by place
                    unit = _matrix(part.column(names[1]).to_pylist())
                    data = pa.array([unit.tobytes()], pa.binary())
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(names[0]))
                    yield pa.RecordBatch.from_arrays([ids, data], names=[names[0] + "s", names[1] + "s"])

        return run

    def blocks(df: DataFrame, kind, names: tuple[str, str]) -> DataFrame:
        schema = StructType([StructField(names[0] + "s", ArrayType(kind)), StructField(names[1] + "s", BinaryType())])
        return df.select(*names).filter(f"{names[1]} is not null").mapInArrow(packed(names), schema)

    n = queries.count()
    right = blocks(vectors.select("id", "vec"), held, ("id", "vec"))
    left = blocks(queries.select("query_id", F.col("vec").alias("q")).repartition(max(1, -(-n // block))), key, ("query_id", "q"))
    # stated queries in blocks; a block of them is some megabytes at most
    pairs = right.crossJoin(F.broadcast(left) if n <= BROADCAST_QUERIES else left)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, asked = batch.column("ids")[row].values, batch.column("query_ids")[row].values
                v = np.frombuffer(batch.column("vecs")[row].as_py()).reshape(len(ids), -1)
                q = np.frombuffer(batch.column("qs")[row].as_py()).reshape(len(asked), -1)
                both = min(v.shape[1], q.shape[1])
                scores = np.round(q[:, :both] @ v[:, :both].T, PLACES)
                c = np.argsort(-scores, axis=1, kind="stable")[:, :k].ravel()
                r = np.repeat(np.arange(len(asked)), min(k, len(ids)))
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(r)), ids.take(pa.array(c)), pa.array(scores[r, c])], names=["query_id", "id", "cosine"])

    schema = StructType([StructField("query_id", key), StructField("id", held), StructField("cosine", DoubleType())])
    scored = pairs.select("ids", "vecs", "query_ids", "qs").mapInArrow(run, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
