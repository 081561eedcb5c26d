"""Exact top-k inner products with a vector-approximation file.

Vectors are integers, floor(64 * x) of each component. Two files are written to the shared folder: the
exact vectors by key, and their approximations, 1 << BITS cells of equal width per component between its
least and greatest value, packed to BITS bits. Work is dealt as pairs of a block of queries and a file of
approximations, whose tasks read both by themselves, so that nothing is shuffled or broadcast but numbers.

The cells bound every score from both sides. A first scan takes each query's k best lower bounds of a
file; the k-th best of all files is a score that k candidates reach for certain. A second scan with that
threshold, which all files share, passes on the candidates whose upper bound reaches it. Their exact vectors are
then fetched by key in order of upper bound, READ at first and twice as many in each round after it, until the
k-th exact score of every query exceeds all its bounds that are left: ties are read, so the k best are
certain. Bounds are widened by what floating-point sums can be off.

Of equal vectors only the k + 1 smallest ids are candidates, for no more of them can be among the k best of
any query: a vector that a third of all rows share costs no query more than that.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Shorter
vectors count as filled up with zeros. Ties go to the smaller vec_id. A query's own id is never its candidate. Rows
that repeat a query's id and vector are one query; repeated candidates each keep their place. Scores beyond 63 bits wrap. Other
columns are ignored; an empty table, or one of empty vectors alone, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, filesystem, written

SCALE = 64
#: Vectors of a file and of a block of it at most, queries of a block, and vectors of a file where there are few.
FILE, CANDIDATES, QUERIES, LEAST_FILE = 131_072, 2048, 1024, 4096
BITS = 6
#: Exact vectors that a query reads first.
READ = 64


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column as int64, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == dims).all():
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


class Grid:
    """Cells of each component: value = low + width * cell + rest, 0 <= rest < width."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.bits, self.low = bits, low
        self.width = np.array([-(-(h - a + 1) // (1 << bits)) for a, h in zip(low.tolist(), high.tolist(), strict=True)], np.int64)
        self.most = np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64))) + self.width

    def pack(self, vectors: np.ndarray) -> bytes:
        cells = ((vectors - self.low) // self.width).astype(np.uint8)
        return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(cells), -1), axis=1).tobytes()

    def unpack(self, data: bytes, n: int) -> np.ndarray:
        dims = len(self.low)
        bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(n, -1), axis=1)[:, : dims * self.bits].reshape(n, dims, self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint8))

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of queries (rows) with approximated vectors (columns)."""
        q = q.astype(np.float64)
        known = (q @ self.low)[:, None] + (q * self.width) @ cells.T.astype(np.float64)
        off = np.abs(q) @ self.most * 2.0**-44
        return known + (np.minimum(q, 0) @ (self.width - 1) - off)[:, None], known + (np.maximum(q, 0) @ (self.width - 1) + off)[:, None]


def _extremes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each component; a row for each component comes back."""

    def run(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("v"), dims)
                low = m.min(axis=0) if low is None else np.minimum(low, m.min(axis=0))
                high = m.max(axis=0) if high is None else np.maximum(high, m.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(dims), "low": low, "high": high})

    rows = vectors.select("v").mapInArrow(run, "at bigint, low bigint, high bigint").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    return np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64)


def _packed(df: DataFrame, size: int, dims: int, key: str, encode) -> list[str]:
    """Paths of Parquet files of rows (n, ids, keys, data) of at most `size` vectors each."""

    def pack(batches):
        ids, keys, rows, held = [], [], [], 0

        def block(n: int):
            i, k, m = np.concatenate(ids), np.concatenate(keys), np.concatenate(rows)
            ids[:], keys[:], rows[:] = [i[n:]], [k[n:]], [m[n:]]
            return pa.RecordBatch.from_pydict({"n": pa.array([len(i[:n])], pa.int64()), "ids": [i[:n].tobytes()], "keys": [k[:n].tobytes()], "data": [encode(m[:n])]})

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy())
                keys.append(batch.column(key).to_numpy())
                rows.append(matrix(batch.column("v"), dims))
                held += batch.num_rows
                while held >= size:
                    yield block(size)
                    held -= size
        if held:
            yield block(held)

    return written(df.mapInArrow(pack, "n bigint, ids binary, keys binary, data binary")).inputFiles()


def _read(path: str):
    """The rows of a file that _packed wrote, one at a time."""
    import pyarrow.parquet as pq

    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
            yield from batch.to_pylist()


def _queries(path: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys and vectors of a block of queries."""
    found = list(_read(path))
    return tuple(np.concatenate([np.frombuffer(r[c], np.int64) for r in found]) for c in ("ids", "keys")) + (np.concatenate([np.frombuffer(r["data"], np.int64).reshape(-1, dims) for r in found]),)


def _scan(spark: SparkSession, asked: list[str], files: list[str], grid: Grid, k: int, thresholds: DataFrame | None) -> DataFrame:
    """Without thresholds: (q, bound) of each query's k best lower bounds in each file. With (block, reached: array
    of (q, least)): (q, key, bound) of all candidates whose upper bound reaches their query's."""
    dims, first = len(grid.low), thresholds is None

    def run(batches):
        for batch in batches:
            reached = None if first else batch.column("reached").to_pylist()
            for row, (block, file) in enumerate(zip(batch.column("block").to_pylist(), batch.column("file").to_pylist(), strict=True)):
                q_ids, q_keys, q = _queries(asked[block], dims)
                if not first:
                    least_of = {x["q"]: x["least"] for x in reached[row]}
                    least = np.array([least_of.get(x, -np.inf) for x in q_keys.tolist()])
                best = np.full((len(q), k), -np.inf)
                for part in _read(files[file]):
                    ids, keys = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["keys"], np.int64)
                    low, high = grid.bounds(q, grid.unpack(part["data"], part["n"]))
                    own = q_ids[:, None] == ids[None, :]
                    if first:
                        low[own] = -np.inf
                        both = np.concatenate([best, low], axis=1)
                        best = -np.partition(-both, k - 1, axis=1)[:, :k]
                    else:
                        r, c = np.nonzero((high >= least[:, None]) & ~own)
                        yield pa.RecordBatch.from_pydict({"q": q_keys[r], "key": keys[c], "bound": high[r, c]})
                if first:
                    r, c = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_pydict({"q": q_keys[r], "bound": best[r, c]})

    n = len(asked) * len(files)
    pairs = spark.range(0, n, 1, min(n, 100_000)).select(F.expr(f"id div {len(files)}").alias("block"), F.pmod("id", F.lit(len(files))).alias("file"))
    if first:
        return pairs.mapInArrow(run, "q bigint, bound double")
    return pairs.join(thresholds, "block").mapInArrow(run, "q bigint, key bigint, bound double")


def _scored(pairs: DataFrame, vectors: DataFrame, asked: DataFrame, dims: int) -> DataFrame:
    """(q, query_id, vec_id, score) of pairs (q, key), whose exact vectors are fetched."""
    met = pairs.select("q", "key").join(vectors.select("key", "vec_id", "v"), "key").join(asked.select("q", F.col("vec_id").alias("query_id"), F.col("v").alias("w")), "q")

    def run(batches):
        for batch in batches:
            score = (matrix(batch.column("v"), dims) * matrix(batch.column("w"), dims)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "query_id", "vec_id")), pa.array(score, pa.int64())], names=["q", "query_id", "vec_id", "score"])

    return met.select("q", "query_id", "vec_id", "v", "w").mapInArrow(run, "q bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, k: int = 20, query: str = "vec_id % 20 = 0", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row that the condition selects."""
    return search(df, k, query, vector)[0]


def search(df: DataFrame, k: int, query: str, vector: str) -> tuple[DataFrame, DataFrame | None]:
    """What top_k returns, and the pairs (q, key) whose exact vectors were read."""
    spark = df.sparkSession
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    valid = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & sound)
    ints = written(valid.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE)))).alias("v")))
    asked = written(ints.filter(query).distinct().withColumn("q", F.monotonically_increasing_id()))
    equal = Window.partitionBy("v").orderBy("vec_id")
    # of equal vectors the rows of k + 1 ids, one of which can be the query's own, and of each id k rows
    ids = ints.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("rows"))
    kept = ids.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("col")
    vectors = written(kept.withColumn("key", F.monotonically_increasing_id()))
    n, dims = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = asked.count()
    if not n or not dims or not n_asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint"), None
    grid = Grid(*_extremes(vectors, dims))
    parts = max(-(-n // FILE), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_FILE)))
    files = _packed(vectors.repartition(parts), CANDIDATES, dims, "key", grid.pack)
    blocks = _packed(asked.repartition(-(-n_asked // QUERIES)), QUERIES, dims, "q", lambda m: m.tobytes())

    by = Window.partitionBy("q").orderBy(F.desc("bound"))
    lower = _scan(spark, blocks, files, grid, k, None).withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k)
    reached = lower.groupBy("q").agg(F.min("bound").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
    number = {path: i for i, path in enumerate(blocks)}

    def owners(batches):
        for batch in batches:
            for b in batch.column("block").to_pylist():
                keys = _queries(blocks[b], dims)[1]
                yield pa.RecordBatch.from_pydict({"block": np.full(len(keys), b), "q": keys})

    placed = spark.range(0, len(number), 1, len(number)).select(F.col("id").alias("block")).mapInArrow(owners, "block bigint, q bigint")
    thresholds = checkpoint(placed.join(reached.select("q", "least"), "q", "left").groupBy("block").agg(F.collect_list(F.struct("q", F.coalesce("least", F.lit(float("-inf"))).alias("least"))).alias("reached")))
    close = written(_scan(spark, blocks, files, grid, k, thresholds).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "key"))))

    left, read, at, most = close.select("q", "key", "bound", "place"), None, 0, READ
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    while True:
        pairs = left.filter((F.col("place") > at) & (F.col("place") <= most)).select("q", "key")
        found = _scored(pairs, vectors, asked, dims)
        scored = checkpoint((found if read is None else read.unionByName(found)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
        read = scored.drop("rank")
        kth = scored.filter(F.col("rank") == k).select("q", "score")
        left = checkpoint(left.filter(F.col("place") > most).join(kth, "q", "left").filter(F.col("score").isNull() | (F.col("bound") >= F.col("score"))).drop("score"))
        if left.isEmpty():
            return scored.select("query_id", "rank", "vec_id", "score"), close
        at, most = most, most * 2
