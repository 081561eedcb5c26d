"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words in every contract of this subpackage: space and 0x09 to 0x0D.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor and the driver share.

    Where the setting is absent on one machine (in tests) a temporary folder takes its place and is
    registered for checkpoints too; on a cluster that is an error, for executors do not share such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = current or "file://" + tempfile.mkdtemp(prefix="quarry-")
        if not current:
            spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    for held in _scratch.get():
        held.append(path)
    return path


#: The blocks that the code of this thread or task is in.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Deletes what the block put below the shared folder when it ends, so its result must stand elsewhere by then.

    Without it, tables that a lazy result still needs stay until the folder itself is cleared.
    """
    held: list[str] = []
    token = _scratch.set((*_scratch.get(), held))
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, held)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders on whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder; never a local checkpoint."""
    work_dir(df.sparkSession, "probe")
    done = df.checkpoint(eager=True)
    if _scratch.get():
        file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
        for held in _scratch.get() if file.isDefined() else []:
            held.append(file.get())
    return done


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a Parquet table in the shared folder, which suits many narrow rows."""
    path = work_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def no_collections():
    """Python's cyclic collector rests in the block, for work whose many objects hold no cycles; a worker's later tasks have it again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def filesystem(uri: str):
    """The pyarrow file system and path of a folder named by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def publish(fs, path: str, data: bytes) -> None:
    """Writes a file under a private name, then renames it: a lost or repeated task leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and 0x09 to 0x0D; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+")
    return F.filter(parts, lambda w: w != "")


def schema_of(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    """The fields of df named in keys, then those of the DDL string."""
    fields = [T.StructField(k, df.schema[k].dataType, True) for k in keys]
    return T.StructType(fields + T._parse_datatype_string(more).fields)


def arrow_rows(batch: pa.RecordBatch, keys: list[str], columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A batch of the key columns as they came and the computed columns."""
    arrays = [batch.column(k) for k in keys] + [pa.array(v, type=t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, *columns])


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; each task counts its own."""
    return df.count() <= rows


def with_ids(df: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", most: int = 2_000_000) -> DataFrame:
    """A join with a table of distinct keys, which is broadcast if it has at most `most` rows and shuffled beyond."""
    return df.join(F.broadcast(ids) if small_enough(ids, most) else ids, key, how)


#: Keys that hold more than one in FREQUENT_SHARE of all rows, and FREQUENT_ROWS at least, are at most FREQUENT_SHARE.
FREQUENT_SHARE, FREQUENT_ROWS = 100_000, 256


def join_unique(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """A left join with a table of distinct keys whose frequent keys never meet in one task.

    Keys are counted before a shuffle; the frequent ones among `rows` rows, at most FREQUENT_SHARE of them, are
    broadcast with what they join to, and the rest is shuffled. left is read twice, so it should be a table or a
    checkpoint.
    """
    known = left.filter(" and ".join(f"{c} is not null" for c in on))
    often = known.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > max(FREQUENT_ROWS, rows // FREQUENT_SHARE)).drop("n")
    often = checkpoint(often)
    if often.isEmpty():
        return left.join(right, on, "left")
    hot = F.broadcast(right.join(F.broadcast(often), on, "left_semi"))
    return left.join(F.broadcast(often), on, "left_semi").join(hot, on, "left").unionByName(left.join(F.broadcast(often), on, "left_anti").join(right, on, "left"))


def places(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with each row's place, from 1, in its group: rows are sorted over all tasks, so a group may be of any size."""
    part = F.shiftright("_at", 33)
    laid = written(df.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    runs = laid.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each group and task
    runs = runs.withColumn("_before", earlier).drop("_n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    met = laid.withColumn("_part", part).alias("a").join(runs.alias("b"), [*same, F.col("a._part") == F.col("b._part")])
    return met.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("a._at") - F.col("b._first") + F.col("b._before") + 1).alias(name))
