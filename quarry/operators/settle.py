"""Cutting the lineage of a plan that is read more than once."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class _Scope:
    """What plans of a block, or those outside of any block, hold in storage and as tables."""

    frames: list[DataFrame] = field(default_factory=list)
    tables: list[tuple[SparkSession, str, str | None]] = field(default_factory=list)


_outer = _Scope()
_scope: ContextVar[_Scope] = ContextVar("scope", default=_outer)


@contextmanager
def holding():
    """Frees at its end what the block settled, and nothing that other threads or outer blocks did."""
    token = _scope.set(_Scope())
    try:
        yield
    finally:
        release()
        _scope.reset(token)


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage: through spark.checkpoint.dir where it is set, else (on one machine) in the executors' storage,
    until released."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    held = _scope.get().frames
    held.append(df.persist())
    return held[-1]


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Python gets so many rows at a time, or fewer where the session says so, of what the block computes; what it leaves lazy gets the session's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _saved(spark: SparkSession, writer) -> DataFrame:
    """A table below spark.checkpoint.dir, or in the warehouse where that is unset, until released."""
    name, root = f"quarry_{uuid.uuid4().hex}", spark.conf.get("spark.checkpoint.dir", None)
    path = f"{root.rstrip('/')}/{name}" if root else None
    (writer.option("path", path) if path else writer).format("parquet").saveAsTable(name)
    _scope.get().tables.append((spark, name, path))
    return spark.table(name)


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """df as a Parquet table, of which later reads take only the columns and row groups that they need; a task that reads it holds a
    row group, so rows that are large want groups of fewer bytes, looked at row by row."""
    small = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group_bytes else {}
    return _saved(df.sparkSession, df.write.options(**small))


def bucketed(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df as a table of so many buckets, which joins on its keys read without a shuffle."""
    return _saved(df.sparkSession, df.repartition(parts, *keys).write.bucketBy(parts, *keys))


def release() -> None:
    """Frees what this block holds in storage, where a result that still needs it is computed again, and drops its tables."""
    scope = _scope.get()
    while scope.frames:
        scope.frames.pop().unpersist()
    while scope.tables:
        spark, name, path = scope.tables.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path:  # files of a table with a path of its own stay
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def places(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with each row's place, from 1, in an order: rows are sorted and counted over all tasks, not in one."""
    part = F.shiftright("_at", 33)
    laid = settled(df.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each task
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return laid.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).cast("int")).drop("_part", "_at", "_before")
