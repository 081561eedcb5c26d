"""Table maintenance as set operations: upserts, deletes, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .vector import normalise


def upsert(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of delta replace those of base with the same key."""
    return base.join(delta.select(*key).distinct(), key, "left_anti").unionByName(delta)


def insert_missing(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Union without repeats."""
    return base.unionByName(delta).dropDuplicates()


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges less those of gone (id): a file takes its symbols along, a node its edges both ways."""
    ids = gone.select("id").distinct()
    own = nodes.join(ids, "id", "left_anti").withColumn("_file", T.file_id(F.col("id")))
    kept = own.join(ids.withColumnRenamed("id", "_file"), "_file", "left_anti").drop("_file")
    dead = nodes.select("id").join(kept.select("id"), "id", "left_anti")
    left = edges.join(dead.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(dead.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return kept, left.select(*edges.columns)


def clear_contents(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes symbols of the files and the edges that leave the files."""
    ids = files.select(F.col("id").alias("_file")).distinct()
    kept = nodes.withColumn("_file", F.when(F.instr("id", ":") > 0, F.substring_index("id", ":", 1))).join(ids, "_file", "left_anti").select(*nodes.columns)
    left = edges.join(ids.withColumnRenamed("_file", "from_id"), "from_id", "left_anti")
    return kept, left.select(*edges.columns)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id and state (new, changed, same, deleted) of (id, hash) tables."""
    b, a = before.select("id", F.col("hash").alias("old")), after.select("id", F.col("hash").alias("now"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") == F.col("now"), "same").otherwise("changed")
    return b.join(a, "id", "full_outer").select("id", state.alias("state"))


def stale(existing: DataFrame, seen: DataFrame, root: str = "") -> DataFrame:
    """Existing ids below root that were not seen."""
    return existing.filter(F.col("id").startswith(root)).join(seen.select("id"), "id", "left_anti")


def current(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, hash) with known, whether a node of that id exists, and current, whether it has that hash."""
    held = nodes.select("id", F.col("hash").alias("held"))
    return wanted.select("id", "hash").join(held, "id", "left").select("id", F.col("held").isNotNull().alias("known"), F.coalesce(F.col("held") == F.col("hash"), F.lit(False)).alias("current"))


def latest(rows: DataFrame, order: str) -> DataFrame:
    """The row of each id that comes last in an order."""
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("_row")).select("id", "_row.*").select(*rows.columns)


def unit_vectors(delta: DataFrame, kind: str = "array<float>") -> DataFrame:
    """(id, dim, vec) of (id, vec) at unit length."""
    made = delta.select("id", normalise(F.col("vec")).cast(kind).alias("vec"))
    return made.select("id", F.size("vec").alias("dim"), "vec")


def upsert_vectors(base: DataFrame, delta: DataFrame, order: str | None = None) -> DataFrame:
    """(id, dim, vec) with the vectors of delta (id, vec) at unit length, as precise as those of base, in place of those of the same id.

    order: a column of delta that tells which vector of an id comes last, where ids repeat in delta.
    """
    last = delta if order is None else latest(delta, order)
    return upsert(base.select("id", "dim", "vec"), unit_vectors(last, dict(base.dtypes)["vec"]), ["id"])


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is wanted; Spark broadcasts the ids while they are small."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")
