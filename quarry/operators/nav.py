"""Directory roll-ups and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract
from .settle import places, settled


def symbol_counts(nodes: DataFrame) -> DataFrame:
    """dir and n_symbols of ids with a colon."""
    return nodes.filter(F.instr("id", ":") > 0).groupBy(T.directory(F.col("id")).alias("dir")).agg(F.count("*").alias("n_symbols"))


def branches(files: DataFrame, covered: DataFrame, symbols: DataFrame, k: int = 8) -> DataFrame:
    """Directories with files that an answer leaves out: dir, n_files, n_covered, n_symbols, summary; the k largest.

    With query_id in covered, every query has branches of its own. Only directories that an answer covers whole drop
    out of the order by size, so k more than the most that any answer covers are enough for all of them, and each
    query meets that short list instead of all directories. Samples are the five first files, cut per task by
    rank before they meet.
    """
    key = ["query_id"] if "query_id" in covered.columns else []
    placed = files.select("id", T.directory(F.col("id")).alias("dir"))
    totals = settled(placed.groupBy("dir").agg(F.count("*").alias("n_files")))
    have = settled(covered.select(*key, "id").distinct().join(placed, "id").groupBy(*key, "dir").agg(F.count("*").alias("n_covered")))
    whole = have.join(totals, "dir").filter("n_covered >= n_files").groupBy(*key).agg(F.count("*").alias("n"))
    spare = whole.agg(F.max("n")).first()[0] or 0
    largest = totals.orderBy(F.desc("n_files"), "dir").limit(k + spare)
    if key:
        # one row, an array of k + spare directories
        listed = largest.agg(F.collect_list(F.struct("dir", "n_files")).alias("dirs"))
        base = covered.select("query_id").distinct().join(F.broadcast(listed)).select("query_id", F.inline("dirs"))
    else:
        base = largest
    open_ = base.join(have, [*key, "dir"], "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0))).filter("n_covered < n_files")
    by = Window.partitionBy(*(key or [F.lit(0)])).orderBy(F.desc("n_files"), "dir")
    kept = open_.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    sampled = placed.join(F.broadcast(largest.select("dir")), "dir", "left_semi")
    first = sampled.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("id"))).filter("n <= 5").groupBy("dir").agg(F.sort_array(F.collect_list("id")).alias("names"))
    out = kept.join(first, "dir").join(symbols, "dir", "left")
    return out.select(*key, "dir", "n_files", "n_covered", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), T.directory_summary(F.col("names")).alias("summary"), "rank")


def below(prefix: str) -> Column:
    """Whether an id begins with the prefix; (root) stands for files without a directory."""
    return ~F.col("id").contains("/") if prefix == "(root)" else F.col("id").startswith(prefix)


def drill(nodes: DataFrame, prefix: str, most_lines: int = 120) -> DataFrame:
    """drill_down with Go files by their outline, and rank by id."""
    files = nodes.filter(F.col("type").like("%_file") & below(prefix))
    found = settled(drill_down(nodes, prefix, most_lines, extract.outlines(files, most_lines)))
    return places(found, "id", "rank")


def drill_down(nodes: DataFrame, prefix: str, most_lines: int = 120, outlines: DataFrame | None = None) -> DataFrame:
    """Files whose id starts with prefix ((root): those without a directory), outlined, with token estimates.

    The prefix is literal and not bound to a directory; the predicate reaches the scan. outlines (id, outline): what
    stands for files that have one.
    """
    files = nodes.filter(F.col("type").like("%_file"))
    found = files.filter(below(prefix))
    shown = F.when(F.col("type") == "py_file", T.signatures(F.col("content"), most_lines)).otherwise(T.truncate_lines(F.col("content"), most_lines))
    if outlines is not None:
        found = found.join(outlines, "id", "left")
        shown = F.coalesce("outline", shown)
    return found.select("id", "type", shown.alias("content"), T.estimate_tokens(shown).alias("tokens"), F.lit(1.0).alias("score"), F.lit("drill").alias("source"))
