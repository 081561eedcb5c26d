"""Retrieval quality over evaluation cases: the context pipeline and the plain search side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics
from ..operators.settle import settled
from . import context


def files_of(built: DataFrame) -> DataFrame:
    """query_id, file and rank: distinct files in the order in which the answer names them."""
    first = built.withColumn("file", T.file_id(F.col("id"))).groupBy("query_id", "file").agg(F.min("rank").alias("first"), F.sum("tokens").alias("tokens"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "file")))


def efficiency(nodes: DataFrame, edges: DataFrame, cases: DataFrame, k: int = 5, cfg: context.Config = context.Config(), index: context.Index | None = None) -> DataFrame:
    """Per case: retrieval metrics, tokens, whether they are within the budget, density, compression and efficiency; metrics.totals sums them up."""
    asked = cases.select(F.col("id").alias("query_id"), "query")
    truth = cases.select(F.col("id").alias("query_id"), F.explode("ground_truth_files").alias("file"))
    built = settled(context.build(nodes, edges, asked, cfg, index=index))
    used = metrics.density(built.select("query_id", T.file_id(F.col("id")).alias("file"), "rank", "tokens"), truth)
    named = built.select("query_id", T.file_id(F.col("id")).alias("id")).distinct().join(nodes.select("id", T.estimate_tokens(F.col("content")).alias("n")), "id")
    raw = named.groupBy("query_id").agg(F.sum("n").alias("raw_tokens"))
    return metrics.efficiency(metrics.per_query(files_of(built), truth, k), used, raw, cfg.budget)


def evaluate(nodes: DataFrame, edges: DataFrame, cases: DataFrame, k: int = 5, cfg: context.Config = context.Config(), index: context.Index | None = None) -> DataFrame:
    """One row per metric (mean, least, most, median) of cases (id, query, ground_truth_files)."""
    asked = cases.select(F.col("id").alias("query_id"), "query")
    truth = cases.select(F.col("id").alias("query_id"), F.explode("ground_truth_files").alias("file"))
    return metrics.summary(metrics.per_query(files_of(context.build(nodes, edges, asked, cfg, index=index)), truth, k))
