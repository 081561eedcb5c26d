"""Retrieval metrics over (query_id, rank, file) and ground truth (query_id, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(retrieved: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """query_id, hits, precision, recall, mrr and ndcg at k; queries without hits count as 0."""
    asked = truth.select("query_id", "file").distinct()
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    top = retrieved.filter(F.col("rank") <= k).groupBy("query_id", "file").agg(F.min("rank").alias("rank"))
    hits = top.join(asked, ["query_id", "file"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = sizes.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), zero(F.col("hits") / k).alias("precision"), zero(F.col("hits") / F.col("n_truth")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def summary(rows: DataFrame) -> DataFrame:
    """Means, extremes and medians (midpoint of an even count) of each metric, one row per metric."""
    names = [c for c in ("precision", "recall", "mrr", "ndcg") if c in rows.columns]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.median("v").alias("median"))


def density(used: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, tokens, useful (the first node of each true file counts) and density, their ratio;
    used has query_id, file, rank, tokens."""
    from pyspark.sql import Window

    by = Window.partitionBy("query_id", "file").orderBy("rank")
    first = used.withColumn("n", F.row_number().over(by)).join(truth.select("query_id", "file").distinct().withColumn("true", F.lit(True)), ["query_id", "file"], "left")
    useful = F.sum(F.when(F.col("true") & (F.col("n") == 1), F.col("tokens")).otherwise(0))
    return first.groupBy("query_id").agg(F.sum("tokens").alias("tokens"), useful.alias("useful")).withColumn("density", F.when(F.col("tokens") > 0, F.col("useful") / F.col("tokens")).otherwise(0.0))


def harmonic(p, d):
    return F.when(p + d > 0, 2 * p * d / (p + d)).otherwise(0.0)


def efficiency(rows: DataFrame, used: DataFrame, raw: DataFrame, budget: int = 4000) -> DataFrame:
    """rows (per_query) with tokens, within (the budget), ratio and compression, and efficiency.

    used: query_id, tokens and density; raw: query_id and raw_tokens, those of the whole files that were named. ratio is
    tokens / raw tokens and compression 1 - ratio, both null without raw tokens; efficiency is the harmonic mean of
    precision and density where compression is positive.
    """
    out = rows.join(used.select("query_id", "tokens", "density"), "query_id", "left").join(raw, "query_id", "left")
    out = out.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "density": F.coalesce("density", F.lit(0.0))})
    out = out.withColumns({"within": F.col("tokens") <= budget, "ratio": F.when(F.col("raw_tokens") > 0, F.col("tokens") / F.col("raw_tokens"))})
    out = out.withColumn("compression", 1 - F.col("ratio"))
    return out.withColumn("efficiency", F.when(F.col("compression") > 0, harmonic(F.col("precision"), F.col("density"))))


def totals(rows: DataFrame) -> DataFrame:
    """One row of means (3 places): n, tokens, pass_percent within the budget; ratio over the queries that have one;
    compression, density and efficiency over those with positive compression."""
    squeezed = F.col("compression") > 0
    mean = lambda c, when=None: F.round(F.coalesce(F.avg(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0.0)), 3).alias(c)
    return rows.agg(F.count("*").alias("n"), mean("tokens"), F.round(100 * F.avg(F.col("within").cast("int")), 3).alias("pass_percent"), mean("ratio"), mean("compression", squeezed), mean("density", squeezed), mean("efficiency", squeezed))


def report(rows: DataFrame, columns: list[str] | None = None, width: int = 12, most: int = 10_000) -> str:
    """A fixed-width table of at most `most` rows: names, then values, text cut to the width."""
    columns = columns or rows.columns
    shown = lambda x: f"{x:.3f}" if isinstance(x, float) else "" if x is None else str(x)
    lines = [columns, *([shown(x) for x in r] for r in rows.select(*columns).limit(most).collect())]
    return "\n".join(" ".join(x[:width].ljust(width) for x in line).rstrip() for line in lines)
