"""The context pipeline for batches of queries: search, score, fuse, expand, rank, threshold, fill."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, fts, graph, nav, rank, vector
from ..operators.settle import settled


@dataclass(frozen=True)
class Config:
    """Limits of the pipeline; the defaults are fixed values of the interface."""

    files: int = 200
    depth: int = 2
    budget: int = 4000
    dense: int = 10
    share: float = 0.25
    seeds: int = 30
    branches: int = 8

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "spark.quarry.") -> Config:
        """The settings of a session; those that are absent, no number or not positive keep their defaults."""
        found = {}
        for f in fields(cls):
            kind = type(f.default)
            try:
                value = kind(spark.conf.get(prefix + f.name, str(f.default)))
            except ValueError:
                continue
            if value > 0:
                found[f.name] = value
        return cls(**found)


Index = tuple[DataFrame, ...]


def candidates(nodes: DataFrame, edges: DataFrame, queries: DataFrame, cfg: Config = Config(), vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """Ranked candidates of each query: query_id, id, type, score, source, boost, total, rank.

    A column expanded of queries, where there is one, is searched in place of query; coverage is that of the query's own
    tokens in any case. index: stored postings and statistics of the nodes, which are then not searched by their texts.
    """
    asked = queries.select("query_id", F.col("expanded" if "expanded" in queries.columns else "query").alias("query"), T.tokenise_query(F.col("query")).alias("tokens"))
    found = rank.score_text(fts.search(nodes, asked, cfg.files, index=index), nodes, asked)
    if vectors is not None and query_vectors is not None:
        near = vector.top_cosine(vectors, query_vectors, cfg.dense).withColumn("id", T.file_id(F.col("id")))
        found = rank.fuse_dense(found, near, nodes)
    found = settled(found)  # seeds and scores both read it
    _, hops = graph.trace_many(edges, rank.seeds(found, cfg.seeds), cfg.depth)
    return rank.ranked(rank.expand_graph(found, settled(hops), nodes.select("id", "type")))


def shown(rows: DataFrame) -> DataFrame:
    """rows (id, type, content) with soft and hard, the short forms of their contents; Go files by their outline."""
    outlines = extract.outlines(rows.select("id", "type", "content"), 60)
    code = F.coalesce("outline", F.when(F.col("type") == "py_file", T.signatures(F.col("content"), 60)).otherwise(T.truncate_lines(F.col("content"), 60)))
    soft = T.compress(F.col("id"), F.col("type"), F.col("content"), code)
    return rows.join(outlines, "id", "left").withColumns({"soft": soft, "hard": T.compress_hard(F.col("id"), F.col("type"), F.col("content"))}).drop("outline")


def build(nodes: DataFrame, edges: DataFrame, queries: DataFrame, cfg: Config = Config(), vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """query_id, rank, id, type, source, score (4 places), form, tokens, used and truncated."""
    ranks = settled(candidates(nodes, edges, queries, cfg, vectors, query_vectors, index).filter("id is not null"))
    kept = settled(rank.threshold(ranks, cfg.share).select("query_id", "rank", "id", "type", "source", "score", "dropped"))
    # each node is cut once, however many queries it answers
    held = nodes.select("id", "type", "content").join(fts._bounded(kept.select("id").distinct(), kept.count()), "id", "left_semi")
    sizes = shown(held).select("id", T.estimate_tokens(F.col("soft")).alias("soft"), T.estimate_tokens(F.col("hard")).alias("hard"))
    kept = settled(kept.join(sizes, "id"))
    filled = rank.fill_budget(kept.select("query_id", "rank", "id", "soft", "hard"), cfg.budget)
    counts = kept.groupBy("query_id").agg(F.count("*").alias("n_kept"), F.max("dropped").alias("dropped"))
    fitted = filled.groupBy("query_id").agg(F.count("*").alias("n_filled"))
    truncated = counts.join(fitted, "query_id", "left").select("query_id", (F.col("dropped") | (F.coalesce("n_filled", F.lit(0)) < F.col("n_kept"))).alias("truncated"))
    out = filled.join(kept.select("query_id", "id", "type", "source", "score"), ["query_id", "id"]).join(truncated, "query_id")
    return out.select("query_id", "rank", "id", "type", "source", F.round("score", 4).alias("score"), "form", "tokens", "used", "truncated")


def contents(built: DataFrame, nodes: DataFrame) -> DataFrame:
    """Built rows with the text they stand for."""
    forms = shown(nodes.select("id", "type", "content").join(built.select("id").distinct(), "id", "left_semi")).select("id", "soft", "hard")
    return built.join(forms, "id").withColumn("content", F.when(F.col("form") == "soft", F.col("soft")).otherwise(F.col("hard"))).drop("soft", "hard")


def baseline(nodes: DataFrame, queries: DataFrame, k: int = 200, index: Index | None = None) -> DataFrame:
    """Distinct files of the plain search in order."""
    hits = fts.search(nodes, queries, k, files_only=False, index=index).withColumn("file", T.file_id(F.col("id")))
    return hits.groupBy("query_id", "file").agg(F.min("rank").alias("rank"))


def branches(nodes: DataFrame, built: DataFrame, k: int = 8) -> DataFrame:
    files = nodes.filter(F.col("type").like("%_file"))
    return nav.branches(files, built.select("query_id", T.file_id(F.col("id")).alias("id")), nav.symbol_counts(nodes), k)
