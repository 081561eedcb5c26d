"""Ranking: text scores, dense fusion, graph expansion, thresholds and the token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .settle import settled

#: Decimal places of a score that count: sums that differ by the order of addition are ties.
PLACES = 9
#: Hits that are broadcast to the nodes.
FEW = 1_000_000
DENSE_SHARE, GRAPH_BOOST, GRAPH_SCORE, LEAST_SHARE, SEEDS = 0.25, 0.15, 0.3, 0.25, 30


def node_tokens(nodes: DataFrame) -> DataFrame:
    """id, type and held: the tokens of content and id. Cut once for each node, below the join with its hits."""
    return nodes.select("id", "type", F.array_union(T.token_set(F.col("content")), T.token_set(F.col("id"))).alias("held"))


def score_text(hits: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, bm25) to candidates: (0.5 + min-max of bm25) * type factor * (0.2 + 0.8 coverage).

    queries has query_id and tokens; the range is that of the query's own hits.
    """
    hits = settled(hits.select("query_id", "id", "bm25"))
    few = F.broadcast if hits.count() <= FEW else lambda df: df
    # only nodes with hits are cut to tokens; where hits are few, neither texts nor tokens are shuffled
    held = node_tokens(nodes.join(few(hits.select("id").distinct()), "id", "left_semi"))
    hits = held.join(few(hits), "id")
    w = Window.partitionBy("query_id")
    low, high = F.min("bm25").over(w), F.max("bm25").over(w)
    norm = F.when(high - low <= 1e-9, 1.0).otherwise((F.col("bm25") - low) / (high - low))
    out = hits.join(queries.select("query_id", "tokens"), "query_id").withColumn("coverage", T.term_coverage(F.col("tokens"), F.col("held"))).withColumn("norm", norm)
    score = (0.5 + F.col("norm")) * T.type_factor(F.col("id"), F.col("type")) * (0.2 + 0.8 * F.col("coverage"))
    return out.select("query_id", "id", "type", score.alias("score"), F.lit("fts").alias("source"))


def fuse_dense(candidates: DataFrame, hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds cosine * best text score * 0.25 to candidates, or new ones, of (query_id, id, cosine) hits on files.

    Queries without a text hit stay without candidates: dense hits are never consulted alone.
    """
    best = candidates.filter("source = 'fts'").groupBy("query_id").agg(F.max("score").alias("best"))
    bonus = hits.join(best, "query_id").groupBy("query_id", "id").agg(F.max(F.col("cosine") * F.col("best") * DENSE_SHARE).alias("bonus"))
    joined = candidates.join(bonus, ["query_id", "id"], "full_outer").join(nodes.select("id", F.col("type").alias("node_type")), "id")
    return joined.select("query_id", "id", F.coalesce("type", "node_type").alias("type"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"), F.coalesce("source", F.lit("dense")).alias("source"))


def seeds(candidates: DataFrame, k: int = SEEDS) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "id")
    return candidates.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).select("query_id", "id")


def expand_graph(candidates: DataFrame, hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates with what the graph reaches: (query_id, id, hop) hops.

    A candidate gains 0.15 / ln(hop + 2). A new symbol enters at 0.3 / ln(hop + 2); its file, if a
    candidate, gains the best boost of its symbols, and else enters at its nearest symbol's score. Other
    new nodes enter at 0.3 / ln(hop + 2). Rank uses score + boost.
    """
    decay = F.log(F.col("hop") + F.lit(2.0))
    known = candidates.select("query_id", "id", F.lit(True).alias("known"))
    reached = hops.join(known, ["query_id", "id"], "left").join(nodes.select("id", "type"), "id").withColumn("known", F.coalesce("known", F.lit(False)))
    own = reached.filter("known").select("query_id", "id", (F.lit(GRAPH_BOOST) / decay).alias("boost"))
    fresh = reached.filter("not known").withColumn("file", T.file_id(F.col("id")))
    symbols = fresh.filter(F.col("type").isin(T.SYMBOL_TYPES))
    by_file = symbols.groupBy("query_id", F.col("file").alias("id")).agg(F.min("hop").alias("hop"))
    parents = by_file.join(known, ["query_id", "id"], "left")
    lifted = parents.filter("known").select("query_id", "id", (F.lit(GRAPH_BOOST) / decay).alias("boost"))
    added = parents.filter("known is null").join(nodes.select("id", "type"), "id").select("query_id", "id", "type", "hop").unionByName(fresh.select("query_id", "id", "type", "hop"))
    added = added.groupBy("query_id", "id", "type").agg(F.min("hop").alias("hop")).select("query_id", "id", "type", (F.lit(GRAPH_SCORE) / decay).alias("score"), F.lit("graph").alias("source"), F.lit(0.0).alias("boost"))
    boosts = own.unionByName(lifted).groupBy("query_id", "id").agg(F.max("boost").alias("boost"))
    return candidates.join(boosts, ["query_id", "id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0))).unionByName(added)


def ranked(candidates: DataFrame) -> DataFrame:
    """rank by score + boost + type boost, ties to the smaller id."""
    boost = F.col("boost") if "boost" in candidates.columns else F.lit(0.0)
    out = candidates.withColumn("total", F.col("score") + boost + T.type_boost(F.col("type")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("total", PLACES)), "id")))


def threshold(ranks: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """Candidates of at least a share of their query's best total; dropped says whether any fell below."""
    w = Window.partitionBy("query_id")
    marked = ranks.withColumn("below", F.round("total", PLACES) < F.round(F.max("total").over(w) * share, PLACES))
    return marked.withColumn("dropped", F.max("below").over(w)).filter("not below").drop("below")


def fill_budget(items: DataFrame, budget: int = 4000, at_once: int = 2000) -> DataFrame:
    """Greedy fill in rank order: an item takes its soft size if it fits, else its hard size, else it is skipped.

    items: query_id, rank, id, soft, hard (tokens). Returns query_id, rank, id, tokens, form and used (so far). Each
    round folds the first at_once items of every query, cut by rank in each task; of the others only those
    stay that can still fit into what is left of their query's budget, so few rounds do for any number of items.
    """
    kind = "struct<used:bigint,kept:array<struct<rank:int,id:string,tokens:bigint,form:string,used:bigint>>>"

    def step(acc, x):
        tokens = F.when(acc["used"] + x["soft"] <= budget, x["soft"]).when(acc["used"] + x["hard"] <= budget, x["hard"])
        form = F.when(acc["used"] + x["soft"] <= budget, "soft").otherwise("hard")
        used = acc["used"] + tokens
        entry = F.struct(x["rank"].alias("rank"), x["id"].alias("id"), tokens.alias("tokens"), form.alias("form"), used.alias("used"))
        return F.when(tokens.isNull(), acc).otherwise(F.struct(used.alias("used"), F.concat(acc["kept"], F.array(entry)).alias("kept")).cast(kind))

    by = Window.partitionBy("query_id").orderBy("rank", "id")
    left = items.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.col("soft").cast("bigint").alias("soft"), F.col("hard").cast("bigint").alias("hard"))
    left, out = left.filter(F.least("soft", "hard") <= budget).withColumn("spent", F.lit(0).cast("bigint")), None
    while True:
        left = settled(left)
        first = left.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= at_once)
        listed = first.groupBy("query_id").agg(F.max("spent").alias("spent"), F.sort_array(F.collect_list(F.struct("rank", "id", "soft", "hard"))).alias("items"))
        start = F.struct(F.col("spent").alias("used"), F.array().alias("kept")).cast(kind)
        folded = settled(listed.select("query_id", F.size("items").alias("n"), F.element_at("items", -1).alias("last"), F.aggregate("items", start, step).alias("state")))
        found = folded.select("query_id", F.inline("state.kept"))
        out = found if out is None else out.unionByName(found)
        full = folded.filter(F.col("n") >= at_once).select("query_id", "last", F.col("state.used").alias("now"))
        if full.isEmpty():
            return out
        rest = left.join(full, "query_id").filter(F.struct("rank", "id") > F.struct("last.rank", "last.id")).filter(F.least("soft", "hard") <= budget - F.col("now"))
        left = rest.select("query_id", "rank", "id", "soft", "hard", F.col("now").alias("spent"))
