"""The interactive interface: index a tree, then search, build, trace, drill down and reset.

Tables are kept up to date for what changed: only changed files are parsed, embedded and cut to postings, only calls of
changed names are resolved again, and only those rows are written, as segments of the tables. Searches read the stored
postings; texts are read for what is shown.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cooccur, extract, fts, graph, nav, rank, store
from ..operators.settle import holding, settled
from ..sources import files as sources
from ..sources.snapshot import Snapshots, by_term
from . import context

#: Bytes of a query or symbol, and of a request, at most.
MOST_QUERY_BYTES, MOST_REQUEST_BYTES = 4096, 1 << 20
CONFIRMATION = "yes-delete-all"
#: Changed files from which the pair statistics are made anew.
REBUILT = 100


@dataclass
class Result:
    nodes: list[dict] = field(default_factory=list)
    branches: list[dict] = field(default_factory=list)
    token_estimate: int = 0
    truncated: bool = False
    insufficient: bool = False
    suggested_next: list[str] = field(default_factory=list)
    message: str = ""

    def to_dict(self) -> dict:
        return asdict(self)


def released(method: Callable) -> Callable:
    """The method, which frees what its plans held once its answer is there; with follow_head it indexes first if the
    repository's commit is another than that of the last index."""

    @wraps(method)
    def run(self, *args, **kwargs):
        with holding():
            if self.follow_head and method.__name__ != "index" and self.head_changed():
                self.index()
            return method(self, *args, **kwargs)

    return run


def clamp(value: int, default: int, most: int) -> int:
    return default if value < 1 else min(value, most)


def _checked(text: str, what: str) -> str:
    if not text:
        raise ValueError(f"{what} is empty")
    if len(text.encode()) > MOST_QUERY_BYTES:
        raise ValueError(f"{what} is longer than {MOST_QUERY_BYTES} bytes")
    return text


class Engine:
    """expansion: neighbours that each query term adds to the search; precise: the precise extractors; tracked_only: files that
    git tracks; follow_head: answers index first what another commit changed.

    Plug-in points: embed (texts to vectors of one length), which turns dense retrieval on; parse (path and source to
    symbols and imports) in place of the extractors; vocabulary (a text column to an array of terms) of the pair statistics.
    """

    def __init__(
        self, spark: SparkSession, folder: str, root: str, cfg: context.Config | None = None, expansion: int = 0, precise: bool = False, tracked_only: bool = False, follow_head: bool = False,
        embed: Callable[[list[str]], list[list[float]]] | None = None, parse: Callable[[str, str], tuple[list, list[str]]] | None = None, vocabulary: Callable[[Column], Column] = T.vocabulary_tokens,
    ):
        self.spark, self.tables, self.root, self.cfg, self.expansion = spark, Snapshots(spark, folder), root, cfg or context.Config.of(spark), expansion
        self.follow_head = follow_head
        self.precise, self.tracked_only, self.embed, self.parse, self.vocabulary = precise, tracked_only, embed, parse, vocabulary

    def nodes(self) -> DataFrame:
        return self.tables.table("nodes")

    def edges(self) -> DataFrame:
        return self.tables.table("edges")

    def searched(self) -> context.Index:
        docs, terms = int(self.tables.get("docs") or 0), int(self.tables.get("terms") or 0)
        whole = self.spark.createDataFrame([(docs, terms / docs if docs else None)], "n_docs bigint, avgdl double")
        return self.tables.table("postings"), self.tables.table("stats"), whole

    def init(self) -> dict:
        if self.nodes().isEmpty():
            self.index()
        self.tables.optimise()
        return self.status()

    @released
    def index(self, path: str | None = None) -> int:
        """Indexes path (default: the root); returns how many files are new, changed or gone.

        What other writers commit meanwhile stays: the work starts again on top of it.
        """
        scanned = sources.scan(self.spark, path or self.root, self.root)
        if self.tracked_only:
            scanned = scanned.join(sources.git_tracked(self.spark, self.root), "id", "left_semi")
        scanned = scanned.persist()
        at = "" if path is None else sources.Tree.at(path, self.root).below
        changed = self.tables.attempt(lambda: self._take(scanned, F.lit(True) if not at else (F.col("id") == at) | F.col("id").startswith(at + "/")))
        self.tables.put("head", sources.git_head(self.root))
        scanned.unpersist()
        self.tables.merge()
        return changed

    def _take(self, scanned: DataFrame, below: Column) -> int:
        """Commits what differs between the tables and the scanned files below a path."""
        held = self.nodes().filter("hash <> ''")
        if self.tables.get("reindex"):  # an index of an older version: every file counts as changed
            held = held.withColumn("hash", F.lit("-"))
        seen = settled(store.diff(held.filter(below).select("id", "hash"), scanned.select("id", "hash")).filter("state <> 'same'"))
        changed = seen.count()
        if not changed:
            return 0
        touched = seen.select("id")
        delta = scanned.join(seen.filter("state <> 'deleted'").select("id"), "id", "left_semi")
        before = self.tables.table("parsed")
        fresh = settled(extract.parsed(delta, self.precise, self.parse))
        ids = held.select("id").join(touched, "id", "left_anti").unionByName(delta.select("id"))
        changes = extract.graph_changes(ids, delta, touched, before, before.join(touched, "id", "left_anti").unionByName(fresh))
        changes = {name: tuple(map(settled, pair)) for name, pair in changes.items()}
        nodes, replaced = changes["nodes"]
        changes["parsed"] = fresh, touched
        augmented = F.concat("content", F.lit("\n"), T.index_text(F.col("content"), F.col("id")))
        cut = nodes.select("id", F.when(F.col("hash") != "", augmented).otherwise(F.col("content")).alias("content"))
        changes["postings"] = by_term(fts.postings(cut)), replaced
        stats = settled(fts.doc_stats(cut))
        changes["stats"] = stats, replaced
        if self.embed:
            vectors = store.unit_vectors(self._embedded(delta.select("id", F.col("content").alias("text"))))
            changes["vectors"] = vectors, touched
        known, whole = self.tables.table("neighbours"), {}
        if changed >= REBUILT or known.isEmpty():
            contents = held.join(touched, "id", "left_anti").select("id", "content").unionByName(delta.select("id", "content"))
            whole["neighbours"] = cooccur.document_ppmi(contents.select(self.vocabulary(F.col("content")).alias("terms")), contents.count())
        self.tables.commit(changes, self._totals(stats, replaced) | {"reindex": ""}, **whole)
        return changed

    def _totals(self, stats: DataFrame, replaced: DataFrame) -> dict[str, str]:
        """Nodes and terms of the index with those that come and without those that go."""
        count = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        gone, come = count(self.tables.table("stats").join(replaced, "id", "left_semi")), count(stats)
        return {k: str(int(self.tables.get(k) or 0) + come[i] - gone[i]) for i, k in enumerate(("docs", "terms"))}

    def _embedded(self, texts: DataFrame) -> DataFrame:
        """id and vec of (id, text)."""
        embed = self.embed

        def run(batches):
            for batch in batches:
                yield pd.DataFrame({"id": batch["id"], "vec": [list(map(float, v)) for v in embed(list(batch["text"].fillna("")))]})

        return texts.mapInPandas(run, "id string, vec array<float>")

    def head_changed(self) -> bool:
        head = sources.git_head(self.root)
        return bool(head) and head != self.tables.get("head")

    def _query(self, query: str) -> DataFrame:
        """One query; neighbours of its terms are searched with it, but are no terms of its own."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        if self.expansion:
            terms = asked.select("query_id", T.tokenise_query(F.col("query")).alias("terms"))
            more = cooccur.expand(terms, self.tables.table("neighbours"), self.expansion).withColumnRenamed("terms", "all")
            added = more.join(terms, "query_id").select("query_id", F.array_except("all", "terms").alias("added"))
            asked = asked.join(added, "query_id").select("query_id", "query", F.concat_ws(" ", "query", F.array_join("added", " ")).alias("expanded"))
        return asked

    @released
    def build_context(self, query: str) -> Result:
        _checked(query, "query")
        nodes = self.nodes()
        if nodes.isEmpty():
            return Result(message="the index is empty; call index() first")
        dense = {}
        if self.embed:
            vector = [float(x) for x in self.embed([query])[0]]
            dense = {"vectors": self.tables.table("vectors").select("id", "vec"), "query_vectors": self.spark.createDataFrame([(0, vector)], "query_id long, vec array<double>")}
        built = context.build(nodes, self.edges(), self._query(query), self.cfg, index=self.searched(), **dense)
        built = settled(built)
        rows = context.contents(built, nodes).orderBy("rank").select("id", "type", "content", "score", "source", "tokens", "truncated").collect()
        if not rows:
            return Result(message="nothing matches the query")
        found = context.branches(nodes, built, self.cfg.branches).orderBy("rank").select(F.col("dir").alias("path"), "n_files", "n_symbols", "summary").collect()
        truncated = any(r["truncated"] for r in rows)
        return Result([{k: r[k] for k in ("id", "type", "content", "score", "source")} for r in rows], [r.asDict() for r in found], sum(r["tokens"] for r in rows), truncated, truncated or bool(found), [r["path"] for r in found[:2]])

    @released
    def drill_down(self, path: str) -> Result:
        """Files below a path, as many as the budget holds in order of their ids; what is left out stays on the executors."""
        _checked(path, "path")
        nodes = self.nodes()
        found = nav.drill(nodes, path)
        filled = settled(rank.fill_budget(found.select(F.lit(0).alias("query_id"), "rank", "id", F.col("tokens").alias("soft"), F.col("tokens").alias("hard")), self.cfg.budget))
        total = found.count()
        if not total:
            return Result(message=f"no file begins with {path}")
        rows = found.drop("tokens", "rank").join(filled.select("id", "rank", "tokens"), "id").orderBy("rank").collect()
        covered = nodes.join(filled.select("id"), "id", "left_semi").select(F.lit(0).alias("query_id"), "id")
        left = context.branches(nodes.filter(nav.below(path)), covered, self.cfg.branches).orderBy("rank").select(F.col("dir").alias("path"), "n_files", "n_symbols", "summary").collect()
        truncated = len(rows) < total
        return Result([{k: r[k] for k in ("id", "type", "content", "score", "source")} for r in rows], [r.asDict() for r in left], sum(r["tokens"] for r in rows), truncated, truncated or bool(left), [r["path"] for r in left[:2]])

    @released
    def search(self, query: str, limit: int = 10) -> list[str]:
        """Summary lines of the best nodes of any kind."""
        _checked(query, "query")
        hits = fts.search(self.nodes(), self._query(query).select("query_id", F.col("expanded" if self.expansion else "query").alias("query")), clamp(limit, 10, 100), files_only=False, index=self.searched())
        shown = hits.drop("type").join(self.nodes(), "id")
        return [r[0] for r in shown.orderBy("rank").select(T.summary_line(F.col("id"), F.col("type"), F.col("content"))).collect()]

    @released
    def trace(self, symbol: str, depth: int = 2) -> list[dict]:
        _checked(symbol, "symbol")
        found = graph.trace(self.edges(), symbol, clamp(depth, 2, 5))
        return [r.asDict() for r in found.select("from_id", "to_id", "relation_type").collect()]

    def reset(self, confirm: str = "") -> None:
        if confirm != CONFIRMATION:
            raise ValueError(f"reset needs confirm={CONFIRMATION!r}")
        self.tables.reset()

    def status(self) -> dict:
        return {"nodes": self.nodes().count(), "edges": self.edges().count(), "neighbours": self.tables.table("neighbours").count(), "vectors": self.tables.table("vectors").count(), "head": self.tables.get("head")}

    def handle(self, request: str | bytes) -> str:
        """A JSON request {tool, arguments} to an indented JSON answer; errors of arguments come as {error}."""
        raw = request.encode() if isinstance(request, str) else request
        try:
            if len(raw) > MOST_REQUEST_BYTES:
                raise ValueError(f"a request has at most {MOST_REQUEST_BYTES} bytes")
            asked = json.loads(raw)
            tool, arguments = asked.get("tool"), asked.get("arguments") or {}
            if tool not in TOOLS:
                raise ValueError(f"unknown tool {tool!r}")
            found = getattr(self, tool)(**arguments)
        except (ValueError, TypeError) as error:
            return json.dumps({"error": str(error)}, indent=2)
        return json.dumps(found.to_dict() if isinstance(found, Result) else found, indent=2, ensure_ascii=False)


TOOLS = ("init", "index", "build_context", "drill_down", "search", "trace", "reset", "status")
