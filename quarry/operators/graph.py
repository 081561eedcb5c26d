"""Property-graph operators: breadth-first traversal, containment, call resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import bucketed
from .settle import settled as _settled


#: Nodes of a frontier that are broadcast to the edges; more are dealt by node, to edges that are dealt so once for all levels.
BROADCAST_FRONTIER = 200_000


class Adjacency:
    """Edges whose levels of a walk move the frontier alone.

    A small frontier goes to the edges where they lie. At the first level with a larger one, edges are written once in
    buckets by from_id, and frontiers are dealt to those; out-edges of a node that are more than the share of a task lie in
    several buckets, which its frontier row goes to.
    """

    def __init__(self, edges: DataFrame):
        self.edges, self._dealt = edges, None
        spark = edges.sparkSession
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def _laid(self) -> tuple[DataFrame, DataFrame]:
        """The edges by (from_id, slot), and (from_id, slots) of nodes in several slots."""
        if self._dealt is None:
            degree = self.edges.groupBy("from_id").agg(F.count("*").alias("n"))
            most = max(10_000, (degree.agg(F.sum("n")).first()[0] or 0) // (4 * self.parts))
            # at most four for each part
            hubs = _settled(degree.filter(F.col("n") > most).select("from_id", F.ceil(F.col("n") / most).cast("int").alias("slots")))
            slot = F.pmod(F.xxhash64("to_id", "relation_type"), F.coalesce("slots", F.lit(1))).cast("int")
            laid = self.edges.join(F.broadcast(hubs), "from_id", "left").select("from_id", slot.alias("slot"), "to_id", "relation_type")
            self._dealt = bucketed(laid, self.parts, "from_id", "slot"), hubs
        return self._dealt

    def step(self, frontier: DataFrame, size: int) -> DataFrame:
        """The out-edges of a frontier (id, ...) of so many rows."""
        front = frontier.withColumnRenamed("id", "from_id")
        if size <= BROADCAST_FRONTIER:
            return self.edges.join(F.broadcast(front), "from_id")
        laid, hubs = self._laid()
        spread = front.join(F.broadcast(hubs), "from_id", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
        return laid.join(spread.hint("shuffle_hash"), ["from_id", "slot"]).drop("slot")


def walk(edges: DataFrame | Adjacency, seeds: DataFrame, depth: int) -> DataFrame:
    """from_id, to_id, relation_type and depth (least number of hops from a seed) of edges within reach.

    Only newly reached nodes are expanded, which yields the same least depths as all walks would.
    seeds has a column id; with a column query_id as well, every query walks on its own.
    """
    key = ["query_id"] if "query_id" in seeds.columns else []
    near = edges if isinstance(edges, Adjacency) else Adjacency(edges)
    frontier, found = _settled(seeds.select(*key, "id").distinct()), None
    seen = frontier
    for level in range(1, depth + 1):
        size = frontier.count()
        if level > 1 and not size:
            break
        step = near.step(frontier, size).select(*key, "from_id", "to_id", "relation_type", F.lit(level).cast("bigint").alias("depth")).distinct()
        step = _settled(step)
        found = step if found is None else found.unionByName(step)
        if level < depth:
            frontier = _settled(step.select(*key, F.col("to_id").alias("id")).distinct().join(seen, [*key, "id"], "left_anti"))
            seen = seen.unionByName(frontier)
    return found


def _first(found: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first rows in an order, or all rows in none."""
    return found if limit is None else found.orderBy(*order).limit(limit)


def trace(edges: DataFrame, start: str, depth: int, limit: int | None = 10_000) -> DataFrame:
    """The first edge of each pair of nodes within reach, by depth, then relation; limit None: all of them, unsorted."""
    seeds = edges.sparkSession.createDataFrame([(start,)], "id string")
    by = Window.partitionBy("from_id", "to_id").orderBy("depth", "relation_type")
    first = walk(edges, seeds, depth).withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")
    return _first(first, limit, "depth", "from_id", "to_id")


def trace_nodes(edges: DataFrame, start: str, depth: int, limit: int | None = 10_000) -> DataFrame:
    """start and the ids of the nodes that its trace touches."""
    found = trace(edges, start, depth, limit)
    begin = edges.sparkSession.createDataFrame([(start,)], "id string")
    return found.select(F.explode(F.array("from_id", "to_id")).alias("id")).union(begin).distinct()


def trace_many(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = 50_000) -> tuple[DataFrame, DataFrame]:
    """Edges with least depth, and hops (id, hop) of what they reach other than by containment;
    children of what is reached by `contains` then take their parent's hop."""
    key = ["query_id"] if "query_id" in seeds.columns else []
    found = walk(edges, seeds, depth).groupBy(*key, "from_id", "to_id", "relation_type").agg(F.min("depth").alias("depth"))
    if not key:
        found = _first(found, limit, "depth", "from_id", "to_id", "relation_type")
    hops = found.filter("relation_type <> 'contains'").groupBy(*key, F.col("to_id").alias("id")).agg(F.min("depth").alias("hop"))
    inside = found.filter("relation_type = 'contains'").select(*key, F.col("from_id").alias("parent"), F.col("to_id").alias("id")).join(hops.withColumnRenamed("id", "parent"), [*key, "parent"]).select(*key, "id", "hop")
    inside = inside.join(hops.select(*key, "id"), [*key, "id"], "left_anti").groupBy(*key, "id").agg(F.min("hop").alias("hop"))
    return found, hops.unionByName(inside)


def resolve_calls(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls edges for pending (caller, dir, callee) among symbols (id, name, dir).

    One symbol of that name in the caller's directory wins; with none there, a single one anywhere
    wins unless the caller is at the root; otherwise the call stays unresolved. Two entries of one
    id count as two. Candidates are counted per name before the join, so common names stay narrow.
    Nothing is broadcast by estimate: symbols come from explodes, which multiply rows and not their estimates.
    """
    local = symbols.groupBy("name", "dir").agg(F.count("*").alias("n_here"), F.min("id").alias("here"))
    anywhere = symbols.groupBy("name").agg(F.count("*").alias("n_all"), F.min("id").alias("any"))
    joined = pending.join(local.hint("merge"), (F.col("callee") == local["name"]) & (pending["dir"] == local["dir"]), "left").select(pending["caller"], pending["dir"], "callee", "n_here", "here")
    joined = joined.join(anywhere.hint("merge"), F.col("callee") == F.col("name"), "left")
    target = F.when(F.col("n_here") == 1, F.col("here")).when(F.col("n_here").isNull() & (F.col("n_all") == 1) & (F.col("dir") != "(root)"), F.col("any"))
    return joined.select(F.col("caller").alias("from_id"), target.alias("to_id"), F.lit("calls").alias("relation_type")).filter("to_id is not null and to_id <> from_id").distinct()
