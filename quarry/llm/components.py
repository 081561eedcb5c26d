"""Connected components of an undirected graph of long ids: union-find on blocks of edges, then alternating stars.

A task contracts at most about LOCAL edges to a forest of stars, in memory of that bound. Edges that
fit in one block are done then; more of them go through alternating stars, contracted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Alternations before giving up; each roughly halves the longest path.
ROUNDS = 60
#: Edges that one task contracts.
LOCAL = 500_000


def _forest(batches):
    """(a, b) edges to (least node, node) of the components that they make by themselves."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array([find(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node joins the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours join the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(joined.select("m", "b")).filter("x <> y").toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node it reaches.

    Each alternation is checkpointed in the shared folder; minima are taken before the shuffle, so
    a node of many edges costs one row per task. Ends when an alternation changes nothing.
    """
    given = checkpoint(edges.select("a", "b").filter("a <> b"))
    blocks = -(-given.count() // LOCAL)
    if blocks <= 1:
        return given.coalesce(1).mapInArrow(_forest, "a bigint, b bigint").select(F.col("b").alias("node"), F.col("a").alias("component"))
    contracted = given.repartition(blocks).mapInArrow(_forest, "a bigint, b bigint")
    now, last = checkpoint(contracted.filter("a < b").distinct()), None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == last or not state["n"]:
            return now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component").union(now.select("a", "a").distinct())
        last = state
        now = checkpoint(_small_star(_large_star(now).distinct()).distinct())
    raise RuntimeError("components did not settle")
