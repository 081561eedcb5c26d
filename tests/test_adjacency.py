"""Walks over edges that lie in buckets: results as over plain edges, and plans that move the frontier alone."""

import random
import re

from pyspark.sql import functions as F

from quarry.operators import graph, settle


def test_bucketed_levels_equal_broadcast_levels(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hub" if rng.random() < 0.4 else f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 200)}", rng.choice(["calls", "imports", "contains"])) for _ in range(2000)]
    edges = spark.createDataFrame(rows + [(None, "n1", "calls"), ("n1", None, "calls")], "from_id string, to_id string, relation_type string").distinct()
    seeds = spark.createDataFrame([(1, "n1"), (2, "n3"), (2, "hub"), (2, "hub"), (3, "nowhere")], "query_id long, id string")
    want = sorted(map(str, graph.walk(edges, seeds, 3).collect()))
    assert len(want) > 2000
    monkeypatch.setattr(graph, "BROADCAST_FRONTIER", 0)
    near = graph.Adjacency(edges)
    monkeypatch.setattr(near, "parts", 3)
    assert sorted(map(str, graph.walk(near, seeds, 3).collect())) == want
    assert sorted(map(str, graph.walk(near, seeds.limit(0), 3).collect())) == []

    frontier = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.concat(F.lit("n"), "id").alias("id"))
    plan = near.step(frontier, 1000)._jdf.queryExecution().executedPlan().toString()
    edge_side = plan[plan.index(":- ") : plan.index("+- Exchange hashpartitioning")]
    assert "Bucketed: true" in edge_side and "Exchange" not in edge_side
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    path = settle._outer.tables[-1][2]
    with settle.holding():  # another block frees nothing of this one
        settle.stored(spark.range(3))
    assert settle._outer.tables[-1][2] == path and near.step(frontier, 1000).count() > 0
    settle.release()
    assert not settle._outer.tables and not [t for t in spark.catalog.listTables() if t.name.startswith("quarry_")]
    if path:
        assert not spark.sparkContext._jvm.java.io.File(path).exists()
