"""The stored index of vectors finds what brute force finds."""

import numpy as np

from quarry.operators import clusters, settle, vector


def test_rings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(int(i), (centres[i % 12] + rng.normal(size=8) * 0.3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # equal vectors are more than a block
    rows += [(2000, [0.0] * 8), (2001, [1e-9] * 8), (2002, None), (2003, [1.0, 2.0]), (2004, [])]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rows[i][1]) for i in (0, 7, 100, 500)] + [(-1, [0.0] * 8), (-2, None), (-3, [1.0])], "query_id long, vec array<double>")
    index = clusters.build(vectors)
    shape = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["cosine"], 9)) for r in df.collect())
    for k in (3, 40):
        found, read = clusters.search(index, queries, k)
        assert shape(found) == shape(vector.top_cosine(vectors, queries, k))
        counts = {r["query_id"]: r["n_read"] for r in read.collect()}
        assert set(counts) == {0, 7, 100, 500, -1, -3} and max(counts.values()) <= 964
        assert sum(counts[i] for i in (0, 7, 100, 500)) < 0.6 * 4 * 964  # the rest is pruned
    monkeypatch.setattr(clusters, "BROADCAST_QUERIES", 2)
    assert shape(clusters.search(index, queries, 3)[0]) == shape(vector.top_cosine(vectors, queries, 3))
    monkeypatch.undo()
    none = clusters.build(vectors.limit(0))
    assert clusters.search(none, queries, 3)[0].count() == 0
    assert clusters.search(index, queries.limit(0), 3)[0].count() == 0
    settle.release()
