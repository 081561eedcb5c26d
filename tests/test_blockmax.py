"""Early termination finds what a full search finds."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from quarry.operators import blockmax, fts, settle


def test_blocks_equal_a_full_search(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["load_user", "foo.bar", "rare", "Größe"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"d{i:03d}", rng.choice(["go_file", "text_file", "function"]), " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 10, 60])))) for i in range(300)]
    rows += [(f"e{i}", "go_file", "w7 rare foo.bar") for i in range(9)] + [("empty", "go_file", None)]  # ties
    nodes = spark.createDataFrame(rows, "id string, type string, content string").repartition(3)
    queries = spark.createDataFrame([(1, "w7 rare"), (2, "foo.bar load_us"), (3, "w1 w1 w2 unknownword"), (4, "nothing"), (5, "w1"), (6, "Größe w39")], "query_id long, query string")
    index = blockmax.build(nodes, 8)
    shape = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["type"], round(r["bm25"], 9)) for r in df.collect())
    for k, files_only in ((5, True), (30, False)):
        found, read = blockmax.search(index, queries, k, files_only)
        assert shape(found) == shape(fts.search(nodes, queries, k, files_only))
        blocks = {r["query_id"]: (r["n_blocks"], r["n_scored"]) for r in read.collect()}
        assert all(0 < b <= a for a, b in blocks.values()) and 4 not in blocks
        assert k > 5 or sum(b for _, b in blocks.values()) < 0.8 * sum(a for a, _ in blocks.values())
    none = blockmax.build(nodes.limit(0), 8)
    assert blockmax.search(none, queries, 5)[0].count() == 0
    settle.release()


def test_hits_are_not_shuffled(spark, capsys):
    nodes = spark.createDataFrame([(f"d{i}", "go_file", f"w{i % 7} w{i % 3} word") for i in range(50)], "id string, type string, content string")
    found, _ = blockmax.search(blockmax.build(nodes, 8), spark.createDataFrame([(1, "w2 word"), (2, "w5")], "query_id long, query string"), 5)
    capsys.readouterr()
    found.explain()
    dealt = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("phrase" in x or "id#" in x.split("query_id#")[0] for x in dealt)
    settle.release()


def test_blocks_and_batches_are_bounded(spark, monkeypatch):
    """Long documents make blocks of fewer, tasks get few blocks at a time, and results stay."""
    monkeypatch.setattr(blockmax, "BLOCK_TERMS", 500)
    monkeypatch.setattr(blockmax, "SORTED", 1 << 10)
    monkeypatch.setattr(blockmax, "GROUP", 1 << 12)
    rows = [(f"d{i:02d}", "go_file", " ".join(f"w{(i * j) % 11} common" for j in range(120 if i % 3 else 3))) for i in range(60)] + [("long", "go_file", "w1 common " * 900)]
    nodes = spark.createDataFrame(rows, "id string, type string, content string").coalesce(1)
    queries = spark.createDataFrame([(1, "w1 w7"), (2, "common")], "query_id long, query string")
    index = blockmax.build(nodes)
    sizes = [(sum(r["dl"]), len(r["dl"])) for r in index.blocks.select("dl").collect()]
    assert sum(n for _, n in sizes) == 61 and all(terms <= 500 or n == 1 for terms, n in sizes)
    assert sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in index.blocks.inputFiles()) > 1
    shape = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 9)) for r in df.collect())
    assert shape(blockmax.search(index, queries, 9)[0]) == shape(fts.search(nodes, queries, 9, True))
    lengths = lambda df: {r["n"] for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect()}
    with settle.small_batches(spark, 8):
        assert lengths(spark.range(0, 50, 1, 1)) == {8, 2}
    assert lengths(spark.range(0, 50, 1, 1)) == {50}
    settle.release()
