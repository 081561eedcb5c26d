"""Segmented tables: changes equal a rebuild, writers meet, older versions are migrated."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import extract, fts
from quarry.plans.engine import Engine
from quarry.sources import snapshot

WORDS = "alpha beta gamma delta load_user foo.bar x1 Größe".split()


def test_search_equals_a_rebuild_after_any_changes(spark, tmp_path, monkeypatch):
    """Random upserts, deletes and merges of documents; postings, statistics and ranks are those of an index made at once."""
    monkeypatch.setattr(snapshot, "FAN", 3)
    monkeypatch.setattr(snapshot, "LEAST_ROWS", 10)
    tables, held, rng = snapshot.Snapshots(spark, str(tmp_path)), {}, random.Random(2)
    queries = spark.createDataFrame([(1, "alpha foo.bar"), (2, "load_user gam"), (3, "Größe beta")], "query_id long, query string")
    for step in range(7):
        fresh = {f"d{rng.randint(0, 12)}": " ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(rng.choice([1, 1, 5]))}
        gone = {f"d{rng.randint(0, 12)}" for _ in range(rng.choice([0, 1, 3]))} - set(fresh)
        held = {k: v for k, v in held.items() if k not in gone} | fresh
        rows = spark.createDataFrame(list(fresh.items()), "id string, content string")
        touched = spark.createDataFrame([(i,) for i in {*fresh, *gone}], "id string")
        tables.commit({"postings": (fts.postings(rows), touched), "stats": (fts.doc_stats(rows), touched)})
        if step % 3 == 2:
            tables.merge()
    entry = tables._manifest()["tables"]["postings"]
    assert len(entry["segments"]) < 7  # some were merged
    now = spark.createDataFrame([(k, "text_file", v) for k, v in held.items()], "id string, type string, content string")
    for made, name in ((fts.postings(now), "postings"), (fts.doc_stats(now), "stats")):
        assert sorted(map(str, tables.table(name).collect())) == sorted(str(r) for r in made.select(*tables.table(name).columns).collect())
    ranks = lambda **more: sorted((r["query_id"], r["rank"], r["id"], round(r["bm25"], 9)) for r in fts.search(now, queries, 5, **more).collect())
    assert ranks(index=(tables.table("postings"), tables.table("stats"))) == ranks()
    assert tables.optimise() == 2 and tables.optimise() == 0
    entry = tables._manifest()["tables"]["postings"]
    assert len(entry["segments"]) == 1 and not entry["dead"]
    assert ranks(index=(tables.table("postings"), tables.table("stats"))) == ranks()


def test_size_classes():
    s = lambda rows, seq: {"path": str(seq), "seq": seq, "rows": rows}
    many = [s(10, i) for i in range(4)]
    assert snapshot.due({"segments": [s(10**6, 9), *many], "dead": []}) == many
    assert snapshot.due({"segments": [s(10**6, 9), *many[:3]], "dead": []}) == []
    assert len(snapshot.due({"segments": [s(10**6, 9), *many[:2]], "dead": [{"path": "d", "seq": 9, "rows": 10**6}]})) == 3


def _edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], snapshot.SCHEMAS["edges"])


def test_no_update_of_two_writers_is_lost(spark, tmp_path):
    one, two = snapshot.Snapshots(spark, str(tmp_path)), snapshot.Snapshots(spark, str(tmp_path))
    one.commit(edges=_edges(spark, ("a", "b")))
    old = one.table("edges")
    two.commit({"edges": (_edges(spark, ("c", "d")), spark.createDataFrame([("c",)], "id string"))})
    with pytest.raises(snapshot.Conflict):  # it was made of what is no longer there
        one.commit(edges=old.union(_edges(spark, ("e", "f"))))
    # a change of other keys that reads nothing goes on top
    one._seen.clear()
    two.commit({"edges": (_edges(spark, ("k", "l")), spark.createDataFrame([("k",)], "id string"))})
    one.commit({"edges": (_edges(spark, ("g", "h")), spark.createDataFrame([("g",)], "id string"))})
    runs = []

    def work():
        runs.append(1)
        now = one.table("edges")
        if len(runs) == 1:
            two.put("k2", "v2")  # no conflict by itself
            two.commit({"edges": (_edges(spark, ("i", "j")), spark.createDataFrame([("i",)], "id string"))})
        one.commit(meta={"k1": "v1"}, edges=now.union(_edges(spark, ("e", "f"))))

    one.attempt(work)
    assert len(runs) == 2
    assert {r["from_id"] for r in two.table("edges").collect()} == {"a", "c", "e", "g", "i", "k"}
    assert (two.get("k1"), two.get("k2")) == ("v1", "v2")
    taken = max(int(n[9:-5]) for n in one.files.names() if n.startswith("manifest-"))
    assert not one.files.create(f"manifest-{taken:012d}.json", "{}")
    assert not [n for n in one.files.names() if n.endswith(".part")]


def test_calls_of_changed_names_alone_equal_a_full_run(spark):
    rng = random.Random(6)
    symbol = lambda name, calls: (name, "function", 1, f"{name} {calls}", calls)
    kinds = "id string, type string, content string, hash string"

    def make(ids):
        files = {i: [symbol(f"f{rng.randint(0, 7)}", [f"f{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 3))] for i in ids}
        return {i: (s, [rng.choice(["os", "d0/x1", "re"])] if rng.random() < 0.5 else []) for i, s in files.items()}

    frame = lambda held: spark.createDataFrame([(i, *x) for i, x in held.items()], snapshot.PARSED)
    texts = lambda held: spark.createDataFrame([(i, "go_file", str(x), "h") for i, x in held.items()], kinds)
    held = make([f"d{k % 3}/x{k}" for k in range(12)] + ["root1"])
    tables = dict(zip(("nodes", "edges"), (x.collect() for x in extract.graph(texts(held), frame(held))), strict=True))
    for _ in range(2):
        fresh, gone = make(rng.sample(sorted(held), 2) + [f"d1/new{rng.random()}"]), set(rng.sample(sorted(held), 2))
        after = {i: x for i, x in held.items() if i not in gone} | {i: x for i, x in fresh.items() if i not in gone}
        touched = spark.createDataFrame([(i,) for i in {*fresh, *gone}], "id string")
        there = {i: x for i, x in fresh.items() if i not in gone}
        made = extract.graph_changes(texts(after).select("id"), texts(there), touched, frame(held), frame(after))
        full = dict(zip(("nodes", "edges"), extract.graph(texts(after), frame(after)), strict=True))
        for name, key in (("nodes", "id"), ("edges", "from_id")):
            rows, keys = made[name]
            replaced = {r[0] for r in keys.collect()}
            tables[name] = [r for r in tables[name] if r[key] not in replaced] + rows.collect()
            assert sorted(map(str, tables[name])) == sorted(map(str, full[name].collect())), name
        held = after


def test_one_changed_file_writes_what_changed(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for k in range(30):
        (root / f"f{k}.py").write_text(f"def own_{k}():\n    return helper_{k}\n" + "text of a file\n" * 20 + "lorem ipsum\n" * (k % 2))
    engine = Engine(spark, str(tmp_path / "index"), str(root))
    engine.index()
    before = engine.tables._manifest()["tables"]
    (root / "f3.py").write_text("def other():\n    return own_4()\n")
    assert engine.index() == 1
    after = engine.tables._manifest()["tables"]
    for name in ("nodes", "edges", "parsed", "postings", "stats"):
        assert after[name]["segments"][0] == before[name]["segments"][0]
        rows = sum(s["rows"] for s in after[name]["segments"][1:]) + sum(d["rows"] for d in after[name]["dead"])
        assert 0 < rows <= 12, name
    assert after["neighbours"] == before["neighbours"]
    assert (int(engine.tables.get("docs")), int(engine.tables.get("terms"))) == tuple(engine.tables.table("stats").agg(F.count("*"), F.sum("dl")).first())
    assert any("f3.py" in x for x in engine.search("other")) and not any("f3.py" in x for x in engine.search("own_3"))


def test_older_versions_are_migrated(spark, tmp_path):
    root, at = tmp_path / "tree", tmp_path / "index"
    root.mkdir()
    (root / "a.py").write_text("def zeppelin():\n    pass\n")
    made = Engine(spark, str(at), str(root))
    made.index()
    paths = {name: made.tables._manifest()["tables"][name]["segments"][0]["path"] for name in ("nodes", "edges", "parsed")}
    for n in made.tables.files.names():
        if n.startswith("manifest-"):
            (at / n).unlink()
    # version 5 had one folder for each table, a file that points to them, and no postings
    (at / "current.json").write_text(json.dumps({"version": 5, "tables": paths, "meta": {"head": ""}}))
    old = Engine(spark, str(at), str(root))
    assert old.nodes().count() == 2 and not old.search("zeppelin")
    assert old.index() == 1 and old.search("zeppelin") and old.index() == 0
    assert snapshot.migrated({"version": 6, "tables": {"edges": "p"}, "meta": {}})["tables"]["edges"]["segments"] == [{"path": "p", "seq": 0, "rows": None}]
