"""Search, graph, ranking, store and metric operators on small instances."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions import text as T
from quarry.operators import cooccur, extract, fts, graph, metrics, nav, rank, store, vector
from quarry.plans import context, evaluate

NODE = "id string, type string, content string, hash string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, r) for a, b, r in (p if len(p) == 3 else (*p, "calls") for p in pairs)], "from_id string, to_id string, relation_type string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_walks(spark):
    chain = edges(spark, "ab", "bc", "cd")
    assert {r["to_id"] for r in graph.trace(chain, "a", 2).collect()} == {"b", "c"}
    assert {r["id"] for r in graph.trace_nodes(chain, "a", 2).collect()} == {"a", "b", "c"}
    assert {(r["to_id"], r["depth"]) for r in graph.trace(edges(spark, "ab", "ba"), "a", 10).collect()} == {("b", 1), ("a", 2)}
    _, hops = graph.trace_many(edges(spark, "ab", "bc", "db"), seeds(spark, "a", "d"), 2)
    assert {(r["id"], r["hop"]) for r in hops.collect()} == {("b", 1), ("c", 2)}
    found, hops = graph.trace_many(chain, seeds(spark).limit(0), 2)
    assert found.count() == hops.count() == 0


def test_contains_takes_the_parents_hop(spark):
    _, hops = graph.trace_many(edges(spark, ("a", "f", "imports"), ("f", "f:X", "contains"), ("f", "f:Y", "contains")), seeds(spark, "a"), 2)
    assert {(r["id"], r["hop"]) for r in hops.collect()} == {("f", 1), ("f:X", 1), ("f:Y", 1)}


def test_walks_per_query(spark):
    two = spark.createDataFrame([(1, "a"), (2, "c")], "query_id long, id string")
    _, hops = graph.trace_many(edges(spark, "ab", "bc", "cd"), two, 2)
    assert {tuple(r) for r in hops.collect()} == {(1, "b", 1), (1, "c", 2), (2, "d", 1)}


def test_call_resolution(spark):
    symbols = spark.createDataFrame([("pkg/h.go:Helper", "Helper", "pkg"), ("other/h.go:Helper", "Helper", "other"), ("b.go:RunB", "RunB", "(root)"), ("x/t.go:T", "T", "x"), ("x/t.go:T", "T", "x")], "id string, name string, dir string")
    pending = spark.createDataFrame([("pkg/a.go:A", "pkg", "Helper"), ("third/a.go:A", "third", "Helper"), ("pkg/a.go:A", "pkg", "RunB"), ("x/a.go:A", "x", "T"), ("m.go:M", "(root)", "T")], "caller string, dir string, callee string")
    assert {(r["from_id"], r["to_id"]) for r in graph.resolve_calls(pending, symbols).collect()} == {("pkg/a.go:A", "pkg/h.go:Helper"), ("pkg/a.go:A", "b.go:RunB")}


def test_symbols_are_not_broadcast_by_estimate(spark, capsys):
    found = spark.range(8).select(F.concat(F.lit("d/"), "id", F.lit(".go")).alias("file"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    symbols = found.select("file", F.concat("file", F.lit(":"), "name").alias("id"), "name", F.array(F.lit("b"), F.lit("c")).alias("calls"))
    made = extract.call_edges(extract.calls_of(symbols), symbols)
    assert made.count() == 8
    capsys.readouterr()
    made.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_sources_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    spark.range(64).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = catalogue._sources(spark, str(tmp_path), ".py", catalogue._PY)
    assert files.rdd.getNumPartitions() > 1
    assert {r["name"] for r in catalogue._symbols(files.filter("id = 's/3.py'"), precise=True).collect()} == {"K3", "run3", "go3"}


def ppmi_docs(spark, *groups):
    rows, n = [], 0
    for times, terms in groups:
        for _ in range(times):
            rows.append((n, terms.split()))
            n += 1
    return spark.createDataFrame(rows, "doc long, terms array<string>"), n


def test_ppmi(spark):
    docs, n = ppmi_docs(spark, (5, "alpha beta"), (3, "gamma delta"), (2, "alpha gamma"))
    got = {(r["term"], r["neighbour"]): r["weight"] for r in cooccur.ppmi(cooccur.document_terms(docs), n).collect()}
    assert got["alpha", "beta"] == pytest.approx(math.log(10 / 7))
    assert got["delta", "gamma"] == pytest.approx(math.log(2))
    assert ("alpha", "gamma") not in got
    docs, n = ppmi_docs(spark, (4, "alpha baz"), (2, "alpha beta"), (4, "gamma delta"))
    got = {r["neighbour"] for r in cooccur.ppmi(cooccur.document_terms(docs), n, least=3).filter("term = 'alpha'").collect()}
    assert got == {"baz"}


def test_ppmi_of_long_documents(spark, monkeypatch):
    common = [f"m{i:03d}" for i in range(400)]
    held = [[*common, "zeta", "zulu"], ["zeta", "zulu"], ["zulu"], *[common[i : i + 40] for i in range(0, 400, 40)], ["alone"], ["alone"]]
    docs = spark.createDataFrame([(i, t + t[:1]) for i, t in enumerate(held)], "doc long, terms array<string>")
    terms = cooccur.document_terms(docs)
    assert {r["term"]: r["df"] for r in cooccur.frequencies(terms).collect()} == {"zeta": 2, "zulu": 3, "alone": 2} | dict.fromkeys(common, 2)
    n = {}
    for t in held:
        for a, b in itertools.combinations(sorted(t), 2):
            n[a, b] = n.get((a, b), 0) + 1
    for block in (cooccur.BLOCK, 64):  # a document of one block and of several
        monkeypatch.setattr(cooccur, "BLOCK", block)
        assert {(r["a"], r["b"]): r["n"] for r in cooccur.pairs(terms).collect()} == {p: c for p, c in n.items() if c >= 2}
        got = {(r["term"], r["neighbour"]): r["weight"] for r in cooccur.ppmi(terms, len(held)).collect()}
        assert got["zeta", "zulu"] == got["zulu", "zeta"] == pytest.approx(math.log(2 * len(held) / 6))
        assert sorted(b for a, b in got if a == "m000") == common[1:11]  # ties to the smaller


def test_expansion_and_rebuild(spark):
    neighbours = spark.createDataFrame([("foo", "baz", 2.0), ("bar", "baz", 1.0), ("bar", "foo", 3.0)], "term string, neighbour string, weight double")
    asked = spark.createDataFrame([(1, ["foo", "bar"]), (2, ["none"])], "query_id long, terms array<string>")
    assert {r["query_id"]: r["terms"] for r in cooccur.expand(asked, neighbours, 2).collect()} == {1: ["foo", "bar", "baz"], 2: ["none"]}
    assert cooccur.rebuild(neighbours, 5, 100, lambda: None) is neighbours
    assert cooccur.rebuild(neighbours, 100, 100, lambda: "new") == "new"


def corpus(spark):
    return spark.createDataFrame(
        [("a.go", "go_file", "sqlite schema handler", "1"), ("b/b.go", "go_file", "schema schemas boost_term here", "2"), ("c.md", "text_file", "boost other term sqlite", "3"), ("b/b.go:F", "function", "schema", ""), ("os", "import", "", "")], NODE
    )


def brute_bm25(rows, phrases):
    docs = {i: t for i, t in rows}
    dl = {i: len(t) for i, t in docs.items()}
    mean, out = sum(dl.values()) / len(dl), dict.fromkeys(docs, 0.0)
    for want, prefix in phrases:
        f = {}
        for i, t in docs.items():
            n = sum(all(t[p + k] == w if not (prefix and k == len(want) - 1) else t[p + k].startswith(w) for k, w in enumerate(want)) for p in range(len(t) - len(want) + 1))
            if n:
                f[i] = n
        idf = math.log((len(docs) - len(f) + 0.5) / (len(f) + 0.5)) if f else 0
        for i, n in f.items():
            out[i] += (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[i] / mean))
    return {i: s for i, s in out.items() if s}


def test_bm25_with_prefixes_and_phrases(spark):
    nodes = corpus(spark)
    asked = spark.createDataFrame([(1, "sqlite schema"), (2, "boost_term"), (3, ""), (4, '"quoted" foo"bar')], "query_id long, query string")
    got = {(r["query_id"], r["id"]): r["bm25"] for r in fts.search(nodes, asked, files_only=False, phrase_positions=True).collect()}
    texts = [(r["id"], r["t"]) for r in nodes.select("id", T.unicode_terms(F.col("content")).alias("t")).collect()]
    want = {(1, i): s for i, s in brute_bm25(texts, [(["sqlite"], True), (["schema"], True)]).items()} | {(2, i): s for i, s in brute_bm25(texts, [(["boost", "term"], True)]).items()}
    assert got == pytest.approx(want) and set(got) == set(want)
    assert {r["id"] for r in fts.search(nodes, asked).collect()} == {"a.go", "b/b.go", "c.md"}


def test_phrases_score_in_every_path(spark):
    nodes = corpus(spark).unionByName(spark.createDataFrame([("d.py", "py_file", "boost terms and a boost_termite", "4"), ("e.py", "py_file", "my boost, don't", "5"), ("f.py", "py_file", "x y1 x y2", "6")], NODE))
    asked = spark.createDataFrame([(1, "boost_term sqlite"), (2, "don't"), (3, "x-y my-boost"), (4, "_x_y")], "query_id long, query string")
    texts = [(r["id"], r["t"]) for r in nodes.select("id", T.unicode_terms(F.col("content")).alias("t")).collect()]
    wanted = {1: [(["boost", "term"], True), (["sqlite"], True)], 2: [(["don", "t"], False)], 3: [(["x", "y"], False), (["my", "boost"], False)], 4: [(["x", "y"], True)]}
    want = {(q, i): s for q, phrases in wanted.items() for i, s in brute_bm25(texts, phrases).items()}
    assert {q for q, _ in want} == {1, 2, 3, 4}
    for found in (fts.search(nodes, asked, files_only=False), fts.search(nodes, asked, files_only=False, phrase_positions=True), fts.scores(nodes, fts.phrases(asked))):
        got = {(r["query_id"], r["id"]): r["bm25"] for r in found.collect()}
        assert set(got) == set(want) and got == pytest.approx(want)
    one = asked.filter("query_id = 2")
    assert {r["file"] for r in context.baseline(nodes, one).collect()} == {r["id"] for r in context.build(nodes, edges(spark, ("q", "r")), one).collect()} == {"e.py"}
    with pytest.raises(ValueError):
        fts.bm25(fts.phrases(asked), fts.frequencies(nodes), fts.doc_stats(nodes))


def test_context(spark):
    nodes = spark.createDataFrame([("a.go", "go_file", "needle in code", "1"), ("b.go", "go_file", "nothing else", "2"), ("c.md", "text_file", "needle " + "long words " * 4000, "3")], NODE)
    asked = spark.createDataFrame([(1, "needle"), (2, "absent")], "query_id long, query string")
    got = {r["id"]: r for r in context.build(nodes, edges(spark, ("a.go", "b.go", "imports")), asked).collect()}
    assert got["a.go"]["source"] == "fts" and got["b.go"]["source"] == "graph"
    assert {r["query_id"] for r in got.values()} == {1}
    built = context.build(nodes, edges(spark, ("a.go", "b.go", "imports")), asked, context.Config(budget=6))
    assert all(r["truncated"] for r in built.collect()) and built.agg(F.sum("tokens")).first()[0] <= 6


def test_dense_fusion(spark):
    nodes = corpus(spark)
    found = spark.createDataFrame([(1, "a.go", "go_file", 2.0, "fts")], "query_id long, id string, type string, score double, source string")
    hits = spark.createDataFrame([(1, "a.go", 0.5), (1, "c.md", 0.8), (2, "c.md", 0.9)], "query_id long, id string, cosine double")
    got = {(r["query_id"], r["id"]): (round(r["score"], 6), r["source"]) for r in rank.fuse_dense(found, hits, nodes).collect()}
    assert got == {(1, "a.go"): (2.25, "fts"), (1, "c.md"): (0.4, "dense")}


def test_graph_expansion(spark):
    nodes = spark.createDataFrame([("a.go", "go_file", "", ""), ("b.go", "go_file", "", ""), ("a.go:X", "function", "", ""), ("b.go:Y", "function", "", "")], NODE)
    found = spark.createDataFrame([(1, "a.go", "go_file", 1.0, "fts")], "query_id long, id string, type string, score double, source string")
    hops = spark.createDataFrame([(1, "a.go:X", 1), (1, "b.go:Y", 2)], "query_id long, id string, hop long")
    got = {r["id"]: (round(r["score"], 6), round(r["boost"], 6)) for r in rank.expand_graph(found, hops, nodes).collect()}
    d1, d2 = math.log(3), math.log(4)
    assert got == {"a.go": (1.0, round(0.15 / d1, 6)), "a.go:X": (round(0.3 / d1, 6), 0.0), "b.go": (round(0.3 / d2, 6), 0.0), "b.go:Y": (round(0.3 / d2, 6), 0.0)}


def test_budget_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, 1, "a", 60, 10), (1, 2, "b", 60, 50), (1, 3, "c", 60, 30), (1, 4, "d", 5, 5)], "query_id long, rank int, id string, soft long, hard long")
    assert [(r["id"], r["tokens"], r["form"], r["used"]) for r in rank.fill_budget(items, 100).orderBy("rank").collect()] == [("a", 60, "soft", 60), ("c", 30, "hard", 90), ("d", 5, "soft", 95)]


def greedy(items, budget):
    out, used = [], 0
    for rank_, i, soft, hard in sorted(items):
        n = soft if used + soft <= budget else hard if used + hard <= budget else None
        if n is not None:
            used += n
            out.append((rank_, i, n, used))
    return out


def test_budget_in_rounds(spark):
    """More items than are folded at once give what one pass over all of them gives."""
    rng = random.Random(4)
    rows = [(q, r, f"i{r}", rng.randint(1, 90), rng.randint(1, 60)) for q in range(5) for r in range(rng.choice([3, 40, 200]))]
    items = spark.createDataFrame(rows, "query_id long, rank int, id string, soft long, hard long")
    for at_once in (1, 7, 2000):
        got = [(r["query_id"], r["rank"], r["id"], r["tokens"], r["used"]) for r in rank.fill_budget(items, 300, at_once=at_once).collect()]
        assert sorted(got) == [(q, *x) for q in range(5) for x in greedy([r[1:] for r in rows if r[0] == q], 300)]


def test_long_phrases(spark):
    """Phrases of two to eight terms, with and without a prefix at their end, against a scan of all places."""
    rng = random.Random(6)
    words = ["ab", "abc", "b", "ca", "cab"]
    texts = [(f"n{i}", [rng.choice(words) for _ in range(rng.randint(1, 120))]) for i in range(25)] + [("empty", [])]
    nodes = spark.createDataFrame([(i, "text_file", " ".join(t), "") for i, t in texts], NODE).repartition(3)
    long = [t for _, t in texts if len(t) > 20]
    asked = []
    for k in range(42):  # every length with and without a prefix, most of them from the texts
        t = rng.choice(long) if k % 5 else [rng.choice(words) for _ in range(9)]
        at = rng.randint(0, len(t) - 9)
        asked.append((k, t[at : at + 2 + k % 7], k % 2 == 0))
    wanted = spark.createDataFrame([(q, 0, w, p) for q, w, p in asked], "query_id long, phrase_no int, terms array<string>, prefix boolean")
    want = {}
    for q, w, p in asked:
        for i, t in texts:
            n = sum(t[k : k + len(w) - 1] == w[:-1] and (t[k + len(w) - 1].startswith(w[-1]) if p else t[k + len(w) - 1] == w[-1]) for k in range(len(t) - len(w) + 1))
            if n:
                want[q, i] = n
    for found in (fts.occurrences(nodes, wanted), fts.matches(wanted, fts.postings(nodes))):
        assert {(r["query_id"], r["id"]): r["f"] for r in found.collect()} == want
    assert len(want) > 150 and {len(asked[q][1]) for q, _ in want} == set(range(2, 9))


def test_index_and_nodes_give_the_same(spark):
    nodes = corpus(spark)
    asked = spark.createDataFrame([(1, "sqlite schema"), (2, "boost_term schemas_of_nothing"), (3, "")], "query_id long, query string")
    stored = fts.postings(nodes), fts.doc_stats(nodes)
    for files_only in (True, False):
        a, b = (fts.search(nodes, asked, files_only=files_only, index=x).collect() for x in (None, stored))
        assert {(r["query_id"], r["id"], r["rank"]) for r in a} == {(r["query_id"], r["id"], r["rank"]) for r in b} and len(a) > 2
    long = fts.phrases(spark.createDataFrame([(1, "boost_termination handlers")], "query_id long, query string"))
    assert fts.matches(long, stored[0]).collect() == fts.occurrences(nodes, long).collect() == []


def test_limits_of_walks(spark):
    star = edges(spark, *[("a", f"n{i}", "calls") for i in range(30)], ("a", "n1", "imports"))
    assert graph.trace(star, "a", 1, limit=5).count() == 5 and graph.trace(star, "a", 1, limit=None).count() == 30
    assert graph.trace_nodes(star, "a", 1, limit=None).count() == 31 and graph.trace_nodes(star, "a", 1, limit=4).count() == 5
    found, _ = graph.trace_many(star, seeds(spark, "a"), 1, limit=None)
    assert found.count() == 31
    assert "TakeOrdered" not in found._jdf.queryExecution().toString()


def test_branches_of_many_queries(spark):
    rows = [(f"d{d:02d}/f{k}.go", "go_file", "", "") for d in range(12) for k in range(12 - d)]
    files = spark.createDataFrame(rows, NODE)
    covered = [(1, i) for i, *_ in rows if i.startswith(("d00", "d01"))] + [(2, "d03/f0.go"), (3, "d11/f0.go")]
    got = nav.branches(files, spark.createDataFrame(covered, "query_id long, id string"), nav.symbol_counts(files), 3).collect()
    assert {(r["query_id"], r["rank"], r["dir"], r["n_covered"]) for r in got} == {
        (1, 1, "d02", 0), (1, 2, "d03", 0), (1, 3, "d04", 0), (2, 1, "d00", 0), (2, 2, "d01", 0), (2, 3, "d02", 0), (3, 1, "d00", 0), (3, 2, "d01", 0), (3, 3, "d02", 0)
    }
    ranked = nav.drill(files, "d1").orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in ranked] == [(1, "d10/f0.go"), (2, "d10/f1.go"), (3, "d11/f0.go")]


def test_current_and_vectors(spark):
    nodes = spark.createDataFrame([("a", "go_file", "", "1"), ("b", "go_file", "", "2")], NODE)
    wanted = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3")], "id string, hash string")
    assert {tuple(r) for r in store.current(nodes, wanted).collect()} == {("a", True, True), ("b", True, False), ("c", False, False)}
    base = spark.createDataFrame([("a", 2, [1.0, 0.0]), ("b", 2, [0.0, 1.0])], "id string, dim int, vec array<float>")
    got = {r["id"]: (r["dim"], r["vec"]) for r in store.upsert_vectors(base, spark.createDataFrame([("b", [3.0, 4.0]), ("c", [0.0, 0.0, 2.0])], "id string, vec array<double>")).collect()}
    assert got["a"] == (2, [1.0, 0.0]) and got["b"][1] == pytest.approx([0.6, 0.8]) and got["c"] == (3, [0.0, 0.0, 1.0])


def test_the_last_vector_of_an_id_stays(spark):
    base = spark.createDataFrame([("a", 2, [1.0, 0.0])], "id string, dim int, vec array<double>")
    load = spark.createDataFrame([("a", 7, [0.0, 2.0]), ("b", 9, [3.0, 4.0]), ("a", 30, [4.0, 3.0]), ("b", 8, [1.0, 0.0])], "id string, no long, vec array<float>")
    assert sorted((r["id"], r["vec"]) for r in store.upsert_vectors(base, load, "no").collect()) == [("a", [0.8, 0.6]), ("b", [0.6, 0.8])]


def test_vectors_of_other_lengths_and_ties(spark):
    v = spark.createDataFrame([(f"k{i:03d}", [1.0, 0.0]) for i in range(50)] + [("long", [1.0, 0.0, 5.0]), ("none", None), ("empty", [])], "id string, vec array<float>").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vec array<float>")
    rows = vector.top_cosine(v, q, 3, block=7).orderBy("rank").collect()
    assert [(r["id"], r["cosine"]) for r in rows] == [("k000", 1.0), ("k001", 1.0), ("k002", 1.0)]


def test_efficiency_and_report(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 1.0)], "query_id long, precision double")
    used = spark.createDataFrame([(1, 100, 0.5), (2, 5000, 0.2)], "query_id long, tokens long, density double")
    raw = spark.createDataFrame([(1, 400), (2, 4000)], "query_id long, raw_tokens long")
    got = metrics.efficiency(rows, used, raw)
    by = {r["query_id"]: r for r in got.collect()}
    assert (by[1]["within"], by[1]["ratio"], by[1]["efficiency"]) == (True, 0.25, 0.5)
    assert (by[2]["within"], by[2]["compression"], by[2]["efficiency"]) == (False, -0.25, None) and by[3]["ratio"] is None
    total = metrics.totals(got).first()
    assert (total["n"], total["tokens"], total["pass_percent"], total["ratio"], total["compression"], total["efficiency"]) == (3, 1700.0, 66.667, 0.75, 0.75, 0.5)
    assert metrics.report(got.orderBy("query_id"), ["query_id", "within", "ratio"], 9).split("\n") == ["query_id  within    ratio", "1         True      0.250", "2         False     1.250", "3         True"]


def test_config_of_a_session(spark):
    for name, value in (("budget", "77"), ("share", "0.5"), ("depth", "many"), ("files", "-3")):
        spark.conf.set(f"spark.quarry.{name}", value)
    try:
        assert context.Config.of(spark) == context.Config(budget=77, share=0.5)
    finally:
        for name in ("budget", "share", "depth", "files"):
            spark.conf.unset(f"spark.quarry.{name}")


def test_store(spark):
    nodes = spark.createDataFrame([("pkg_a/file.go", "go_file", "", "1"), ("pkg_a/file.go:A", "function", "", ""), ("pkg/a_file.go", "go_file", "", "2"), ("pkg/a_file.go:B", "function", "", "")], NODE)
    e = edges(spark, ("pkg_a/file.go", "pkg_a/file.go:A", "contains"), ("pkg/a_file.go", "pkg/a_file.go:B", "contains"), ("pkg/a_file.go:B", "pkg_a/file.go:A", "calls"))
    kept, left = store.clear_contents(nodes, e, seeds(spark, "pkg_a/file.go"))
    assert "pkg/a_file.go:B" in {r["id"] for r in kept.collect()} and kept.count() == 3 and left.count() == 2
    kept, left = store.delete_nodes(nodes, e, seeds(spark, "pkg_a/file.go"))
    assert kept.count() == 2 and left.count() == 1
    after = spark.createDataFrame([("pkg_a/file.go", "9"), ("new", "3")], "id string, hash string")
    assert {tuple(r) for r in store.diff(nodes.filter("hash <> ''"), after).collect()} == {("pkg_a/file.go", "changed"), ("new", "new"), ("pkg/a_file.go", "deleted")}
    assert store.insert_missing(e, e).count() == 3
    many = spark.range(1200).select(F.col("id").cast("string").alias("id"))
    assert store.lookup(many, many).count() == 1200


def test_navigation(spark):
    nodes = spark.createDataFrame([("pkg/a.go", "go_file", "", ""), ("pkg/b.go", "go_file", "", ""), ("m.go", "go_file", "", ""), ("pkg/a.go:A", "function", "", ""), ("pkg/a.go:B", "function", "", ""), ("other/c.go:C", "function", "", "")], NODE)
    assert {tuple(r) for r in nav.symbol_counts(nodes).collect()} == {("pkg", 2), ("other", 1)}
    files = nodes.filter(F.col("type").like("%_file"))
    got = nav.branches(files, seeds(spark, "pkg/a.go", "m.go"), nav.symbol_counts(nodes)).collect()
    assert [(r["dir"], r["n_files"], r["n_covered"], r["n_symbols"], r["summary"]) for r in got] == [("pkg", 2, 1, 2, "a, b")]
    assert {r["id"] for r in nav.drill_down(nodes, "pk").collect()} == {"pkg/a.go", "pkg/b.go"}
    assert {r["id"] for r in nav.drill_down(nodes, "(root)").collect()} == {"m.go"}


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 2.0]), ("z", [0.0, 0.0])], "id string, vec array<float>")
    q = spark.createDataFrame([(k, [3.0, 0.0]) for k in range(130)], "query_id long, vec array<float>")
    rows = vector.top_cosine(v, q, 2, block=50).collect()
    assert len(rows) == 260 and {(r["id"], r["rank"], round(r["cosine"], 6)) for r in rows} == {("a", 1, 1.0), ("b", 2, 0.707107)}


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "e")], "query_id long, file string")
    got = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "y", 2), (2, "b", 3), (3, "q", 1), (4, "x", 1), (4, "d", 2)], "query_id long, file string, rank int")
    m = {r["query_id"]: r for r in metrics.per_query(got, truth).collect()}
    assert [round(m[k]["mrr"], 3) for k in (1, 2, 3, 4)] == [1, 0.333, 0, 0.5]
    assert m[1]["ndcg"] == 1 and m[4]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert m[4]["precision"] == 0.2 and m[4]["recall"] == 0.5
    assert {r["metric"]: r["median"] for r in metrics.summary(metrics.per_query(got, truth)).collect()}["mrr"] == pytest.approx((1 / 3 + 0.5) / 2)


def test_evaluation(spark):
    nodes = spark.createDataFrame([("a.go", "go_file", "needle in code", "1"), ("b.go", "go_file", "other words", "2")], NODE)
    cases = spark.createDataFrame([("x", "needle", ["a.go"], ""), ("y", "words", ["a.go"], "")], "id string, query string, ground_truth_files array<string>, notes string")
    rows = {r["metric"]: r["mean"] for r in evaluate.evaluate(nodes, edges(spark, ("b.go", "zzz", "imports")), cases).collect()}
    assert rows == {"mrr": 0.5, "ndcg": 0.5, "precision": 0.1, "recall": 0.5}


def test_tasks_of_edges_grow_with_the_tables(spark, tmp_path, monkeypatch):
    part = lambda name, **c: spark.range(0, 600).select(*[x.cast("long").alias(k) for k, x in c.items()]).write.parquet(f"{tmp_path}/{name}.parquet")
    i = F.col("id")
    part("nation", n_regionkey=i % 5, n_nationkey=i % 25)
    part("customer", c_nationkey=i % 25, c_custkey=i % 100)
    part("orders", o_custkey=i % 100, o_orderkey=i)
    part("lineitem", l_orderkey=i % 300, l_partkey=i % 2)
    monkeypatch.setattr(catalogue, "TASK_ROWS", 50)
    assert catalogue.dealt(spark.range(600), "id").rdd.getNumPartitions() == 12
    made = {r["relation_type"]: (r["n"], r["n_from"], r["n_to"]) for r in catalogue.node_edge_stats(spark, str(tmp_path)).collect()}
    assert made == {"contains": (125, 30, 125), "calls": (600, 100, 600), "imports": (300, 300, 2)}


def test_term_matches_of_repeated_ids_and_terms(spark):
    nodes = spark.createDataFrame([("a", "x y x"), ("b", "z"), ("a", "y"), ("c", None)], "id string, content string")
    wanted = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "z"), (3, "w")], "query_id long, term string")
    assert sorted(tuple(r) for r in fts.term_matches(nodes, wanted).collect()) == [(1, 1, 4), (2, 1, 1)]
