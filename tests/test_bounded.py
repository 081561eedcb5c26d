"""Neighbours by bounds equal those of all pairs counted."""

import itertools
import math
import random

import pytest

from quarry.operators import bounded, cooccur, settle


def by_counting(docs, k, least=2):
    n, df = {}, {}
    for t in docs:
        t = sorted(set(t))
        for a in t:
            df[a] = df.get(a, 0) + 1
        for a, b in itertools.combinations(t, 2):
            n[a, b] = n[b, a] = n.get((a, b), 0) + 1
    out = {}
    for (a, b), c in n.items():
        w = math.log(c * len(docs) / (df[a] * df[b]))
        if c >= least and w > 0:
            out.setdefault(a, []).append((-round(w, 12), b))
    return {(a, b, round(-w, 9)) for a, found in out.items() for w, b in sorted(found)[:k]}


def corpus(seed, n_docs=120, copies=True):
    """Words of very different frequency, copies of documents, empty ones and one that holds everything."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6):06d}" for _ in range(400)]
    docs = [[words[min(int(rng.paretovariate(0.5)), 400) - 1] for _ in range(rng.choice([0, 1, 5, 30, 80]))] for _ in range(n_docs)]
    if copies:
        docs += [list(d) for d in rng.sample(docs, 15) for _ in range(rng.choice([1, 1, 3]))]
    return [*docs, words, ["always"]]


@pytest.mark.parametrize("narrow, owner, slices, seed", [(32, 1024, (1 / 32, 1 / 8, 1.0), 1), (2, 10, (1 / 8, 1 / 2, 1.0), 2), (2, 10, (1 / 8, 1 / 2, 1.0), 3), (3, 20, (1 / 16, 1 / 4, 1.0), 4), (0, 4, (1 / 4, 1 / 2, 1.0), 5), (200, 400, (1 / 2, 1 / 2, 1.0), 6), (1, 1, (0.5, 0.75, 1.0), 7)])
def test_equals_all_pairs(spark, monkeypatch, narrow, owner, slices, seed):
    for name, value in (("NARROW", narrow), ("OWNER", owner), ("SLICES", slices), ("COST", 5000), ("HELD", 100), ("FEW", 0)):
        monkeypatch.setattr(bounded, name, value)
    docs = corpus(seed)
    rows = spark.createDataFrame(list(enumerate(docs)), "doc long, terms array<string>")
    for k, least in ((10, 2),) if seed != 3 else ((3, 1), (10, 4)):
        got = {(r["term"], r["neighbour"], round(r["weight"], 9)) for r in cooccur.ppmi(cooccur.document_terms(rows), len(docs), k, least).collect()}
        assert got == by_counting(docs, k, least)


def test_no_documents(spark):
    rows = spark.createDataFrame([(1, []), (2, ["once"])], "doc long, terms array<string>")
    assert cooccur.ppmi(cooccur.document_terms(rows), 2).collect() == []
    assert cooccur.ppmi(cooccur.document_terms(rows.limit(0)), 0).collect() == []


def test_copies_of_documents_do_not_grow_with_parts(spark, monkeypatch):
    """Each deal goes to a round of parts, however many there are, and its shuffle files go with it."""
    for name, value in (("NARROW", 2), ("OWNER", 10), ("COST", 2000), ("FEW", 0), ("ROUND", 4)):
        monkeypatch.setattr(bounded, name, value)
    copies, deal = [], bounded._dealt

    def counted(docs, *rest):
        out = deal(docs, *rest)
        copies.append((out.select("part").distinct().count(), out.count(), docs.count()))
        return out

    monkeypatch.setattr(bounded, "_dealt", counted)
    docs = corpus(8, 60)
    rows = spark.createDataFrame(list(enumerate(docs)), "doc long, terms array<string>")
    got = {(r["term"], r["neighbour"]) for r in cooccur.ppmi(cooccur.document_terms(rows), len(docs)).collect()}
    assert got == {x[:2] for x in by_counting(docs, 10)}
    most = max(4, spark.sparkContext.defaultParallelism)
    assert len(copies) > 6 and all(parts <= most and n <= most * rows for parts, n, rows in copies)


@pytest.mark.parametrize("few", [0, 1024])
def test_terms_of_documents_by_batches(spark, monkeypatch, few):
    """Repeats count once; null terms, null lists and empty ones hold nothing."""
    monkeypatch.setattr(bounded, "FEW", few)
    docs = [[*d, *d[:3]] for d in corpus(9)]
    held = [*docs, [], [], []]
    rows = spark.createDataFrame([*((d,) for d in docs), ([],), (None,), ([None, None],)], "terms array<string>").repartition(5)
    before = spark.conf.get(bounded._CLEANUP)
    got = {(r["term"], r["neighbour"]) for r in cooccur.document_ppmi(rows, len(held)).collect()}
    assert got == {x[:2] for x in by_counting(held, 10)} and spark.conf.get(bounded._CLEANUP) == before
    for none in (rows.limit(0), rows.filter("size(terms) = 0")):
        assert cooccur.document_ppmi(none, 0).collect() == []


@pytest.mark.parametrize("narrow, owner, seed", [(2, 10, 2), (0, 4, 5), (2, 3, 11)])
def test_pairs_of_frequent_terms_are_added_up_within_tasks(spark, monkeypatch, narrow, owner, seed):
    """Such pairs are not shuffled one by one, in however many rounds their owners come."""
    for name, value in (("NARROW", narrow), ("OWNER", owner), ("SLICES", (1 / 8, 1 / 2, 1.0)), ("FEW", 0), ("CELLS", 600)):
        monkeypatch.setattr(bounded, name, value)

    def shuffled(*_):
        raise AssertionError("pairs are shuffled, or read too late")

    monkeypatch.setattr(cooccur, "_counted", shuffled)
    docs = corpus(seed, 60)
    rows = spark.createDataFrame(list(enumerate(docs)), "doc long, terms array<string>").repartition(3)
    monkeypatch.setattr(type(rows), "toLocalIterator", shuffled)  # it reads shuffle files after they are gone
    got = {(r["term"], r["neighbour"], round(r["weight"], 9)) for r in cooccur.ppmi(cooccur.document_terms(rows), len(docs)).collect()}
    assert got == by_counting(docs, 10)


def test_documents_are_packed_from_small_batches(spark, monkeypatch):
    """Rows hold as many documents as they should, of however few that Python gets at a time."""
    monkeypatch.setattr(cooccur, "PACKED_DOCUMENTS", 40)
    docs = corpus(10)
    rows = spark.createDataFrame([(d,) for d in docs], "terms array<string>").coalesce(1)
    with settle.small_batches(spark, 7):
        packed = cooccur._worded(rows).select("n", "terms", "counts").collect()
    assert [r["n"] for r in packed[:-1]] == [42] * (len(packed) - 1) and sum(r["n"] for r in packed) == len(docs)
    counts = {}
    for r in packed:
        for t, c in zip(r["terms"], r["counts"], strict=True):
            counts[t] = counts.get(t, 0) + c
    assert counts == {t: sum(t in d for d in docs) for t in {t for d in docs for t in d}}
    got = {(r["term"], r["neighbour"], round(r["weight"], 9)) for r in cooccur.document_ppmi(rows, len(docs)).collect()}
    assert got == by_counting(docs, 10)
    settle.release()
