"""Line dedup, spelling variants and phrases against brute force, and the cases that their docstrings define."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup, phrases, spelling

LINES = ["", "short", "\t Some longer LINE \r", "some longer line", "ÉCOLE publique de la ville", "école publique de la ville", "exactly 10", "ninechars", "another line of text", " \x0b padded line here \x0c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, "\n".join(rng.choice([*LINES, f"only in {i} and nowhere"]) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    out += [(100, None), (101, ""), (102, "\n"), (103, "\n\n"), (104, "\n".join(["repeated in one text"] * 3)), (105, "x" * 200_000 + "\n" + "some longer line")]
    out += [out[3], (3, "another line of text\nof a second row"), (None, "another line of text\nnameless only"), (None, "nameless only\nnameless  only"), (106, "nameless only\nok")]
    out += [(i, "the line that all have\nown") for i in range(200, 600)]
    return out


def expected_lines(rows, least_chars=10, least_docs=2):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    last = 1 << 60
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(last if i is None else i)
    gone = {k: min(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if gone.get(key(x), last if i is None else i) == (last if i is None else i)]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least_docs", [2, 3])
def test_lines_equal_brute_force(spark, rows, least_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT_ROWS", 64)  # the common line is dealt to slots
    df = spark.createDataFrame([(i, t, "clash", 1, "h") for i, t in rows], "doc_id long, text string, kept_text string, slot int, h1 string").repartition(5)
    got = line_dedup.dedup(df, least_docs=least_docs)
    assert got.columns == ["doc_id", "text", "slot", "h1", "n_lines", "n_dropped", "kept_text"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=str) == expected_lines(rows, least_docs=least_docs)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def near(a, b):
    """Whether words are at distance one, by the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_trie_pairs_are_all_pairs_at_distance_one():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 40))})
        got = list(spelling.trie_pairs(words))
        assert len(got) == len(set(got))
        assert {(words[i], words[j]) for i, j in got} == {(a, b) for a, b in itertools.permutations(words, 2) if near(a, b)}
    long = sorted(["x" * 30_000, "x" * 29_999 + "y", "x" * 30_001, "y" + "x" * 30_000])
    assert len(list(spelling.trie_pairs(long))) == 8


def expected_variants(counts, times=5):
    """word: (form, root, n, n_near, form_n)."""
    out, forms = {}, {}
    for w in counts:
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= times * counts[w] else None
        out[w] = [forms[w], w, counts[w], len(around), counts.get(forms[w])]
    for w in counts:
        while forms[out[w][1]]:
            out[w][1] = forms[out[w][1]]
    return {w: tuple(x) for w, x in out.items()}


@pytest.mark.parametrize("group", [4096, 12])
def test_variants_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", group)  # 12: hot prefixes are split at several levels
    rng = random.Random(group)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.choice([5, 5, 30, 200, 1500]) for _ in range(250)}
    counts |= {"interna" + "".join(rng.choice("lt") for _ in range(rng.randint(0, 6))): rng.choice([5, 40]) for _ in range(60)} | {"z" * 5000: 5, "z" * 5001: 25}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("clash"))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got == expected_variants(counts)
    assert spelling.variants(df.limit(0)).count() == 0


def test_vocabulary_counts_whole_texts(spark):
    rng = random.Random(8)
    words = ["Garden", "garten", "Gärten", "ÀÉîx÷yz", "sixsix", "seven77seven", "don't", "lettersé", "ab", "x" * 3000]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(60, None), (61, ""), (None, "garden " * 9), (7, "garden repeated")]
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    for slip in (0, 7):
        counts = collections.Counter()
        for i, t in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = lower(w)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                counts[w[: h % len(w)] + w[h % len(w) + 1 :] if slip and h % slip == 0 else w] += 1
        want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
        df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n int").repartition(3)
        assert {r["word"]: r["n"] for r in spelling.vocabulary(df, slip=slip).collect()} == want
        assert spelling.vocabulary(df.limit(0)).count() == 0


def expected_phrases(rows, least, top, percent=80):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3, 4):
                f.update((lang or "und", tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [x for (g, q), x in f.items() if g == lang and len(q) > len(p) and x >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * x >= percent * a for x in longer):
            continue
        s, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], s))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("bits", [1 << 30, 1 << 12])
def test_phrases_equal_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "BITS_EACH", 16 if bits > 1 << 12 else 1)
    rng = random.Random(3)
    words = ["New", "york", "City", "of", "the", "é", "Ünï", "a b", "日本", "x"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "de", None]), make(rng.randint(0, 120))) for _ in range(80)]
    rows += [("en", None), (None, ""), ("fr", "  \t "), ("fr", "so so so so so so so so so"), ("en", "new york city hall " * 2000), ("en", make(30_000))] + [("en", "of the new york city")] * 40
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    for least, top in ((5, 2000), (30, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, top=top, least_count=least).collect())
        assert got == expected_phrases(rows, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    tables = [spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, phrase string, f long"), spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")]
    assert phrases.cuts(tables).first()["score"] == 2000000 * big // (2 * big + 8)


def test_kept_text_hash_is_of_utf8(spark):
    got = line_dedup.dedup(spark.createDataFrame([(1, "née Müller\nx")], "doc_id long, text string")).select(F.sha2("kept_text", 256).alias("s")).first()["s"]
    assert got == hashlib.sha256("née Müller\nx".encode()).hexdigest()
