"""Operators on documents: brute force, round trips and the cases that the docstrings define."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, common, components, dac, entry, fm, jaccard, packing, quality, shingles

WORDS = "the of and to in reing thation onder ver, und Der! é ção naïve 12 x7 don't ### %% | ¿qué? 日本".split()


def make(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [make(rng, rng.randint(0, 120)) for _ in range(60)]
    out += [None, "", " ", "\n\n", "a", "  lead", "trail  ", "a  b\n\n c\t", "<|endoftext|> here", make(rng, 9000), "x" * 5000, "The " * 90, "\0 nul \x1c sep", "é" * 30]
    out += [out[3], out[3], out[5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", 1.5, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_byte_bpe_matches_library(docs, texts, empty):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tokens = bpe.read_ranks(f.read())
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(encoded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == list(range(3000))
    assert all(table.index(k) == i for i, k in enumerate(keys))


def test_packing_is_whole_and_gapless(docs, texts, empty):
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i in ids:
        assert gapless(pieces[i]) == len(ids[i])
    for parts in sequences.values():
        total = gapless(parts)
        assert total <= 1024 and total & (total - 1) == 0  # nothing is padded
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


def test_packing_balances_cost():
    lengths = [500] * 8 + [100] * 8
    loads = collections.Counter()
    for _, _, n, s, _ in packing.assign(lengths, 1024):
        loads[s] += packing.cost(n)
    full = [loads[s] for s, c in enumerate(packing.capacities(sum(lengths), 1024)) if c == 1024]
    assert max(full) < 1.5 * min(full)


def test_codes_give_any_id():
    x = np.random.default_rng(1).integers(0, 1 << 20, 3000)
    x[::3] %= 256
    codes = dac.Codes.from_bytes(memoryview(dac.Codes.build(x).to_bytes()))
    assert [codes[i] for i in range(3000)] == x.tolist()
    for a, b in ((0, 3000), (511, 513), (1024, 2047), (7, 7)):
        assert codes.slice(a, b).tolist() == x[a:b].tolist()
    with pytest.raises(IndexError):
        codes[3000]


def test_token_files_round_trip(spark, docs, texts, empty, monkeypatch):
    reference = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    reference.encode_special_tokens = True
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in dac.write_and_read(docs, P.path("word_bpe_49k.json"), docs_per_shard=10).collect()}
    start = 0
    for i in sorted(ids):
        want = np.array(ids[i], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    monkeypatch.setattr(dac, "RANGES", 2)
    again = {r["doc_id"]: r for r in dac.write_and_read(docs, P.path("word_bpe_49k.json"), docs_per_shard=7).collect()}
    assert again == got
    assert dac.write_and_read(empty, P.path("word_bpe_49k.json")).count() == 0
    odd = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b")], "doc_id long, text string")
    assert sorted(r["start"] for r in dac.write_and_read(odd, P.path("word_bpe_49k.json")).collect()) == [0, 2, 4]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|><|endoftext|>\n z", "<|ENDOFTEXT|> and <|endoftext", "plain", None, "Caf\u0065\u0301 <|endoftext|> \x1c"]


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in SPECIAL]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in entry.op8_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), crc(x)) for i, x in enumerate(ids)} and got[0][0] == 4
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in SPECIAL]
    import corpus_pipeline

    for rows in (entry.op7_packing(spark, str(tmp_path)), corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))):
        rows = rows.collect()
        assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(i, len(x)) for i, x in enumerate(ids)}
        for r in rows:
            assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])


def shingle_sets(texts, width):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset())
    return out


def brute_components(ids, sets, percent):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(900)]
    out = [None, "", "  ", "one", "one", "One two", "one two three", "x y z q", "X y z q"]
    for _ in range(5):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 110))]
        for _ in range(22):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w[: len(w) - rng.randint(0, 3)]))
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    out += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 60))) for _ in range(40)]
    out += [out[12]] * 30
    ids = list(range(100, 100 + len(out)))
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, out, strict=True)], "doc_id long, text string, component_id string").repartition(3)
    got = {r["doc_id"]: r for r in jaccard.join(df, width, percent).collect()}
    sets = shingle_sets(out, width)
    assert {i: got[i]["n_shingles"] for i in ids} == {i: len(s) for i, s in zip(ids, sets, strict=True)}
    assert {i: got[i]["component_id"] for i in ids} == brute_components(ids, sets, percent)
    kept = jaccard.keep_one(df, width, percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(ids, sets, percent).values()))


def near_copies(rng, groups, each):
    """Groups of near copies with exact ones among them, texts that share a passage, and one long text."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) for _ in range(60)]
    long = [rng.choice(vocabulary) for _ in range(30_000)]
    return [*out, " ".join(long), " ".join(long[:-700])]


@pytest.mark.parametrize("bounds", [{"CHUNK": 3000, "SHARED": 2, "SLOT_ROWS": 3}, {"HOT": 3, "BLOCK_SETS": 7, "FREQUENT": 10, "STRETCH": 2000, "CHUNK": 10_000}, {"GIANT": 20, "GIANT_ROWS": 5, "BLOCK_BYTES": 4000, "HOT": 2, "COLUMNS": 16}])
def test_jaccard_join_dealt_and_by_blocks(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies(random.Random(len(bounds)), 5, 40)
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()}
    assert got == brute_components(ids, shingle_sets(texts, 4), 85)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(300):
        u = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        v = np.unique(np.concatenate([u[int(rng.integers(0, len(u))) :], rng.integers(0, 1 << 63, int(rng.integers(0, 400)), dtype=np.uint64)]))
        found = jaccard.least_difference(jaccard.odd_sketch(u), jaccard.odd_sketch(v))
        assert found <= len(np.setxor1d(u, v)) and (found - len(np.setxor1d(u, v))) % 2 == 0


def test_jaccard_join_odd_keys(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (7, "p q r s t"), (9, "P q r s t"), (None, "a b c d e"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard.join(df).collect())
    assert got == [(-1, -1), (4, 4), (7, 7), (7, 7), (7, 7), (9, 7)]  # rows of one id are one node
    assert sorted(r["doc_id"] or -1 for r in jaccard.keep_one(df).collect()) == [-1, 4, 7]
    assert jaccard.join(df.limit(0)).count() == 0


def test_jaccard_join_with_a_copy_in_a_repeated_id(spark):
    rng = random.Random(8)
    a, b = (" ".join(f"{x}{rng.randint(0, 9999)}" for _ in range(80)) for x in "ab")
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(3, a), (5, a), (5, b), (9, near), (12, b), (20, "something else that is alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for table, ids in ((df, {3, 5, 9, 12}), (df.filter("doc_id <> 12"), {3, 5, 9})):
        assert {r["doc_id"]: r["component_id"] for r in jaccard.join(table).collect()} == dict.fromkeys(ids, 3) | {20: 20}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [3, 20]


@pytest.mark.parametrize("frequent_share", [0, 0.1, 0.5, 1.0])
def test_every_qualifying_pair_shares_a_signature(frequent_share):
    rng = np.random.default_rng(int(frequent_share * 10))
    bands = [jaccard.allocate(i, low, high) for i, (low, high) in enumerate(jaccard.band_limits(1000))]
    assert any(b.heavy for b in bands)
    tried = 0
    for _ in range(400):
        u = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        changed = int(rng.integers(0, len(u) // 6 + 2))
        v = np.unique(np.concatenate([rng.permutation(u)[changed // 2 :], rng.integers(0, 1 << 63, changed - changed // 2, dtype=np.uint64)]))
        if len(v) and jaccard.similar(u, v):
            both = rng.permutation(np.unique(np.concatenate([u, v])))
            frequent = np.sort(both[: int(len(both) * frequent_share)])
            a, b = (np.concatenate([jaccard.signatures(x, band, frequent) for band in jaccard.bands_of(len(x), bands)]) for x in (u, v))
            assert len(np.intersect1d(a, b))
            tried += 1
    assert tried > 150


def test_components_by_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL", 7)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, x) for x in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    column = pa.array([make(rng, rng.randint(0, 30)) for _ in range(50)] + [None, ""])
    whole = [u.tolist() for u in shingles.sets(column, 3)]
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 64)
    assert [u.tolist() for u in shingles.sets(column, 3)] == whole
    assert [u.tolist() for u in shingles.sets(column.slice(5, 20), 3)] == whole[5:25]


def structure_of(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered, seen, repeats = set(), set(), 0
    for k in range(len(w) - 2):
        if windows[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeats, len(covered), failed


def test_quality_counts_and_ratio(spark, docs, texts, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    labels = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,), (0,)], "doc_id long")
    plain = docs.select("doc_id", "text")
    got = {r["doc_id"]: r for r in quality.scores(plain, labels).collect()}
    raw, target = collections.Counter(), collections.Counter()
    grams = {}
    for i, t in enumerate(texts):
        tokens = [x for x in re.sub(r"[!-/:-@\[-`{-~]+", lambda m: f" {m[0]} ", t or "").replace("\x1c", "\x1c").split(" ") for x in re.findall(r"[^\x20\x09-\x0D]+", x)]
        codes = [zlib.crc32(x.encode()) for x in tokens]
        grams[i] = [c % quality.BUCKETS for c in codes] + [(a * 31 + b + 1) % quality.BUCKETS for a, b in zip(codes, codes[1:], strict=False)]
        raw.update(grams[i])
        if i < 40 and i % 2 == 0:
            target.update(grams[i])
    n_raw, n_target = (sum(c.values()) + quality.BUCKETS for c in (raw, target))
    for i, t in enumerate(texts):
        assert tuple(got[i][n] for n in names) == structure_of(t), (i, t)
        exact = sum(round(1e6 * np.log((target[g] + 1) / n_target / ((raw[g] + 1) / n_raw))) for g in grams[i])
        assert abs(got[i]["llr"] - exact) <= len(grams[i])
        assert got[i]["n_grams"] == len(grams[i])
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["llr"] >= quality.THRESHOLD * len(grams[i]))
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    assert quality.keep(empty, labels).count() == 0
    assert {r["llr"] for r in quality.scores(plain, labels.limit(0)).collect()} == {0}


def test_quality_with_clashing_columns(spark, texts):
    """Columns of the names of results are replaced by scores, and others kept; keep returns what came."""
    rows = [(i, t, "mine", 7, True) for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, llr int, kept boolean")
    labels = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    plain = {r["doc_id"]: r for r in quality.scores(df.select("doc_id", "text"), labels).collect()}
    for r in quality.scores(df, labels).collect():
        assert all(r[c] == plain[r["doc_id"]][c] for c in ("n_words", "llr", "kept", "n_grams"))
    kept = quality.keep(df, labels)
    assert kept.columns == df.columns and {tuple(r) for r in kept.collect()} == {x for x in rows if plain[x[0]]["kept"]}


def test_classifier_of_odd_tables(spark, empty):
    """Very long texts, repeated rows, a key of many texts, and empty tables."""
    long = " ".join(f"w{i % 9000}" for i in range(200_000))
    rows = [(1, long), (1, long), (2, "the old house"), (2, "another text"), (3, None), (None, "x")] + [(k, f"text {k}") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = fm.classify(df, df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and len({r["score"] for r in got if r["doc_id"] == 2}) == 2
    again = {(r["doc_id"], r["score"]) for r in fm.classify(df, df.repartition(5), labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    plain = empty.select("doc_id", "text")
    assert fm.classify(plain, plain, labels).count() == 0
    assert {r["score"] for r in fm.classify(df, plain, labels.limit(0)).collect()} == {0.5}


def test_packing_of_groups_and_repeats(spark):
    """Groups end within a task; repeated rows are documents of their own; sequences are full or a power of two."""
    rows = [(k % 7, " ".join(f"word{k}" for _ in range(k % 40))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    pieces = packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN, group_tokens=3000, added=True).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r["length"] for r in pieces) == total
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = [gapless(found) for found in sequences.values()]
    assert all(n == 1024 or n < 1024 and n.bit_count() == 1 for n in sizes) and sum(n < 1024 for n in sizes) > 2


def test_classifier_learns_and_is_bounded(spark):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["the", "house", "was", "red", "and", "old", "river"]) for _ in range(60)) + "."
    bad = lambda: " | ".join(rng.choice(["BUY", "NOW!!", "the", "%%%"]) for _ in range(40))
    rows = [(i, bad() if i % 4 == 0 else good(), "x") for i in range(400)] + [(1000, None, "x"), (1001, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in fm.classify(df, df, labels).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(400) if got[i]["held_out"]] == held
    assert np.mean([got[i]["predicted"] == int(i % 4 > 0) for i in held]) > 0.95
    machine = fm.train(df, labels)
    kept = fm.keep(df, machine)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got.values())
    assert fm.keep(df.limit(0), machine).count() == 0
    assert set(fm.classify(df, df, labels.limit(0)).select("score").distinct().toPandas()["score"]) == {0.5}


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(3)
    m = fm.Machine(0.3, rng.normal(size=fm.FEATURES), rng.normal(size=(fm.FEATURES, fm.FACTORS)))
    index, value = rng.choice(fm.FEATURES, 30, replace=False), rng.normal(size=30)
    pairs = sum(value[i] * value[j] * (m.v[index[i]] @ m.v[index[j]]) for i in range(30) for j in range(i))
    assert m.raw(fm.Sparse(np.array([0, 30]), index, value))[0] == pytest.approx(0.3 + m.w[index] @ value + pairs)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    # words with meaning only to this test: clean prose of varied words, junk of symbols, copies and near copies
    clean = [" ".join(f"word{rng.randint(0, 4000)}" for _ in range(rng.randint(60, 200))) for _ in range(60)]
    junk = [" ".join(f"w{rng.randint(0, 300)}###" for _ in range(80)) for _ in range(20)]
    near = clean[0].replace(clean[0].split()[30], "changed", 1)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*clean, *junk, clean[1], near, "too short", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(60))
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.filter(F.col("length") < 1).count() == 0
    # the pieces are the whole documents that the stages kept, as the library encodes them, and sequences have no gaps
    library, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packed.collect()
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in kept.items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()} and all(r["doc_tokens"] == len(ids[r["doc_id"]]) for r in pieces)
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(gapless(found) == 1024 or gapless(found).bit_count() == 1 and gapless(found) < 1024 for found in sequences.values())


def gapless(found):
    at = 0
    for offset, n in sorted(found):
        assert offset == at
        at += n
    return at


def test_the_pipeline_leaves_only_its_rows(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline

    made = []
    monkeypatch.setattr(corpus_pipeline, "work_dir", lambda spark, name: made.append(common.work_dir(spark, name)) or made[-1])
    rows = [(i, " ".join(f"word{(i * 7 + k * k) % 900}" for k in range(90)), "en", "s", 500) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    root = os.path.dirname(common.work_dir(spark, "probe").removeprefix("file:"))
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, str(tmp_path)).count()
    folder = made[0].removeprefix("file:")
    assert os.listdir(folder) == ["3"]
    assert {x for x in set(os.listdir(root)) - before if os.listdir(f"{root}/{x}")} <= {os.path.basename(folder)}


def test_work_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(cluster, "x")


def test_rows_of_one_key_fill_many_ranges(spark):
    rows = [(5, f"text {i}") for i in range(300)] + [(i, "other") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = dac.write(df, P.path("word_bpe_49k.json"), common.work_dir(spark, "t"), docs_per_shard=20)
    found = manifest.groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()
    assert len(found) >= 12 and max(r["n"] for r in found) <= 80
    starts = [(r["doc_id"], r["start"], r["n_tokens"]) for r in dac.read(manifest).orderBy("start").collect()]
    assert [k for k, _, _ in starts] == sorted(k for k, _ in rows)
    assert all(b[1] == a[1] + a[2] for a, b in zip(starts, starts[1:], strict=False))


def test_coders_know_their_vocabulary(spark, tmp_path):
    """A second vocabulary of equal size and last tokens, in the same workers, is another one."""
    tokens = [bytes([b]) for b in range(256)]
    paths = []
    for name, merged in (("a", [b"th", b"he", b"zz"]), ("b", [b"to", b"he", b"zz"])):
        paths.append(tmp_path / name)
        paths[-1].write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([*tokens, *merged])))
    df = spark.createDataFrame([(1, "this toss")], "doc_id long, text string")
    got = [bpe.encode(df, str(p), r"\S+|\s+").first()["ids"] for p in paths]
    assert got[0] != got[1] and len(got[0]) == len(got[1]) == 8


def test_memos_are_bounded_by_bytes(monkeypatch):
    ranks = [bytes([b]) for b in range(256)]
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 20_000)
    coder = bpe.ByteBPE(ranks, r"\S+|\s+")
    for i in range(300):
        text = " ".join(f"{chr(0x4E00 + i)}{chr(0x4E00 + k)}" * 20 for k in range(5))
        assert bytes(coder.encode(text)) == text.encode()
        assert coder.chunk_bytes < 30_000 and coder.piece_bytes < 30_000 and len(coder.chunks) < 100
