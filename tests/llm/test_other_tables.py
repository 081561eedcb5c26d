"""Operators on pages, embeddings and conversations."""

import base64
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from quarry.llm import common, entry, html_cut, quoting, vafile, warc
from quarry.llm.common import work_dir


def test_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 7)
        terminal = [rng.randint(-9, 9) for _ in range(n)]
        smooth = {(i, j): rng.randint(0, 6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6}

        def cost(label, terminal=terminal, smooth=smooth):
            ends = sum(-t if t < 0 and x else t if t > 0 and not x else 0 for t, x in zip(terminal, label, strict=True))
            return ends + sum(w for (i, j), w in smooth.items() if label[i] != label[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_cut.minimum_cut(terminal, smooth)) == best


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href="/">Home</a><li><a>News of the day</a></ul></nav></header><!-- ad --><div class="ad">Buy this thing now, it is a very good thing to buy, they say.</div>
<div class="cookie-notice">We use cookies to give you the best experience. Do you accept all of them?</div>
<article><h1>My  title</h1><p><b>First&nbsp;paragraph &amp; more words that make it a long one for sure,
with a line break.<br><p>Ok.</p><p>Second <i>para</i>graph &lt;here&gt; is also rather long and it ends with a stop.</p><ul><li>item<li>other item</ul>
<blockquote>Quoted words of somebody else.</blockquote></article>
<aside><p>Popular: a long sentence in the sidebar that nobody wants to have in the text, really.</p></aside><form><p>Subscribe to the letter</p><input></form>
<div id="comments"><article class="comment"><p>I liked this article, it was long and good and very interesting to read.</p></article></div>
<footer>&copy; 2020 The site and its owners, all rights reserved for ever.</footer></body></html>"""


def test_main_text():
    assert html_cut.main_text(PAGE).split("\n") == ["My title", "First paragraph & more words that make it a long one for sure, with a line break.", "Ok.", "Second paragraph <here> is also rather long and it ends with a stop.", "item", "other item", "Quoted words of somebody else."]
    for odd in ("", "<", "<p", "</p></div>", "<article>" + "<p>A whole sentence with quite a few words in it.</p>" * 3000, "<div><div><p>" * 300, "&", "text only, without any markup but long enough to be an article of some kind."):
        html_cut.main_text(odd)
    assert html_cut.main_text("<article>" + "<p>A whole sentence with quite a few words in it.</p>" * 3000).count("\n") == 2999


def test_unclosed_elements_keep_the_page():
    whole = "A first sentence that is long enough to be kept as a part of the article."
    rest = "Another sentence that is long enough to be kept as a part of the article."
    page = f"<article><p>{whole}</p>%s<p>{rest}</p>%s</article>"
    for tag in ('<svg width="5"/>', "<svg/>", '<math display="block" />', "<p><svg/></p>"):
        for later in ("", "<svg><text>no</text></svg>"):
            assert html_cut.main_text(page % (tag, later)).split("\n") == [whole, rest]
    for tag in ("<select>", "<noscript>", "<template>", "<iframe src=x>", "<svg>"):
        assert html_cut.main_text(page % (tag, "")).split("\n") == [whole, rest]
        assert html_cut.main_text(page % (f"{tag}dropped</{tag[1:-1].split()[0]}>", "")).split("\n") == [whole, rest]
    for tag in ("<script>", "<style>", "<textarea>", "<title>"):
        assert html_cut.main_text(page % (tag, "")) == whole
    assert html_cut.main_text("<article>" + f"<svg><p>{whole}</p>" * 3000).count("\n") == 2999


LONG = "This sentence has more than a dozen words in it, so that its own text looks like content."


def test_the_cut_decides():
    """Blocks whose own text speaks against the label that the whole page asks for."""
    for page, kept in (
        (f"<article><p>{LONG}</p><p>Of.</p><p>{LONG}</p></article>", [LONG, "Of.", LONG]),  # a word between paragraphs
        (f"<p>{LONG}</p><p>Three short words.</p><p>{LONG}</p>", [LONG, "Three short words.", LONG]),  # without any name
        (f"<article><p>{LONG}</p></article><footer><p>{LONG}</p><p>{LONG}</p></footer>", [LONG]),  # sentences of a footer
        (f'<article><p>{LONG}</p><div class="ad">{LONG}</div><p>{LONG}</p></article>', [LONG, LONG]),  # an advert between paragraphs
        (f'<div class="search-results-study"><p>{LONG}</p><p>{LONG}</p></div>', [LONG, LONG]),  # an element of doubtful name goes with its text
        ('<div class="search-results-study"><p><a>One</a></p><p><a>Two</a></p></div>', []),
        (f'<div class="content"><p><a>A link</a></p><p>{LONG}</p></div>', ["A link", LONG]),
    ):
        found = html_cut.blocks(page)
        terminal, smooth = html_cut.graph(found)
        keep = html_cut.minimum_cut(terminal, smooth)
        assert html_cut.main_text(page).split("\n") == (kept or [""])
        alone = html_cut.minimum_cut(terminal, {})
        assert kept and any(x != y for x, y in zip(keep, alone, strict=True)) or not kept


def test_labels_of_pages_against_brute_force():
    rng = random.Random(5)
    texts = ["Of.", "Menu", LONG, "<a>Link</a>", "<a>A link of a few more words.</a>", "Some five or six words here"]
    opens = ["<article>", "<div class=content>", "<div class=ad>", "<footer>", "<div class=search-tips>", "<section>", "<header>"]
    for _ in range(150):
        page = "".join(rng.choice([f"<p>{rng.choice(texts)}</p>", f"<p>{rng.choice(texts)}</p>", rng.choice(opens), f"</{rng.choice(opens)[1:].split()[0].rstrip('>')}>"]) for _ in range(8))
        terminal, smooth = html_cut.graph(html_cut.blocks(page))
        if not terminal or len(terminal) > 11:
            continue
        best = None
        for label in itertools.product([False, True], repeat=len(terminal)):
            cost = sum(abs(t) for t, x in zip(terminal, label, strict=True) if (t > 0) != x) + sum(w for (i, j), w in smooth.items() if label[i] != label[j])
            best = min(best, (cost, sum(label), label)) if best else (cost, sum(label), label)
        assert tuple(html_cut.minimum_cut(terminal, smooth)) == best[2]


def test_no_text_of_an_article_is_lost():
    for inner, kept in (
        ("<p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is small.</p>", "The sum a+b is small."),
        ("<object data=x.pdf><p>A fallback text that can be read instead.</p></object>", "A fallback text that can be read instead."),
        ("<my-box>In an element of its own.</my-box>", "In an element of its own."),
        ("<p>A <unknown>strange</unknown> tag.</p>", "A strange tag."),
    ):
        assert html_cut.main_text(f"<article><p>{LONG}</p>{inner}</article>").split("\n") == [LONG, kept]
    assert html_cut.main_text(f'<article class="post comment-policy"><p>{LONG}</p></article>') == LONG
    assert html_cut.main_text(f'<article><section class="search-results-study"><p>{LONG}</p><p>Ok.</p></section></article>') == LONG + "\nOk."
    assert html_cut.main_text(f"<form><div><article><p>{LONG}</p></article><p>Your name here please, it is needed.</p></div></form>") == LONG
    assert html_cut.main_text(f"<article><p>{LONG}</p><form><p>{LONG}</p></form></article>") == LONG


def test_names_and_text_weigh_alike():
    """Labels that neither the name of the nearest element nor the text of the block would give alone."""
    page = f"<form><p>{LONG}</p><p>Of.</p><p>{LONG}</p><p>{LONG}</p></form>"  # a form around a whole page
    found = html_cut.blocks(page)
    assert found[1].score < 0 and found[1].element.score < 0
    assert html_cut.main_text(page).split("\n") == [LONG, "Of.", LONG, LONG]
    for page, kept in (
        (f'<div class="widget">{f"<p>{LONG}</p>" * 8}</div><footer><p>{LONG}</p></footer>', [LONG] * 8),
        (f'<article><p>{LONG}</p></article><div class="notice"><p>{LONG}</p><p>{LONG}</p></div>', [LONG]),
        (f'<div class="sidebar"><article><p>A teaser.</p></article></div><p>{LONG}</p>', [LONG]),
        (f'<article class="post has-share"><p>{LONG}</p></article>', [LONG]),
        (f'<main class="legal"><p>{LONG}</p></main>', [LONG]),
        (f'<article><p>{LONG}</p><div class="message"><p>{LONG}</p></div></article>', [LONG, LONG]),
        (f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>', [LONG]),
        ("<article><ul>" + "<li><a>A link</a></li>" * 100 + f"</ul><table>{'<tr><td>7</td></tr>' * 100}</table></article>", ["A link"] * 100 + ["7"] * 100),
        (f'<div data-id="comment" title="class=ad"><p>{LONG}</p></div>', [LONG]),
    ):
        assert html_cut.main_text(page).split("\n") == kept, page


def test_inline_parts_are_judged_by_themselves():
    for page, kept in (
        (f'<p><a class="share">Share</a> {LONG}</p>', LONG),
        (f'<p>{LONG} <span style="display:none">secret</span>And more.</p>', f"{LONG} And more."),
        (f'<article><p>{LONG} <button>Buy</button> And <i class="text">mo</i>re.</p></article>', f"{LONG} And more."),
        ("<article><p>beauti<script>1</script>ful<noscript>x</noscript> it<template>y</template>s <iframe src=a></iframe>i<select><option>x</select>n</p></article>", "beautiful its in"),
        (f"<!-->{LONG}<p>b --> c</p>", f"{LONG}\nb --> c"),
        (f"<!--->{LONG}<!-- a > b --!> And more.", f"{LONG} And more."),
        (f'<article><p title="a > b" lang=\'x>y\'>{LONG}</p></article>', LONG),
    ):
        assert html_cut.main_text(page) == kept, page


def test_broken_tags_take_time_by_length():
    for part in ('<a "', '<a ="> "', "<a b='", "<!", "<a ", "</", "<", "<script></script ", "<!--"):
        began = time.monotonic()
        html_cut.main_text(part * 100_000)
        html_cut.main_text(part * 100_000 + ">")
        assert time.monotonic() - began < 10, part


def test_deep_pages_take_time_by_length():
    for page in ("<center>" * 40_000 + LONG, "<b>" * 40_000 + "</i>" * 40_000 + LONG, f"<ul><li>{LONG}" * 20_000, f"<div class=content>{f'<p>{LONG}</p><p><a>Nine</a></p>' * 20_000}"):
        began = time.monotonic()
        html_cut.main_text(page)
        assert time.monotonic() - began < 20


def test_extract_rows_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash", 7)], "page_id long, url string, html string, text string, n_chars long")
    row = html_cut.extract(df).first()
    assert row["text"] == html_cut.main_text(PAGE) and row["n_chars"] == len(row["text"])


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "v", "", 5)], "page_id long, url string, html string, n_chars int")
    rows = html_cut.extract(df).collect()
    assert sorted((r["page_id"] or -1, r["n_chars"]) for r in rows) == [(-1, 0), (1, len(rows[0]["text"])), (1, len(rows[0]["text"])), (2, 0)]
    assert html_cut.extract(df.limit(0)).count() == 0


def test_framing():
    for payload in (b"", b"a", b"x" * 10_000, bytes(range(256)) * 40):
        assert warc.unchunked(warc.chunked(payload, 999)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_segments():
    parts = [(2, None, b"de"), (1, None, b"abc"), (3, 6, b"f")]
    assert warc.join_segments(parts) == b"abcdef"
    for broken in ([parts[0], parts[2]], [(1, None, b"abc"), (2, 6, b"de")]):
        with pytest.raises(ValueError):
            warc.join_segments(broken)


@pytest.mark.parametrize(("least", "frequent"), [(0, 4096), (3, 4096), (0, 1), (3, 1)])
def test_archives(spark, monkeypatch, least, frequent):
    monkeypatch.setattr(common, "FREQUENT_ROWS", frequent)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdé \n") for _ in range(3000))
    html = [None, "", "a", "a", long, long, long + "!", "日本\r\n0\r\n\r\n", "WARC/1.1\r\n\r\n", long]
    rows = [(i * 3, "http://x/\n" if i % 2 else None, h, "clash") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write(df, work_dir(spark, "test-warc"), segment_bytes=700, least_bytes=least)
    assert sum(r["n_records"] for r in manifest.collect()) > len(html) + 5  # long ones are segmented
    got = {r["page_id"]: r for r in warc.read(manifest).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        last = max(3 * k for k, x in enumerate(html) if (x or "") == (h or ""))
        response = last == 3 * i or len(data) < least
        assert tuple(got[3 * i]) == (3 * i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else last)
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_archives_with_odd_keys(spark):
    df = spark.createDataFrame([(None, "u", "same"), (4, "u", "same"), (4, "u", "same"), (None, "u", "alone")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in warc.write_and_read(df).collect())
    assert got == [(-1, "response", -1), (-1, "revisit", 4), (4, "response", -1), (4, "response", -1)]


def brute_top(rows, k):
    ids, v = np.array([r[0] for r in rows]), np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    out = set()
    for i in sorted({x for x in ids.tolist() if x % 20 == 0}):
        scores = v @ v[list(ids).index(i)]
        others = np.flatnonzero(ids != i)
        for rank, j in enumerate(others[np.lexsort((ids[others], -scores[others]))][:k], 1):
            out.add((i, rank, int(ids[j]), int(scores[j])))
    return out


VECTORS = "vec_id long, embedding array<float>, score string"


def small_blocks(monkeypatch):
    for name, value in {"CANDIDATES": 40, "QUERIES": 7, "FILE": 100, "LEAST_FILE": 60, "READ": 25}.items():
        monkeypatch.setattr(vafile, name, value)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], "x") for i in range(300)]
    rows += [(i, rows[0][1], "x") for i in range(300, 340)]  # one common vector: ties
    bad = [(1000, None, "x"), (1020, [1.0] * 7 + [None], "x"), (1040, [float("nan")] * 8, "x"), (1060, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame([(i, v, s) for i, v, s in rows + bad], VECTORS)
    exact = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v, _ in rows]
    small_blocks(monkeypatch)
    got, read = vafile.search(df, 20, "vec_id % 20 = 0", "embedding")
    assert {tuple(r) for r in got.collect()} == brute_top(exact, 20)
    assert read.count() < 17 * 200  # the cells leave out many of the 321 candidates of each query
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert {tuple(r) for r in vafile.top_k(few, 20).collect()} == brute_top(exact[:3], 20)
    assert vafile.top_k(df.limit(0)).count() == 0
    assert vafile.top_k(df, query="vec_id = 7777").count() == 0
    assert vafile.top_k(spark.createDataFrame([*bad, (1100, [], "x")], VECTORS)).count() == 0


def test_top_k_of_other_lengths_and_repeats(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 3)], "x") for i in range(50)] + [(50, [0.5, -0.25, 1.5, 0.25], "x"), (60, [0.75], "x"), (61, [], "x")]
    exact = [(i, [*np.array(v, dtype=np.float32).astype(float).tolist(), 0, 0, 0, 0][:4]) for i, v, _ in rows]
    got = vafile.top_k(spark.createDataFrame(rows, VECTORS), 20)
    assert {tuple(r) for r in got.collect()} == brute_top(exact, 20)
    # a repeated query is one query, repeated candidates keep their places
    twice = [(0, [1.0, 1.0], "x")] * 3 + [(3, [1.0, 0.0], "x")] * 2 + [(4, [0.5, 0.0], "x"), (3, [0.0, 2.0], "x")]
    got = vafile.top_k(spark.createDataFrame(twice, VECTORS), 3)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 3, 8192), (0, 2, 3, 4096), (0, 3, 3, 4096)]
    large = [(i, [float(np.float32(2.0**40 * x)) for x in rng.normal(0, 1, 4)], "x") for i in range(30)]
    got = {(r["query_id"], r["rank"]): r["score"] for r in vafile.top_k(spark.createDataFrame([(i, [x / 2**20 for x in v], s) for i, v, s in large], VECTORS), 5).collect()}
    v = np.floor(64 * np.array([[x / 2**20 for x in v] for _, v, _ in large])).astype(np.int64)
    for q in (0, 20):
        assert [got[q, r] for r in range(1, 6)] == sorted((int(v[q] @ v[i]) for i in range(30) if i != q), reverse=True)[:5]


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_bounds_hold(bits):
    rng = np.random.default_rng(1)
    for scale in (3, 60, 2**40):
        v, q = rng.integers(-scale, scale, (200, 13)), rng.integers(-60, 60, (9, 13))
        grid = vafile.Grid(v.min(axis=0), v.max(axis=0), bits)
        data = grid.pack(v)
        assert len(data) == 200 * -(-13 * bits // 8)
        low, high = grid.bounds(q, grid.unpack(data, 200))
        assert (low <= q @ v.T).all() and (high >= q @ v.T).all()


def test_long_quotes(spark):
    words = [f"line {i} of the text" for i in range(100_000)]
    mixed = "".join(f"{'>' * (1 + i % 2)} {w}\n" for i, w in enumerate(words[:20_000]))  # a run for each line
    rows = [(1, 0, "\n".join(words)), (1, 1, "\n".join("> " + w for w in words) + "\nI agree"), (1, 2, mixed), (1, 3, "> " * 30_000 + words[5]), (1, 4, "> line 7 of the text\r\nSo\r\n>> line 8 of the text\r\n")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in quoting.link(df).collect()}
    assert [got[t]["n_passages"] for t in range(5)] == [0, 1, 20_000, 1, 2]
    assert [got[t]["n_linked"] for t in range(5)] == [0, 1, 20_000, 1, 2]
    assert [got[t]["n_levels"] for t in (0, 1, 2, 4)] == [0, 1, 2, 2]
    assert [got[t]["parent_turn"] for t in range(5)] == [None, 0, 0, None, 0]
    assert (got[1]["body"], got[2]["body"], got[3]["body"], got[4]["body"]) == ("I agree", "", "", "So\r\n")


def test_quotes_nest_without_bound(spark, tmp_path):
    deep = "\n".join(">" * (40 - k) + f" words of level {40 - k}" for k in range(40))
    rows = [(1, k, "user", f"words of level {k}") for k in range(1, 41)] + [(1, 50, "user", deep), (1, 51, "user", "> " * 17 + "words of level 9")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: (r["n_levels"], r["n_passages"], r["n_linked"]) for r in entry.op5_quotation_linking(spark, str(tmp_path)).filter("turn >= 50").collect()}
    assert got == {50: (40, 40, 40), 51: (17, 1, 1)}


def brute_conversations(rows):
    """(conv_id, turn) to parent, root, depth and (n_levels, n_passages, n_linked), and the reply order; keys are distinct."""
    fold = lambda x: " ".join(re.sub(r"^[ \t]*>[ \t>]*", "", x).lower().split())
    level = lambda x: re.match(r"[ \t>]*", x)[0].count(">")
    pick = lambda lines: {u for u in [*map(fold, lines), " ".join(filter(None, map(fold, lines)))] if u}
    own, passages = {}, {}
    for c, t, _, text in rows:
        lines = (text or "").split("\n")
        depth = [level(x) for x in lines] + [0, 0]
        body = [x for i, x in enumerate(lines) if not depth[i] and not (re.search(quoting.ANNOUNCED, x) and (depth[i + 1] or not "".join(lines[i + 1 : i + 2]).strip() and depth[i + 2]))]
        own[c, t] = pick(body)
        passages[c, t] = {(n, "\n".join(run)) for n, run in ((n, [lines[i] for i in run]) for n, run in itertools.groupby(range(len(lines)), key=lambda i: depth[i])) if n}
    out, children = {}, {}
    for k in own:
        votes, linked = {}, 0
        for n, raw in passages[k]:
            hit = False
            for u in pick(raw.split("\n")):
                here = min([x for x in own if x[0] == k[0] and u in own[x]], default=None)
                there = min([x for x in own if u in own[x]], default=None)
                target = here if here and here < k else there if there and there < k else None
                if target:
                    hit = True
                    if n == 1:
                        votes[target] = votes.get(target, 0) + len(u)
            linked += hit
        parent = min(votes, key=lambda x: (-votes[x], x)) if votes else max([x for x in own if x[0] == k[0] and x < k], default=None)
        children.setdefault(parent, []).append(k)
        out[k] = [parent, None, 0, (max((n for n, _ in passages[k]), default=0), len(passages[k]), linked)]
    order = {}
    for root in children.get(None, []):
        todo = [(0, root)]
        for d, k in todo:
            out[k][1:3] = root, d
            todo += [(d + 1, x) for x in children.get(k, [])]
        order[root] = [k for _, k in sorted(todo)]
    return out, order


def threads(rng):
    words = ["alpha", "beta", "gamma", "Delta", "omega", "One two", "so be it"]
    rows, said = [], []
    for c in range(6):
        for t in range(9):
            lines = [f"{rng.choice(words)} {rng.randint(0, 30)}" for _ in range(rng.randint(1, 3))]
            if said and rng.random() < 0.6:
                old = rng.choice(said[-12:]).split("\n")
                lines = [*rng.choice([["On Monday B wrote:"], ["Am Montag schrieb C:", ""], []]), *("> " + x if not x.startswith(">") else ">" + x for x in old), *rng.choice([lines, [lines[0], "", "> no such line", lines[-1]]])]
            elif rng.random() < 0.2:
                lines.insert(1, "Then the minister wrote:")
            said.append("\n".join(lines))
            rows.append((c, t * 2, rng.choice(["user", "assistant", None]), rng.choice([said[-1], said[-1], said[-1].replace("\n", "\r\n")])))
    return rows


def test_conversations_against_brute_force_and_sql(spark, tmp_path, monkeypatch):
    import duckdb

    rows = threads(random.Random(11))
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, position int").repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    for frequent in (4096, 2):
        monkeypatch.setattr(common, "FREQUENT_ROWS", frequent)
        got = entry.op5_quotation_linking(spark, str(tmp_path)).collect()
        expected, order = brute_conversations(rows)
        assert len(got) == len(rows) and sum(r["n_linked"] for r in got) > 20 and max(r["depth"] for r in got) > 4
        for r in got:
            parent = (r["parent_conv"], r["parent_turn"]) if r["parent_conv"] is not None else None
            assert [parent, (r["root_conv"], r["root_turn"]), r["depth"], (r["n_levels"], r["n_passages"], r["n_linked"])] == expected[r["conv_id"], r["turn"]], r
        by = {}
        for r in sorted(got, key=lambda r: r["position"]):
            by.setdefault((r["root_conv"], r["root_turn"]), []).append((r["conv_id"], r["turn"]))
        assert by == order
        place = {(r["conv_id"], r["turn"]): r["position"] for r in got}
        assert all(r["parent_conv"] is None or place[r["parent_conv"], r["parent_turn"]] < r["position"] for r in got)
    df.union(df.limit(4)).union(spark.createDataFrame([(None, 3, "user", "> alpha 1\nx", 5), (2, None, None, None, 5)], df.schema)).write.parquet(f"{tmp_path}/more/conversations.parquet")
    monkeypatch.setattr(quoting, "PART", 4)
    got = entry.op5_quotation_linking(spark, f"{tmp_path}/more")
    columns = sorted(got.columns)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/more/conversations.parquet/*.parquet'")
        sql = entry.oracle_sql()["op5_quotation_linking"].replace("// 256", "// 4")
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want, key=key)


def test_prose_that_announces_no_quote_stays(spark):
    rows = [(1, 0, "u", "Hello\nOn Monday the minister wrote:\nNo quote follows here."), (1, 1, "u", "On Monday the minister wrote:\n\n> Hello\nYes"), (1, 2, "u", "x\n" + "a" * 200 + " schrieb:\n> Hello\nNo")]
    linked = quoting.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["turn"]: r["body"] for r in linked.collect()} == {0: rows[0][3], 1: "\nYes", 2: "x\nNo"}


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quoting, "PART", 10)
    rows = [(7, t, "u", "hello") for t in range(55)] + [(None, 1, "u", "x"), (None, 1, "u", "x")]
    found = quoting.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), follow=True).collect()
    parts = {r["part"]: [m["turn"] for m in r["turns"]] for r in found if r["root_conv"] == 7}
    assert parts == {p: list(range(10 * p, min(55, 10 * p + 10))) for p in range(6)}
    assert len(found) == 8


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday A wrote:\n> Hello  there.\n> how are you?\nFine thanks."),
        (1, 2, "user", "> On Monday A wrote:\n>> Hello there.\n>> How are you?\n> Fine thanks.\nGreat!"), (2, 0, "user", "> Great!\nI agree"), (2, 1, "user", None),
        (2, 2, "x", "> unknown text\nbody"), (None, 0, "x", "> Great!\n"), (2, 3, "x", "> I agree"), (2, 3, "x", "> I agree"), (2, 4, "x", ">" * 40 + " deep"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    linked = quoting.link(df)
    got = {(r["conv_id"], r["turn"]): r for r in linked.collect()}
    parent = lambda *k: (got[k]["parent_conv"], got[k]["parent_turn"], got[k]["root_conv"], got[k]["root_turn"], got[k]["depth"])
    assert parent(1, 0) == (None, None, 1, 0, 0)
    assert parent(1, 1) == (1, 0, 1, 0, 1)
    assert parent(1, 2) == (1, 1, 1, 0, 2)
    assert parent(2, 0) == (1, 2, 1, 0, 3)
    assert parent(2, 3) == (2, 0, 1, 0, 4)
    assert parent(2, 2) == (None, None, 2, 2, 0)
    assert (got[1, 2]["n_levels"], got[1, 2]["n_passages"], got[1, 2]["n_linked"]) == (2, 3, 2)
    assert got[2, 4]["n_levels"] == quoting.MOST_LEVELS
    assert [got[k]["body"] for k in ((1, 1), (1, 2), (2, 0), (2, 1))] == ["Fine thanks.", "Great!", "I agree", ""]
    assert linked.count() == len(rows)
    order = [(r["conv_id"], r["turn"]) for r in quoting.ordered(linked.filter("root_conv = 1")).collect()]
    assert order == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 3), (2, 3)]
    assert quoting.link(df.limit(0)).count() == 0
