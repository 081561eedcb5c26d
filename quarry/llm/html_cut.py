"""Main text of web pages by minimum-cut labelling of their blocks.

A forgiving parser turns a page into blocks: the text between block-level tags, with the share of its characters inside
links. What a block holds inside inline elements of telling names (a share link, a hidden span) is a node of its own. The
graph has a node for each block and one for each element whose tag, class, id, role or visibility says something. A linear
classifier gives every node log-odds of being content: a block's from its text (length, links, punctuation, heading), where
short texts and links say nothing against content inside articles; an element's from what it and its ancestors are called
and from the share of the page's plain text that it holds. The positive part is the capacity from the source,
the negative part that to the sink. Smoothness edges join a block to the nearest such element, blocks that
follow each other (stronger the closer they are in the tree), blocks that follow each other under one
parent, and inline parts to their block; blocks of different elements are nearly free of each other. The minimum cut labels all nodes at once:
a word between paragraphs of an article stays although its text says menu, a paragraph in a footer goes
although its text says content, and an element goes the way of what it holds where that weighs more than its name: a
handful of sentences outweighs a class name or a form, dozens a footer. Only what is hidden is beyond doubt.

Nodes whose terminal capacity is at least the sum of their edges are settled first, which never
changes the value of the cut; what remains goes, a connected part at a time, through a max-flow by
blocking flows on levels. Capacities are integers, so results are exact and repeatable.

Null html counts as empty and gives empty text. Character references are decoded, white space inside
a block becomes one space, blocks are joined by a line feed in page order. Elements whose content is no
text (RAW) are left out whole and end no block; one without an end tag loses its tag alone, unless its content can hold no tags (ENDLESS).
Tags that are neither block-level nor known are inline, as in browsers. Quotes count in tags after an equals sign; once a
tag reaches the end of the page for a quote, quotes count no more in the rest. Each row yields one row,
repeats included; other columns are ignored, also those named text or n_chars. Nothing is cut from long pages, and
time grows with their length, however deep they nest.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, schema_of

# Element and class vocabularies of the classifier.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg select head".split())
#: Without an end tag these reach to the end of the page.
ENDLESS = frozenset("script style textarea title".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BAD_TAGS = frozenset("nav footer aside button menu dialog datalist".split())
FORM_TAGS = frozenset("form fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent contact cookie cookies copyright "
    "dialog discussion disqus donate footer form gdpr header hero legal login masthead menu menubar message modal nav navbar navigation newsletter notice notification pager pagination popup promo promos "
    "promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signup site-header skip social sponsor sponsored subscribe subscription "
    "tags teaser toolbar topbar trending warning widget widgets alert announcement complementary contentinfo".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
NEUTRAL_WORDS = frozenset("has with no layout wrapper wrap container page site outer inner".split())
#: Beside a bad word these leave a name as bad as it is; other words make it doubtful.
PLAIN_WORDS = NEUTRAL_WORDS | GOOD_WORDS | frozenset("area articles bar block bottom box button buttons group inline item items left link links list main mobile posts primary right secondary section slot stories text top unit".split())
#: Beside these a bad word tells what an element has, not what it is.
HAVING_WORDS = frozenset("has with no".split())
#: Bad words that also name parts of articles: they make a name doubtful at most.
AMBIGUOUS_WORDS = frozenset("message hero legal discussion respond".split())
#: Articles of these names are comments of readers, whatever their tag.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSABLE = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
LAYOUT_WORDS = frozenset("sidebar header footer nav menu hero banner".split())
SCOPES = frozenset("ul ol dl table tr article section div body main aside nav footer header form blockquote".split())

#: Log-odds of blocks, in thousandths; those of texts of fewer than FULL words count in proportion.
BIAS, LINKS, SHORT, LONG, SENTENCE, HEADING, FULL = -600, -2500, -700, 1600, 700, 900, 6
#: Log-odds of elements, in thousandths. WHOLE speaks for one of a bad name that holds all plain text of the page, with nothing for half of it.
BAD_TAG, BAD, FORM, GOOD, HEADER, GOOD_NAME, DOUBTFUL, WHOLE = -40_000, -9000, -9000, 5000, -6000, 3000, -1500, 6000
HIDDEN = -1_000_000_000
#: Smoothness: a block and its element; neighbours in page order under one parent, in nearby parents, in other elements; siblings; a block and its inline parts.
HOLD, NEAR, FAR, OTHER, SIBLING, INLINE = 4000, 900, 250, 100, 400, 600

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=20_000)
def attribute_score(tag: str, attributes: str) -> tuple[int, bool]:
    """What class, id, role and itemprop say of an element, in thousandths of log-odds, and whether it is hidden."""
    if tag in ("html", "body"):
        return 0, False
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("class", "id", "role", "itemprop"):
            names += [frozenset(w.lower() for w in _WORD.findall(x)) for x in value.split()]
    words = frozenset().union(*names)
    good = words & GOOD_WORDS
    doubt = False
    for name in names:
        bad = name & BAD_WORDS
        if not bad or bad <= LAYOUT_WORDS and (good | words & NEUTRAL_WORDS) and words & NEUTRAL_WORDS:
            continue
        if name - bad <= PLAIN_WORDS and not name & HAVING_WORDS and not bad <= AMBIGUOUS_WORDS:
            # beside the declaration of an article other names than those of comments weigh half
            return BAD if tag not in GOOD_TAGS or bad & COMMENT_WORDS else BAD // 2, hidden
        doubt = True
    return (GOOD_NAME if good else 0) + (DOUBTFUL if doubt else 0), hidden


def is_block(tag: str) -> bool:
    return tag in BLOCK_TAGS or "-" in tag


class Frame:
    """An open element: score says what it and its ancestors are called, form the part of it that forms around it have."""

    __slots__ = ("tag", "score", "hidden", "form", "article", "link", "parent", "depth", "element", "holder", "near")

    def __init__(self, tag: str, parent: Frame | None, attributes: str):
        self.tag, self.parent = tag, parent
        if parent is None:
            self.score, self.hidden, self.form, self.article, self.link, self.depth, self.element, self.holder, self.near = 0, False, 0, False, False, 0, None, self, None
            return
        own, hidden = attribute_score(tag, attributes) if attributes else (0, False)
        self.form, self.article, before = parent.form, parent.article, parent.score
        if tag in BAD_TAGS:
            own += BAD_TAG
        elif tag in FORM_TAGS:
            own, self.form = own + FORM, self.form + FORM
        elif tag in GOOD_TAGS:
            # an article inside a form is no part of one
            own, before, self.form, self.article = own + GOOD, before - self.form, 0, True
        elif tag == "header":
            own += DOUBTFUL if before > 0 else HEADER
        if own <= HEADER:
            # what is called bad is no better for the article around it
            before, self.article = min(before, 0), False
        self.score, self.hidden, self.link, self.depth = before + own, parent.hidden or hidden, parent.link or tag == "a", parent.depth + 1
        self.element = self if own or hidden or tag in GOOD_TAGS else parent.element
        self.holder = self if is_block(tag) else parent.holder
        self.near = self if tag in CLOSABLE else None if tag in SCOPES else parent.near


class Block:
    """The pieces (position on the page, text) that a block has in one element; line numbers the blocks, main parts come first."""

    __slots__ = ("pieces", "text", "plain", "score", "holder", "element", "line")

    def __init__(self, pieces: list[tuple[int, str]], linked: int, holder: Frame, element: Frame | None, line: int):
        self.pieces, self.holder, self.element, self.line = pieces, holder, element, line
        self.text = text = " ".join("".join(x for _, x in pieces).split())
        self.plain = max(len(text) - linked, 0)
        n = max(text.count(" ") + 1, len(text) // 10)
        links = linked * 2 > len(text)
        score = BIAS + (SHORT if n < 5 else LONG if n >= 12 else 0) + (LINKS if links else 0)
        if text[-1] in ".!?…。":
            score += SENTENCE
        if holder.tag[0] == "h" and holder.tag[1:].isdigit():
            score += HEADING
        score = score * min(n, FULL) // FULL
        if element is not None and element.score > 0 and (element.article or not links):
            score = max(score, 0)
        self.score = score


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    root = top = Frame("#root", None, "")
    runs: list[tuple[str, Frame]] = []  # texts of the open block and what they lie in
    holder = root
    open_: dict[str, int] = {}
    unclosed: set[str] = set()  # tags without an end tag in what is left of the page
    tag_at, ended = _TAG.match, False  # ended: no tag ends in what is left of the page
    line = 0

    def flush() -> None:
        nonlocal line
        if not runs:
            return
        groups: dict[int, list] = {}
        last = None
        for position, (text, frame) in enumerate(runs):
            if not text.isspace() or last is None:
                last = groups.setdefault(id(frame.element), [frame.element, [], 0, False])
            last[1].append((position, text))
            if not text.isspace():
                last[3] = True
                last[2] += len(text) if frame.link else 0
        runs.clear()
        found = [g for g in groups.values() if g[3]]
        for element, pieces, linked, _ in sorted(found, key=lambda g: g[0] is not holder.element):
            out.append(Block(pieces, linked, holder, element, line))
        line += bool(found)

    at, size = 0, len(html)
    while at < size:
        if html[at] != "<":
            end = html.find("<", at)
            end = size if end < 0 else end
            text = unescape(html[at:end])
            at = end
            if runs or not text.isspace():
                holder = holder if runs else top.holder
                runs.append((text, top))
            continue
        m = None
        if html.startswith("<!--", at):
            at = _COMMENT.match(html, at).end()
            continue
        if not ended and html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            if end >= 0:
                at = end + 1
                continue
            ended = True
        if not ended and (html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] == "/"):
            m = tag_at(html, at)
            if m is None and (html[at + 1].isalpha() or html[at + 2 : at + 3].isalpha()):
                tag_at = _PLAIN_TAG.match
                m = tag_at(html, at)
                ended = html.find(">", at) < 0
        if m is None:
            at += 1
            holder = holder if runs else top.holder
            runs.append(("<", top))
            continue
        at = m.end()
        tag = m[2].lower()
        block = is_block(tag)
        if m[1]:
            if block:
                flush()
            if open_.get(tag):
                f = top
                while f.tag != tag and (block or f.holder is not f):
                    f = f.parent
                if f.tag == tag:
                    while top is not f:
                        open_[top.tag] -= 1
                        top = top.parent
                    open_[tag] -= 1
                    top = f.parent
            continue
        if tag in RAW:
            if tag == "head":
                flush()
            elif not (tag == "svg" and m[3].endswith("/")) and tag not in unclosed:
                end = _RAW_END[tag].search(html, at)
                close = html.find(">", end.end()) if end else -1
                if close >= 0:
                    at = close + 1
                elif tag in ENDLESS:
                    at = size
                else:
                    unclosed.add(tag)
            continue
        if block:
            flush()
            closed, f = CLOSED_BY.get(tag, ()), top.near
            while f is not None:
                if f.tag == "p" or f.tag in closed or f.tag == tag and tag[0] == "h":
                    while top is not f.parent:
                        open_[top.tag] -= 1
                        top = top.parent
                elif f.tag in SCOPES:
                    break
                f = f.parent.near
        elif tag == "br" and runs:
            runs.append((" ", top))
        if tag not in VOID and not m[3].endswith("/"):
            top = Frame(tag, top, m[3])
            open_[tag] = open_.get(tag, 0) + 1
    flush()
    return out


def element_scores(found: list[Block]) -> dict[int, int]:
    """Log-odds of the elements that hold blocks, by id."""
    seen: dict[int, Frame] = {}
    plain: dict[int, int] = {}
    for b in found:
        e = b.element
        if e is not None:
            plain[id(e)] = plain.get(id(e), 0) + b.plain
        while e is not None and id(e) not in seen:
            seen[id(e)] = e
            e = e.parent.element
    total = sum(b.plain for b in found)
    for e in sorted(seen.values(), key=lambda e: -e.depth):
        # what an article holds is no evidence for a form or a sidebar around it
        if e.tag not in GOOD_TAGS and (up := e.parent.element) is not None:
            plain[id(up)] = plain.get(id(up), 0) + plain.get(id(e), 0)
    scores = {}
    for i, e in seen.items():
        scores[i] = HIDDEN if e.hidden else e.score
        if not e.hidden and e.score <= HEADER:
            # a bad name is less likely to be right for most of the page; doubtful ones follow what they hold anyway
            scores[i] += max(0, WHOLE * (2 * plain.get(i, 0) - total) // max(total, 1))
    return scores


def graph(found: list[Block]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Terminal capacities of the blocks, then of the elements that hold them, and smoothness capacities between i < j."""
    terminal, out = [b.score for b in found], {}
    last: dict[tuple[int, int], int] = {}
    node: dict[int, int] = {}
    scores = element_scores(found)
    main = None
    for j, b in enumerate(found):
        parent = b.holder.parent or b.holder
        if main is not None and found[main].line == b.line:
            out[main, j] = INLINE
        else:
            if main is not None:
                a = found[main].holder
                near = (a.parent or a) is parent or a is parent or b.holder is (a.parent or a)
                out[main, j] = OTHER if found[main].element is not b.element else NEAR if near else FAR
            if (i := last.get((id(parent), id(b.element)))) is not None:
                out[i, j] = out.get((i, j), 0) + SIBLING
            last[id(parent), id(b.element)] = main = j
        if b.element is not None:
            if id(b.element) not in node:
                node[id(b.element)] = len(terminal)
                terminal.append(scores[id(b.element)])
            out[j, node[id(b.element)]] = HOLD
    return terminal, out


def minimum_cut(terminal: list[int], smooth: dict[tuple[int, int], int]) -> list[bool]:
    """Labels (True: source side) of least total cost.

    terminal[i] > 0 is the capacity from the source, < 0 that to the sink; smooth[i, j] joins i and j
    both ways. Blocks that are level go to the sink side.
    """
    n = len(terminal)
    h, beside = list(terminal), [{} for _ in range(n)]
    for (i, j), w in smooth.items():
        if i != j and w > 0:
            beside[i][j] = beside[i].get(j, 0) + w
            beside[j][i] = beside[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    around = [sum(x.values()) for x in beside]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or h[i] <= around[i] and -h[i] < around[i]:
            continue
        label[i] = h[i] > around[i]
        for j, w in beside[i].items():
            if label[j] is None:
                h[j] += w if label[i] else -w
                around[j] -= w
                queue.append(j)
    for begin in range(n):
        if label[begin] is None:
            part, label[begin] = [begin], False
            for i in part:
                for j in beside[i]:
                    if label[j] is None:
                        label[j] = False
                        part.append(j)
            for i, side in zip(part, max_flow_sides(part, h, beside), strict=True):
                label[i] = side
    return label


def max_flow_sides(rest: list[int], h: list[int], beside: list[dict[int, int]]) -> list[bool]:
    """Whether each node of rest is reachable from the source after a maximum flow."""
    at = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    left: list[dict[int, int]] = [{} for _ in range(len(rest) + 2)]
    for i, k in at.items():
        for j, w in beside[i].items():
            if j in at:
                left[k][at[j]] = w
        if h[i] > 0:
            left[source][k], left[k][source] = h[i], 0
        elif h[i] < 0:
            left[k][sink], left[sink][k] = -h[i], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(len(rest))]
        ways, path = {u: iter(left[u]) for u in level}, [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= push
                    left[b][a] = left[b].get(a, 0) + push
                # back to before the first edge that is full, whose way is tried again
                stop = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if not left[a][b])
                del path[stop + 1 :]
                continue
            for v in ways[u]:
                if left[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()


def main_text(html: str) -> str:
    found = blocks(html)
    lines: dict[int, list[tuple[int, str]]] = {}
    for b, keep in zip(found, minimum_cut(*graph(found))):
        if keep:
            lines.setdefault(b.line, []).extend(b.pieces)
    return "\n".join(" ".join("".join(x for _, x in sorted(pieces)).split()) for _, pieces in sorted(lines.items()))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars (long): one row per page, without a shuffle."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(html)]
            yield arrow_rows(batch, [key, url], {"text": (texts, pa.string()), "n_chars": ([len(t) for t in texts], pa.int64())})

    return df.select(key, url, html).mapInArrow(run, schema_of(df, [key, url], "text string, n_chars bigint"))
