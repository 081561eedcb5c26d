"""Spelling variants: a trie self-join with active-node sets over a prefix-partitioned vocabulary.

The vocabulary is the counted runs of letters of all texts. Two words are near if one inserted, deleted or replaced code
point makes them equal. Walking down a trie, each node carries its active nodes: those at distance one. The active nodes
of a child by letter c are the children by c of its parent's active nodes, its parent, its siblings and its own children;
words that end at a node and at one of its active nodes are a pair.

The vocabulary is partitioned by prefixes of CUT code points, each prefix with more than GROUP words by longer ones. Where a
prefix is split, a pair either has the same next CUT code points, and meets below them, or it differs within them and is
equal after: so heads of CUT code points, or of one more, that have the same rest meet in a trie of their own. There are
no more of those than there are different heads. Every task walks tries of single groups, at most GROUP words at once.

A trie is a sorted list of strings; its nodes are ranges of it, so a long word costs no nodes, and a walk ends where a word
is alone. Null texts have no words. Words are distinct by code points; ties of counts go to the smaller word in code-point
order. Without words the result is empty; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: Code points of a prefix, and words of a trie at most.
CUT, GROUP = 3, 4096
#: Words that a task counts before it hands them on.
HELD = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int = 0) -> DataFrame:
    """word and n of the runs of letters, A-Z in lower case.

    slip plants misspellings: a run of which the CRC-32 of `<key>:<run>` is a multiple of slip loses one code point
    (a null key reads as nothing).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, counts = re.compile(RUN), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in batches:
            for k, t in zip(batch.column("_key"), batch.column("_text"), strict=True):
                lower = (t.as_py() or "").encode().translate(_LOWER).decode()
                found = Counter(w for w in run.findall(lower) if len(w) >= least_chars)
                if slip:
                    start = zlib.crc32(f"{k.as_py() or ''}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % slip:
                            counts[w] += n
                        elif len(w) > least_chars:
                            counts[w[: (at := h % len(w))] + w[at + 1 :]] += n
                else:
                    counts.update(found)
                if len(counts) >= HELD:
                    yield out()
        if counts:
            yield out()

    given = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return given.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def trie_pairs(strings: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j) of sorted distinct strings at distance one, each pair both ways."""
    known: dict[int, dict[tuple[int, int, int], dict[str, tuple[int, int, int]]]] = {}

    def children(node: tuple[int, int, int]) -> dict[str, tuple[int, int, int]]:
        lo, hi, depth = node
        if hi - lo == 1:
            s = strings[lo]
            return {s[depth]: (lo, hi, depth + 1)} if len(s) > depth else {}
        at = known.setdefault(depth, {})
        if (found := at.get(node)) is None:
            found, i = {}, lo + (len(strings[lo]) == depth)
            while i < hi:
                c, j = strings[i][depth], i + 1
                while j < hi and strings[j][depth] == c:
                    j += 1
                found[c] = (i, j, depth + 1)
                i = j
            at[node] = found
        return found

    ends = lambda node: len(strings[node[0]]) == node[2]
    root, depth = (0, len(strings), 0), 0
    active = set(children(root).values())
    if ends(root):
        yield from ((root[0], a[0]) for a in active if ends(a))
    level = [(root, active)]
    while level:
        deeper = []
        for node, active in level:
            own = children(node)
            for c, child in own.items():
                near = {x for a in active if (x := children(a).get(c))}
                if node[1] - node[0] > 1:  # other words are below the parent
                    near.add(node)
                    near.update(own.values())
                    near.discard(child)
                if child[1] - child[0] > 1:
                    near.update(children(child).values())
                if near and ends(child):
                    yield from ((child[0], a[0]) for a in near if ends(a))
                if near:
                    deeper.append((child, near))
        level = deeper
        known.pop(depth - 1, None)
        depth += 1


def _groups(words: DataFrame) -> DataFrame:
    """Rows of (level, prefix, rest, string, whole, word, n) whose groups by (level, prefix, rest) hold all near pairs.

    whole: 0 marks a head of CUT + 1 code points, which is not compared with its like.
    """
    pending, level, parts = words, 0, []
    while True:
        prefix = F.substring("word", 1, CUT * level)
        split = checkpoint(pending.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("size")).filter(F.col("size") > GROUP))
        named = pending.withColumn("prefix", prefix)
        small = named.join(split, "prefix", "left_anti")
        parts.append(small.select(F.lit(level).alias("level"), "prefix", F.lit(None).cast("string").alias("rest"), F.substring("word", CUT * level + 1, 1 << 30).alias("string"), F.lit(1).alias("whole"), "word", "n"))
        if split.isEmpty():
            break
        large = checkpoint(named.join(split.select("prefix"), "prefix", "left_semi"))
        for more in (0, 1):
            head, rest = F.substring("word", CUT * level + 1, CUT + more), F.substring("word", CUT * (level + 1) + more + 1, 1 << 30)
            long_enough = F.char_length("word") >= CUT * (level + 1) + more
            held = large.filter(long_enough) if more else large
            parts.append(held.select(F.lit(level).alias("level"), "prefix", rest.alias("rest"), head.alias("string"), F.lit(1 - more).alias("whole"), "word", "n"))
        pending, level = large.drop("prefix"), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each group of rows, which come sorted by group and string."""
    group, rows, out = None, [], []

    def pairs() -> None:
        if len(rows) > 1:
            for i, j in trie_pairs([r[0] for r in rows]):
                if rows[i][1] or rows[j][1]:
                    out.append((rows[i][2], rows[j][2], rows[j][3]))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "near", "near_n"])

    for b in batches:
        for *at, string, whole, word, n in zip(*[b.column(c).to_pylist() for c in ("level", "prefix", "rest", "string", "whole", "word", "n")], strict=True):
            if at != group:
                pairs()
                group = at
                rows.clear()
                if len(out) > HELD:
                    yield batch()
            rows.append((string, whole, word, n))
    pairs()
    if out:
        yield batch()


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near and near_n (its n) of (word, n): every pair at distance one, both ways."""
    key = ["level", "prefix", "rest"]
    dealt = _groups(words).repartition(*key).sortWithinPartitions(*key, "string", "word")
    return dealt.mapInArrow(_walk, "word string, near string, near_n bigint").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms are followed to the last, twice as far each round."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        met = checkpoint(now.join(jump, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = met.drop("moved")
        if met.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of (word, n).

    A word's form is its near word of largest n, if that is at least `times` its own; its root is where forms lead.
    """
    words = written(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.n") >= F.lit(times) * F.col("n")
    met = checkpoint(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")))
    last = roots(met.filter("form is not null"))
    return met.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
