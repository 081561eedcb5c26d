"""Chat formatting by quotation linking.

Lines that begin with > marks are quoted, as deep as they have marks. Runs of lines of one depth are
passages; they are normalised (marks off, lower case, white space folded) and hashed, whole and line by
line, as are the unquoted bodies of all messages. A line that announces a quote (ANNOUNCED) belongs to it
if a quoted line follows, at once or after one blank line; elsewhere it is prose and stays. A passage links
to the earliest message of its own conversation with an equal unit, or else to the earliest anywhere, in either case only to one before
the quoting message in order of (conv_id, turn). A message replies to the one that its passages of
depth one match by most characters, ties to the earlier; with `follow` one that quotes nothing known replies to the
turn before it in its own conversation. Ancestors are found by pointer doubling, so deep threads take few rounds.

A conversation is the messages of one root in reply order: by depth, then conv_id and turn, so that every reply
comes after what it replies to. It is a list of turns without quotes, in parts of at most PART turns.

Everything is DataFrame expressions. Originals are cut to one row per unit before any join, so a line
that thousands of messages hold costs one row on that side; lines and messages that many quote are joined by
broadcast (join_unique), and places in a conversation are counted over all tasks, so neither a line nor a
conversation that a third of all messages share meets in one task.

Null text counts as empty, without passages. Messages that quote nothing known, and follow none, are roots of their own.
Depths from most_levels on count as most_levels; None, as the query has it, sets no bound. Rows that repeat a conv_id and turn keep their own bodies and
share one parent, the earliest of theirs; a null conv_id or turn never links, and each such message is a conversation by itself. Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_unique, places, written

MOST_LEVELS = 16
#: Turns of a part of a conversation.
PART = 256
#: Doublings before giving up; each doubles the depth of threads that is covered.
ROUNDS = 40
#: White space; the classes of Java and of SQL engines differ.
_BLANK = r" \t\n\x0B\f\r"
_QUOTED = r"^[ \t]*>"
ANNOUNCED = r"\b(?:wrote|schrieb|a écrit|escribió)\b.*:[ \t\r]*$"


def normalised(line: Column) -> Column:
    """Quote marks of one line off, lower case, white space folded and trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, r"^[ \t]*>[ \t>]*", "")), f"[{_BLANK}]+", " "))


def folded(lines: Column) -> Column:
    """The normalised whole of lines: their normalised forms with single spaces between them."""
    return F.array_join(F.filter(F.transform(lines, normalised), lambda x: x != ""), " ")


def bodies(messages: DataFrame) -> DataFrame:
    """messages with line and level arrays of their text, and body: the text without quoted lines and their announcements.

    Lines are array elements, so no pattern sees more than one of them. Arrays that are read by place are
    columns of their own: an expression would be evaluated for every place.
    """
    marks = lambda x: F.regexp_extract(x, r"^[ \t>]*", 0)
    depth = lambda x: F.length(marks(x)) - F.length(F.replace(marks(x), F.lit(">"), F.lit("")))
    cut = messages.withColumn("line", F.split("text", "\n"))
    cut = cut.withColumn("level", F.transform("line", depth))
    cut = cut.withColumn("quoted", F.transform("level", lambda n: n > 0))
    blank = lambda i: F.coalesce(F.trim(F.get("line", i)).rlike(f"^[{_BLANK}]*$"), F.lit(False))
    then = lambda i: F.coalesce(F.get("quoted", i), F.lit(False))
    kept = F.filter("line", lambda x, i: ~F.get("quoted", i) & ~(x.rlike(ANNOUNCED) & (then(i + 1) | blank(i + 1) & then(i + 2))))
    return cut.withColumn("body", F.trim(F.array_join(kept, "\n"))).drop("quoted")


def _passages(messages: DataFrame, most_levels: int | None) -> DataFrame:
    """conv_id, turn, key, level and lines of every run of quoted lines of one depth."""
    key = ["key", "conv_id", "turn"]
    bounded = F.transform("level", lambda n: F.least(n, F.lit(most_levels))) if most_levels else F.col("level")
    lines = messages.filter(F.exists("level", lambda n: n > 0)).select(*key, "line", bounded.alias("level"))
    places_ = F.sequence(F.lit(0), F.size("level") - 1)
    firsts = F.filter(places_, lambda i: (i == 0) | (F.get("level", i) != F.get("level", i - 1)))
    runs = lines.select(*key, "line", "level", firsts.alias("first"))
    lasts = F.concat(F.transform(F.slice("first", 2, F.size("first")), lambda i: i - 1), F.array(F.size("line") - 1))
    runs = runs.select(*key, "line", "level", F.explode(F.arrays_zip("first", lasts.alias("last"))).alias("run"))
    runs = runs.filter(F.get("level", "run.first") > 0)
    held = F.slice("line", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1)
    return runs.select(*key, F.get("level", "run.first").alias("level"), held.alias("lines"))


def units(lines: Column) -> Column:
    """The normalised whole of lines and each normalised line, without blanks or repeats."""
    return F.filter(F.array_distinct(F.concat(F.array(folded(lines)), F.transform(lines, normalised))), lambda x: x != "")


def _links(messages: DataFrame, texts: DataFrame, most_levels: int | None, rows: int) -> tuple[DataFrame, DataFrame]:
    """Units of quoted passages with what they link to, and the counts of each message."""
    quoted = _passages(messages, most_levels).withColumn("passage_id", F.xxhash64("level", F.array_join("lines", "\n")))
    asked = quoted.select("key", "conv_id", "turn", "level", "passage_id", F.explode(units(F.col("lines"))).alias("unit"))
    asked = checkpoint(asked.select("key", "conv_id", "turn", "level", "passage_id", F.xxhash64("unit").alias("hash"), F.length("unit").alias("weight")).distinct())
    held = texts.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units(F.split("body", "\n"))).alias("unit")).select("conv_id", "turn", F.xxhash64("unit").alias("hash"))
    # what nobody quotes goes first; minima are taken before the shuffle
    nearby = held.groupBy("conv_id", "hash").agg(F.min("turn").alias("here")).join(asked.select("hash").distinct(), "hash", "left_semi")
    nearby = checkpoint(nearby)
    anywhere = checkpoint(nearby.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("here").alias("turn"))).alias("there")))
    own = F.struct("conv_id", "turn")
    joined = join_unique(checkpoint(join_unique(asked, nearby, ["conv_id", "hash"], rows)), anywhere, ["hash"], rows)
    target = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn"))).when(F.col("there") < own, F.col("there"))
    linked = checkpoint(joined.select("key", "conv_id", "turn", "level", "passage_id", "weight", target.alias("target")))
    counts = linked.groupBy("key", "passage_id").agg(F.max("level").alias("level"), F.max(F.col("target").isNotNull().cast("int")).alias("found"))
    counts = counts.groupBy("key").agg(F.max("level").alias("n_levels"), F.count("*").alias("n_passages"), F.sum("found").alias("n_linked"))
    return linked, counts


def _before(messages: DataFrame) -> DataFrame:
    """conv_id, turn and parent: the turn before it of the same conversation."""
    turns = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    laid = checkpoint(places(turns, ["conv_id"], ["turn"], "n"))
    last = laid.select("conv_id", F.col("turn").alias("last"), (F.col("n") + 1).alias("n"))
    return laid.join(last, ["conv_id", "n"]).select("conv_id", "turn", F.struct("conv_id", F.col("last").alias("turn")).alias("parent"))


def _ancestors(parents: DataFrame, rows: int) -> DataFrame:
    """conv_id, turn, root (struct) and depth of every message that has a parent."""
    state, done = checkpoint(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth"))), None
    for _ in range(ROUNDS):
        up = state.select(F.struct("conv_id", "turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if done is not None:
            up = up.unionByName(done.select(F.struct("conv_id", "turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more")))
        joined = checkpoint(join_unique(state, up, ["root"], rows))
        ended = joined.filter("next is null").select("conv_id", "turn", "root", "depth")
        done = checkpoint(ended if done is None else done.unionByName(ended))
        state = checkpoint(joined.filter("next is not null").select("conv_id", "turn", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")))
        if state.isEmpty():
            return done
    raise RuntimeError("threads did not settle")


def _threads(df: DataFrame, most_levels: int | None, follow: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with role and body by a number of their own, _row; and by that number all else, narrow: _tie sorts equal places."""
    messages = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    messages = bodies(messages.withColumn("key", F.xxhash64("conv_id", "turn", "text")))
    held = written(messages.select("conv_id", "turn", "role", "body", "key", F.monotonically_increasing_id().alias("_row")))
    rows = held.count()
    linked, counts = _links(messages, held, most_levels, rows)
    votes = linked.filter("level = 1 and target is not null").groupBy("conv_id", "turn", "key", "target").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy("conv_id", "turn", "key").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("target").alias("t")))["t"].alias("target"))
    parents = checkpoint(best.groupBy("conv_id", "turn").agg(F.min("target").alias("parent")))
    if follow:
        before = _before(held).join(parents.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
        parents = checkpoint(parents.unionByName(before))
    threads = checkpoint(_ancestors(parents, rows).join(parents, ["conv_id", "turn"]))
    narrow = held.select("conv_id", "turn", "key", "_row", _tie().alias("_tie"))
    out = join_unique(checkpoint(join_unique(narrow, checkpoint(counts), ["key"], rows)), threads, ["conv_id", "turn"], rows)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = out.select(
        "conv_id", "turn", none("n_levels"), none("n_passages"), none("n_linked"), F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("root.conv_id", "conv_id").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"), none("depth"), "_row", "_tie",
    )
    return held.select("_row", "role", "body"), out


def _tie() -> Column:
    """Sorts rows of one place by role and body, in a few bytes."""
    return F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.col("body")))


SHOWN = ["conv_id", "turn", "role", "body", "n_levels", "n_passages", "n_linked", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth"]


def link(df: DataFrame, most_levels: int | None = MOST_LEVELS, follow: bool = False) -> DataFrame:
    """One row per message: conv_id, turn, role, body (without quotes), n_levels, n_passages, n_linked,
    parent_conv, parent_turn, root_conv, root_turn and depth (all long but role and body)."""
    texts, narrow = _threads(df, most_levels, follow)
    return texts.join(narrow, "_row").select(*SHOWN)


def _positioned(narrow: DataFrame) -> DataFrame:
    alone = narrow.filter("conv_id is null or turn is null").withColumn("position", F.lit(1).cast("bigint"))
    placed = places(narrow.filter("conv_id is not null and turn is not null"), ["root_conv", "root_turn"], ["depth", "conv_id", "turn", "_tie"], "position")
    return placed.unionByName(alone)


def ordered(linked: DataFrame) -> DataFrame:
    """Rows of link with position, from 1: their place in the reply order of their conversation."""
    return _positioned(linked.withColumn("_tie", _tie())).drop("_tie")


def conversations(df: DataFrame, most_levels: int | None = MOST_LEVELS, follow: bool = False) -> DataFrame:
    """root_conv, root_turn, part (from 0) and turns: PART messages of a conversation in reply order, without quotes.

    A turn is a struct of position and the other columns of link; messages without conv_id or turn are lists of one.
    Bodies meet their places once and are dealt by part.
    """
    texts, narrow = _threads(df, most_levels, follow)
    rows = texts.join(_positioned(narrow), "_row")
    shown = [c for c in SHOWN if c not in ("root_conv", "root_turn")]
    rows = rows.withColumn("part", F.floor((F.col("position") - 1) / PART)).withColumn("message", F.struct("position", *shown)).select("root_conv", "root_turn", "part", "message")
    loose = F.col("message.conv_id").isNull() | F.col("message.turn").isNull()
    lists = rows.filter(~loose).groupBy("root_conv", "root_turn", "part").agg(F.sort_array(F.collect_list("message")).alias("turns"))
    return lists.unionByName(rows.filter(loose).select("root_conv", "root_turn", "part", F.array("message").alias("turns")))
