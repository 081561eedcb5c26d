"""Line dedup: normalised lines are exploded and hashed, documents are counted for each hash, lines of hashes that too many
documents hold are dropped, and texts are put together again by position.

Texts are cut at line feeds; null and empty texts are one empty line. A line's key is the line without white space (space,
0x09 to 0x0D) at its ends, A-Z in lower case. Keys of at least LEAST_CHARS code points that at least LEAST_DOCS documents
hold lose all their lines except in the smallest document that holds them, which keeps its repeats too.

Keys are compared by two 64-bit hashes with different seeds. Documents are told apart by their key column: rows of one key
are one document, rows without a key are one document that comes after all others. Repeated rows are cut alike. Other
columns are kept; n_lines, n_dropped and kept_text take the place of columns of those names.

Counts are merged before their shuffle, so a line that a third of all documents hold costs one row for each task. To learn
which lines go, hashes of lines (never the lines) meet the hashes to drop; a frequent hash is dealt to as many slots as its
lines need. Only then does a text move, once, to meet its own list of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FREQUENT_ROWS, FREQUENT_SHARE, written

LEAST_CHARS, LEAST_DOCS = 10, 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEED = 20240229


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(lines(F.translate(text, _UPPER, _UPPER.lower())), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))


def _hashed(held: DataFrame, least_chars: int) -> DataFrame:
    """_key, _text_hash, at, h1 and h2 of every line that is long enough."""
    rows = held.select("_key", "_text_hash", F.posexplode(keys(F.col("_text"))).alias("at", "line"))
    return rows.filter(F.char_length("line") >= least_chars).select("_key", "_text_hash", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(_SEED), "line").alias("h2"))


def shared(hashed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, first (the smallest document) and n_rows of hashes that least_docs documents hold."""
    unnamed = F.max(F.col("_key").isNull().cast("int"))
    found = [F.min("_key").alias("first"), F.count("*").alias("n_rows")]
    if least_docs == 2:  # two documents differ when the smallest and the largest do, which needs no set of documents
        counted = hashed.groupBy("h1", "h2").agg(*found, ((F.min("_key") < F.max("_key")).cast("int") + unnamed).alias("more"))
        return counted.filter("more > 0 and first is not null").drop("more")
    documents = F.count_distinct("_key") + unnamed
    return hashed.groupBy("h1", "h2").agg(*found, documents.alias("documents")).filter(F.col("documents") >= least_docs).drop("documents")


def _dropped(hashed: DataFrame, common: DataFrame) -> DataFrame:
    """_key, _text_hash and places, the positions of the lines that go."""
    rows = common.agg(F.sum("n_rows")).first()[0] or 0
    most = max(FREQUENT_ROWS, rows // FREQUENT_SHARE)
    # at most FREQUENT_SHARE hashes have more rows than that
    often = F.broadcast(common.filter(F.col("n_rows") > most).select("h1", "h2", F.ceil(F.col("n_rows") / most).cast("int").alias("slots")))
    slots = F.coalesce("slots", F.lit(1))
    left = hashed.join(often, ["h1", "h2"], "left").withColumn("slot", F.pmod(F.xxhash64("_key", "_text_hash", "at"), slots).cast("int")).drop("slots")
    right = common.join(often, ["h1", "h2"], "left").select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    gone = left.join(right, ["h1", "h2", "slot"]).filter(~F.col("_key").eqNullSafe(F.col("first")))
    return gone.groupBy("_key", "_text_hash").agg(F.collect_set("at").alias("places"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """df with n_lines, n_dropped (long) and kept_text."""
    if least_docs < 2:
        raise ValueError("a line is shared by two documents at least")
    new = {"n_lines", "n_dropped", "kept_text"}
    rest = [c for c in df.columns if c not in new]
    held = df.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"), F.struct(*rest).alias("_row"))
    hashed = _hashed(held, least_chars)
    places = _dropped(hashed, written(shared(hashed, least_docs))).withColumnsRenamed({"_key": "_k", "_text_hash": "_h"})
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text_hash") == F.col("_h"))
    met = held.join(places.hint("shuffle_hash"), same, "left").withColumn("_lines", lines(F.col("_text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "places")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    whole = F.when(F.col("places").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept)
    n_dropped = F.coalesce(F.size("places"), F.lit(0)).cast("bigint")
    return met.select("_row.*", F.size("_lines").cast("bigint").alias("n_lines"), n_dropped.alias("n_dropped"), whole.alias("kept_text"))
