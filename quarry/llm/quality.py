"""Quality rules: structural counts, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Two multinomials over hashed buckets are counted from whole texts: one over trusted documents, one
over all. A document's score is the mean, over its uni- and bigrams, of the log-ratio of its buckets'
probabilities; it is kept if it is not below THRESHOLD and the structural rules hold. Log-ratios are
rounded to millionths and summed as integers, so verdicts do not depend on the order of addition.

Everything is DataFrame expressions: counting explodes n-grams into a pre-aggregated count of BUCKETS
rows, scoring reads the ratios from one array of that fixed size. Texts are not shuffled, except to count n-grams
where more ids are trusted than common.with_ids broadcasts.

Words are runs of characters other than space and 0x09 to 0x0D; tokens of n-grams are runs of ASCII
punctuation or of anything else but white space. Null text has no words; fewer than LEAST_WORDS fail.
Windows of three words are compared by 64-bit hashes. Without any trusted document all ratios are 0.
Repeated rows are judged alike, each on its own; other columns are kept, but scores puts its own in place of those of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, with_ids, words

BUCKETS = 1 << 15
#: Pseudo-count of every bucket.
SMOOTHING = 1.0
#: Least mean log-ratio, in millionths.
THRESHOLD = -250_000
LEAST_WORDS = 50
#: Most hundredths of the words that may lie in repeated windows.
REPEAT_PERCENT = 50
PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def tokens(text: Column) -> Column:
    """Words, cut where ASCII punctuation begins or ends (one replacement and one split: no match objects)."""
    return words(F.regexp_replace(text, PUNCTUATION, " $0 "))


def bucket(code: Column, before: Column | None = None) -> Column:
    """The bucket of a token's CRC-32, or of a pair of them."""
    mixed = code if before is None else before * F.lit(31) + code + F.lit(1)
    return F.pmod(mixed, F.lit(BUCKETS)).cast("int")


def window_hashes(w: Column) -> Column:
    """A hash of each window of three words."""
    n = F.size(w)
    found = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n >= 3, found).otherwise(F.array().cast("array<bigint>"))


def placed(h: Column) -> Column:
    """Hashes with their places, sorted."""
    return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))


def structure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    out = df.withColumns({"_w": words(F.col(text)), "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_h": window_hashes(F.col("_w")),
    }).drop("_w", "_lines")
    # most texts repeat no window; only the others are sorted
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed(F.col("_h")))).drop("_h")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = F.filter("_s", lambda x, i: same(F.get("_s", i - 1), x) | same(F.get("_s", i + 1), x))
    at = F.sort_array(F.transform(twice, lambda x: x["p"]))
    out = out.withColumn("_p", at).drop("_s")
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get("_p", i - 1), p - 3)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")).drop("_p")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def counts(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, raw and target counts of the n-grams of all documents and of those whose key is in trusted."""
    ids = trusted.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn("_trusted", F.lit(1))
    marked = with_ids(df.select(key, text), ids, "left", key)
    t = marked.select(F.coalesce("_trusted", F.lit(0)).alias("trusted"), tokens(F.col(text)).alias("t"))
    pairs = t.select("trusted", F.inline(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))).alias("a", "b"))
    codes = pairs.select("trusted", F.crc32("a").alias("a"), F.crc32("b").alias("b"))
    grams = codes.select("trusted", F.explode(F.array(bucket(F.col("a")), bucket(F.col("b"), F.col("a")))).alias("bucket")).filter("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))


def ratios(counted: DataFrame) -> DataFrame:
    """One row, one array of BUCKETS log-ratios in millionths."""
    spark = counted.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("x"), F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    smooth = lambda n, total: (n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * BUCKETS))
    one = lambda x: F.round(F.log(smooth(x["target"], F.col("all_target")) / smooth(x["raw"], F.col("all_raw"))) * 1e6).cast("bigint")
    return rows.select(F.transform("x", lambda x: F.when(F.col("all_target") > 0, one(x)).otherwise(F.lit(0).cast("bigint"))).alias("ratios"))


def scores(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """df with the structural columns, n_grams, llr (sum, in millionths), score (mean log-ratio) and kept."""
    out = structure(df, text).withColumn("_c", F.transform(tokens(F.col(text)), lambda x: F.crc32(x)))
    ones, twos = F.transform("_c", lambda x: bucket(x)), F.transform("_c", lambda x, i: bucket(x, F.get("_c", i - 1)))
    out = out.withColumn("_b", F.concat(ones, F.slice(twos, F.lit(2), F.greatest(F.size(twos) - 1, F.lit(0))))).drop("_c")
    # the array of ratios is a scalar subquery, named once so that the optimizer puts it in place
    out = out.withColumn("_r", ratios(counts(df, trusted, key, text)).scalar())
    llr = F.aggregate("_b", F.lit(0).cast("bigint"), lambda a, x: a + F.get(F.col("_r"), x))
    out = out.withColumns({"n_grams": F.size("_b").cast("bigint"), "llr": llr}).drop("_b", "_r")
    out = out.withColumn("score", F.when(F.col("n_grams") > 0, F.col("llr") / F.col("n_grams") / 1e6).otherwise(F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold) * F.col("n_grams")))


def keep(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that pass, with the columns of df."""
    held = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
    scored = scores(held, trusted.select(F.col(key).alias("_key")), "_key", "_text")
    # a row number in the projection keeps the filter above it; pushed down, it would repeat the whole expression
    passed = scored.select("_row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("kept")).filter("kept")
    return passed.select("_row.*")
