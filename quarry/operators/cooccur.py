"""Co-occurrence statistics: document frequencies, pairs, PPMI neighbours, query expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import bounded
from .settle import settled as _settled
from .settle import small_batches, stored

#: Documents that Python gets at a time, and those of a row that it packs.
DOCUMENTS, PACKED_DOCUMENTS = 512, 10_000
#: Terms of a block: a task forms the pairs of two blocks of a document at a time.
BLOCK = 512


def document_terms(docs: DataFrame) -> DataFrame:
    """(doc, term) from (doc, terms): every distinct term of a document, however many there are."""
    return docs.select("doc", F.explode(F.array_distinct("terms")).alias("term"))


def frequencies(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def _vocabulary(frequencies: DataFrame, least: int) -> DataFrame:
    """term and code of terms in `least` documents or more: df in the upper half, place in term order in the lower."""
    common = frequencies.filter(F.col("df") >= least).orderBy("term")
    placed = _settled(common.select("term", "df", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a number for each partition
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    if before >= 1 << 32:
        raise ValueError("too many terms for their codes")
    place = F.col("at").bitwiseAND((1 << 33) - 1) + (F.create_map(*offsets)[part] if offsets else F.lit(0))
    return placed.select("term", F.shiftleft("df", 32).bitwiseOR(place).alias("code"))


def _place(code: str) -> Column:
    return F.col(code).bitwiseAND((1 << 32) - 1)


def _held(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc and t, the sorted codes of its terms."""
    return terms.join(vocabulary, "term").groupBy("doc").agg(F.sort_array(F.collect_list("code")).alias("t"))


def _counted(held: DataFrame, least: int) -> DataFrame:
    """Codes a < b and n, the documents that hold both, of documents' sorted codes t.

    Pairs are formed inside each document's array, so no join multiplies rows before aggregation. A long
    document is dealt out by pairs of its blocks.
    """
    last = F.floor((F.size("t") - 1) / BLOCK).cast("int")
    rows = held.select("t", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    rows = rows.select("t", "i", F.explode(F.sequence("i", "last")).alias("j"))
    block = lambda k: F.slice("t", F.col(k) * BLOCK + 1, BLOCK)
    dealt = rows.select(block("i").alias("x"), block("j").alias("y"), (F.col("i") == F.col("j")).alias("own")).repartition(_tasks(held))
    firsts = dealt.select("y", "own", F.posexplode("x").alias("k", "a"))
    rest = F.slice("y", F.when(F.col("own"), F.col("k") + 2).otherwise(1), F.size("y"))
    return firsts.select("a", F.explode(rest).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pairs(terms: DataFrame, least: int = 2) -> DataFrame:
    """a < b and n, the documents that hold both; rare terms go first, since their pairs cannot count."""
    vocabulary = _vocabulary(frequencies(terms), least)
    named = lambda c: vocabulary.toDF(f"t{c}", c)
    both = _counted(_held(terms, vocabulary), least).join(named("a"), "a").join(named("b"), "b")
    return both.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"), "n")


def _worded(docs: DataFrame) -> DataFrame:
    """Many documents a row: an id, their distinct terms and counts of documents, and the numbers of those that each holds."""

    most = PACKED_DOCUMENTS

    def row(i: int, lengths: list[np.ndarray], numbers: list[pa.DictionaryArray]) -> pa.RecordBatch:
        same = pa.chunked_array(numbers).unify_dictionaries()
        terms, found = same.chunk(0).dictionary, []
        for sizes, chunk in zip(lengths, same.chunks, strict=True):
            keys = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * max(1, len(terms)) + chunk.indices.to_numpy()
            found.append((np.sort(keys) % max(1, len(terms))).astype(np.int32))
        found, sizes = np.concatenate(found), np.concatenate(lengths)
        _, sized, _, _, n_numbers, packed = bounded.pack(len(sizes), sizes, np.empty(0, np.int64), found)
        ends = pa.array([0, len(terms)], pa.int32())
        counts = pa.array(np.bincount(found, minlength=len(terms)).astype(np.int32))
        columns = [[TaskContext.get().partitionId() << 32 | i], pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, counts), [len(sizes)], [sized], [n_numbers], [packed]]
        kinds = [pa.int64(), None, None, pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) if k else c for c, k in zip(columns, kinds, strict=True)], ["id", "terms", "counts", "n", "lengths", "n_numbers", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, n_held, lengths, numbers = 0, 0, [], []
        for batch in batches:
            lists = batch.column("terms")
            n, sizes = len(lists), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            words = lists.flatten().dictionary_encode()
            known, terms = pc.is_valid(words.indices).to_numpy(zero_copy_only=False), words.dictionary
            keys = np.repeat(np.arange(n, dtype=np.int64), sizes)[known] * max(1, len(terms)) + pc.drop_null(words.indices).to_numpy()
            doc, number = np.divmod(np.unique(keys), max(1, len(terms)))  # a term that a document repeats counts once
            lengths.append(np.bincount(doc, minlength=n))
            numbers.append(pa.DictionaryArray.from_arrays(pa.array(number.astype(np.int32)), terms))
            n_held += n
            if n_held >= most:
                yield row(i, lengths, numbers)
                i, n_held, lengths, numbers = i + 1, 0, [], []
        if numbers:
            yield row(i, lengths, numbers)

    return docs.select("terms").mapInArrow(run, "id bigint, terms array<string>, counts array<int>, n int, lengths binary, n_numbers int, numbers binary")


def _coded(worded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The documents with codes for terms, packed; only terms of rows are joined, not those of documents."""
    codes = worded.select("id", F.posexplode("terms").alias("i", "term")).join(vocabulary, "term").groupBy("id").agg(F.collect_list(F.struct("i", "code")).alias("c"))
    rows = worded.select("id", F.size("terms").alias("n_terms"), "n", "lengths", "n_numbers", "numbers").join(codes, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, r in enumerate(batch.select(["n_terms", "n", "n_numbers"]).to_pylist()):
                lengths, numbers = bounded.unpack(batch.column("lengths")[j], r["n"], batch.column("numbers")[j], r["n_numbers"])
                codes = batch.column("code")[j].values.to_numpy()
                order = np.argsort(codes)
                number = np.full(r["n_terms"], -1, np.int64)
                number[batch.column("i")[j].values.to_numpy()[order]] = np.arange(len(codes))
                found = number[numbers]
                keys = np.sort(np.repeat(np.arange(r["n"], dtype=np.int64), lengths)[found >= 0] * len(codes) + found[found >= 0])
                doc, found = np.divmod(keys, len(codes))
                yield bounded.table([bounded.pack(r["n"], np.bincount(doc, minlength=r["n"]), codes[order], found)], bounded.PACKED)

    return rows.select("n_terms", "n", "lengths", "n_numbers", "numbers", F.col("c")["i"].alias("i"), F.col("c")["code"].alias("code")).mapInArrow(run, bounded.PACKED)


def _weighed(docs: DataFrame, vocabulary: DataFrame, documents: int, k: int, least: int) -> DataFrame:
    """term, neighbour and weight. Codes carry what weights and ties need, so only the neighbours that are kept meet their names."""
    df = lambda c: F.shiftright(c, 32)
    found = bounded.top(docs, vocabulary.select("code"), k, least, _counted)
    weight = F.log(F.col("n") * F.lit(float(documents)) / (df("a") * df("b")))
    both = found.select(F.col("a").alias("t"), F.col("b").alias("o"), weight.alias("weight")).filter("weight > 0")
    by = Window.partitionBy("t").orderBy(F.desc("weight"), _place("o"))
    kept = both.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n")
    return kept.join(vocabulary.toDF("term", "t"), "t").join(vocabulary.toDF("neighbour", "o"), "o").select("term", "neighbour", "weight")


def ppmi(terms: DataFrame, documents: int, k: int = 10, least: int = 2) -> DataFrame:
    """term, neighbour, weight: the k neighbours of highest positive pointwise mutual information, ties to the smaller.

    Bounds leave out most pairs.
    """
    vocabulary = _vocabulary(frequencies(terms), least)
    return _weighed(bounded.packed(_held(terms, vocabulary)), vocabulary, documents, k, least)


def document_ppmi(docs: DataFrame, documents: int, k: int = 10, least: int = 2) -> DataFrame:
    """The same of rows with `terms`, a document each. Terms are made once and shuffled once for each batch of documents."""
    with bounded.tidied(docs.sparkSession):
        with small_batches(docs.sparkSession, DOCUMENTS):
            worded = stored(_worded(docs))
        counts = worded.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("df"))
        vocabulary = _vocabulary(counts, least)
        return _weighed(_coded(worded, vocabulary), vocabulary, documents, k, least)


def rebuild(existing: DataFrame | None, changed: int, least_changed: int, build) -> DataFrame:
    """The existing table while fewer than `least_changed` files changed, else build()."""
    if existing is not None and changed < least_changed and not existing.isEmpty():
        return existing
    return build()


def nearest(neighbours: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """term, neighbour and weight: the k best neighbours of each of terms (term)."""
    by = Window.partitionBy("term").orderBy(F.desc("weight"), "neighbour")
    found = neighbours.join(terms.select("term").distinct(), "term", "left_semi")
    return found.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n")


def expand(queries: DataFrame, neighbours: DataFrame, each: int) -> DataFrame:
    """query_id and terms of (query_id, terms): the originals, then the `each` best neighbours of every term,
    without originals or repeats."""
    asked = queries.select("query_id", "terms", F.posexplode("terms").alias("i", "term"))
    by = Window.partitionBy("query_id", "i").orderBy(F.desc("weight"), "neighbour")
    found = asked.join(neighbours, "term").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= each)
    added = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "n", "neighbour"))).alias("more"))
    out = queries.join(added, "query_id", "left")
    more = F.coalesce(F.transform("more", lambda x: x["neighbour"]), F.array().cast("array<string>"))
    return out.select("query_id", F.concat("terms", F.array_except(F.array_distinct(more), "terms")).alias("terms"))
