"""Full-text top-k with early termination: postings in blocks of documents, with the maxima of each term in each block.

Documents of about the same length make a block, which is a row. For a term and block the index keeps its largest
frequency and the least length of a document, which bound what the term can add to any score there. A search

* meets what is asked with the terms of each block, and counts the documents that have it: no positions or frequencies are read for it;
* adds up a bound for each query and block, and scores the blocks of largest bound first;
* skips every block whose bound is below the k-th best score that those gave, and scores the rest.

Blocks stay where they lie, and only bounds and the best of each task are shuffled. Scores are those of fts.scores, ties included: a
block goes only if its bound is below the threshold at the places that count. Phrases of several terms read the positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..functions import text as T
from . import fts, matching
from .settle import settled, small_batches, stored

#: Documents of a block, and its terms with their repeats; a single document can have more.
PER_BLOCK, BLOCK_TERMS = 128, 1 << 17
#: Bytes of documents that a task sorts by length at a time.
SORTED = 24 << 20
#: Documents and blocks that Python gets at a time: whole partitions would stand several times in an executor's memory.
DOCUMENTS, BLOCKS_AT_ONCE = 256, 8
#: Bytes of blocks that are read at a time.
GROUP = 4 << 20
#: What the order of addition can change of a bound, relative and absolute.
SLACK = 1e-8


@dataclass
class BlockIndex:
    """blocks: block, id, type and dl of its documents; terms in order, and of each the largest frequency (most), the least length
    (least) and where its postings end (ends); doc and tf of postings, and positions, tf of them for each; whole: the totals."""

    blocks: DataFrame
    whole: DataFrame
    per_block: int


BLOCKS = "block bigint, id array<string>, type array<string>, dl array<bigint>, terms array<string>, most array<int>, least array<int>, ends array<int>, doc array<int>, tf array<int>, positions array<int>"


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of `most` bytes and a batch more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            whole, held, size = pa.concat_batches(held), [], 0
            yield whole
    if held:
        yield pa.concat_batches(held)


def _posted(per_block: int, most_terms: int, at_once: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of batches of (id, type, terms): documents are taken in the order of their lengths, per_block of them at a time, or
    fewer that have most_terms."""

    def run(batches):
        made = TaskContext.get().partitionId() << 33
        for batch in _gathered(batches, at_once):
            length = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            for at in range(0, len(order), per_block):
                alike = order[at : at + per_block]
                for start, n in matching.slices(length[alike].astype(np.int64), most_terms):
                    rows = alike[start : start + n]
                    yield _block(made, batch.take(pa.array(rows)), length[rows].astype(np.int64))
                    made += 1

    return run


def _block(number: int, part: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
    words = part.column("terms").flatten().dictionary_encode()
    by_name = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    code = place[words.indices.to_numpy()] * len(size) + doc
    by = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[by], prepend=-1))
    tf, who, term = np.diff(first, append=len(by)), doc[by][first], code[by][first] // len(size)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(size[who], starts)) if len(starts) else (tf, tf)
    lists = [part.column("id"), part.column("type"), pa.array(size), words.dictionary.take(pa.array(by_name)), pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32))]
    lists += [pa.array(x.astype(np.int32)) for x in (np.append(starts[1:], len(term)) if len(starts) else starts, who, tf, pos[by])]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array([number]), *map(one, lists)], names=["block", "id", "type", "dl", "terms", "most", "least", "ends", "doc", "tf", "positions"])


def build(nodes: DataFrame, per_block: int = PER_BLOCK) -> BlockIndex:
    """The stored index of nodes (id, type, content), which is made without a shuffle: a block lies in one task."""
    cut = nodes.select("id", "type", T.unicode_terms(F.col("content")).alias("terms"))
    with small_batches(nodes.sparkSession, DOCUMENTS):
        blocks = stored(cut.mapInArrow(_posted(per_block, BLOCK_TERMS, SORTED), BLOCKS), GROUP)
    return BlockIndex(blocks, settled(fts.totals(blocks.select(F.explode("dl").alias("dl")))), per_block)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The lists of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].values if pa.types.is_list(batch.schema.field(c).type) else batch.column(c)[i].as_py() for c in batch.schema.names}


def _bounded(phrases: matching.Phrases):
    """block, and lists of phrase, n (its documents), most and least: no document has the phrase more often, or has fewer terms."""

    def run(batches):
        for x in _blocks(batches):
            known, ends = x["terms"].to_numpy(zero_copy_only=False), x["ends"].to_numpy().astype(np.int64)
            phrase, n, most, least = phrases.bounds(known, ends, x["doc"].to_numpy(), *(x[c].to_numpy().astype(np.int64) for c in ("most", "least")))
            if phrases.several:
                code, f = phrases.severals_of(known, ends, *(x[c].to_numpy() for c in ("doc", "tf", "positions")))
                at, doc = code % phrases.size, code // phrases.size
                by = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[by], prepend=-1))
                if len(first):
                    dl = x["dl"].to_numpy()[doc[by]]
                    phrase, n = np.append(phrase, at[by][first]), np.append(n, np.diff(first, append=len(by)))
                    most, least = np.append(most, np.maximum.reduceat(f[by], first)), np.append(least, np.minimum.reduceat(dl, first))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v.astype(t))) for v, t in ((phrase, np.int32), (n, np.int64), (most, np.int64), (least, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x["block"]]), *lists], names=["block", "phrase", "n", "most", "least"])

    return run


class _Search:
    def __init__(self, index: BlockIndex, queries: DataFrame, k: int, files_only: bool):
        asked = fts.Asked(fts.phrases(queries))
        if asked.n_parts > fts.BROADCAST_TERMS or asked.n_uses > fts.BROADCAST_TERMS:
            raise ValueError("more phrases than tasks hold; search in batches of queries")
        rows, uses = asked.numbered()
        self.index, self.files_only, self.phrases, self.kind = index, files_only, matching.Phrases.of(rows), asked.queries.schema["query_id"]
        columns = ["block", "terms", "most", "least", "ends", "doc"] + (["dl", "tf", "positions"] if self.phrases.several else [])
        self.maxima = stored(index.blocks.select(*columns).mapInArrow(_bounded(self.phrases), "block bigint, phrase array<int>, n array<bigint>, most array<bigint>, least array<bigint>"))
        n_hits = self.maxima.select(F.inline(F.arrays_zip("phrase", "n"))).groupBy("phrase").agg(F.sum("n").alias("n_hits"))
        self.scoring = matching.scoring(fts.weights(n_hits, index.whole).toArrow(), uses, len(rows), k, fts.part_of)

    def bounds(self) -> DataFrame:
        """query_id, query (its number), block and bound: no document of the block scores more."""
        by = self.scoring

        def run(batches):
            for x in _blocks(batches):
                score = by.sums(*(x[c].to_numpy() for c in ("phrase", "most", "least")), np.array([len(x["phrase"])]))[0]
                query = np.flatnonzero(score > 0)
                yield pa.RecordBatch.from_arrays([by.ids.take(pa.array(query)), pa.array(query), pa.array(np.full(len(query), x["block"])), pa.array(score[query] * (1 + SLACK) + SLACK)], names=["query_id", "query", "block", "bound"])

        return self.maxima.select("block", "phrase", "most", "least").mapInArrow(run, fts.with_fields(self.kind, "query bigint, block bigint, bound double"))

    def score(self, chosen: DataFrame) -> DataFrame:
        """query_id, bm25, place, id and type of the k best documents of each task in chosen (query, block)."""
        lists = chosen.groupBy("block").agg(F.collect_list("query").alias("queries"))
        columns = ["block", "id", "type", "dl", "terms", "ends", "doc", "tf"] + (["positions"] if self.phrases.several else [])
        # a query of a block takes few bytes
        here = self.index.blocks.select(*columns).join(fts._bounded(lists, chosen.count() // 8), "block")
        by, phrases, files_only = self.scoring, self.phrases, self.files_only

        def scores(batches):
            for x in _blocks(batches):
                known, ends, doc, tf = x["terms"].to_numpy(zero_copy_only=False), *(x[c].to_numpy() for c in ("ends", "doc", "tf"))
                code, f = phrases.singles_of(known, ends, doc, tf)
                if phrases.several:
                    more = phrases.severals_of(known, ends, doc, tf, x["positions"].to_numpy())
                    code, f = matching.summed(np.append(code, more[0]), np.append(f, more[1]))
                row, dl = code // phrases.size, x["dl"].to_numpy()
                score = by.sums(code % phrases.size, f, dl[row], np.bincount(row, minlength=len(dl)))
                asked = np.zeros(len(by.ids), bool)
                asked[x["queries"].to_numpy()] = True
                found = pa.RecordBatch.from_arrays([x["id"], x["type"]], names=["id", "type"])
                kept = pc.is_valid(x["id"])
                kept = pc.and_(kept, pc.match_substring_regex(x["type"], ".file$")) if files_only else kept
                yield (score * asked)[kept.fill_null(False).to_numpy(zero_copy_only=False)], found.filter(kept)

        return here.mapInArrow(lambda batches: by.fold(scores(batches)), matching.found_schema(self.kind, [StructField(c, self.index.blocks.schema[c].dataType.elementType) for c in ("id", "type")]))


def search(index: BlockIndex, queries: DataFrame, k: int = 200, files_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """query_id, id, type, bm25 and rank of the k best nodes of each query; and query_id, n_blocks and n_scored, the blocks that
    could hold a hit and those that were read for it."""
    with small_batches(queries.sparkSession, BLOCKS_AT_ONCE):
        run = _Search(index, queries, k, files_only)
        bounds = stored(run.bounds())
        some = 2 * -(-k // index.per_block)
        by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = settled(bounds.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= some).drop("n"))
        best = settled(fts.top(stored(run.score(first)), k, "place"))
        least = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("place").alias("least")).filter(F.col("n") == k).select("query_id", "least")
        rest = settled(bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left").filter("least is null or bound >= least").select("query_id", "query", "block"))
        found = fts.top(best.drop("rank").unionByName(stored(run.score(rest))), k, "place")
    read = first.select("query_id", "block").unionByName(rest.select("query_id", "block")).groupBy("query_id").agg(F.count("*").alias("n_scored"))
    return found.select("query_id", "id", "type", "bm25", "rank"), bounds.groupBy("query_id").agg(F.count("*").alias("n_blocks")).join(read, "query_id")
