"""Registered queries over the driver's tables, each with an equivalent SQL statement where SQL has one.

documents stand for files (directory: source; kind: by language), benchmark passages for queries, keys of
the order tables for a graph, embeddings for vectors, quality labels for ground truth.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import blockmax, clusters, cooccur, extract, fts, graph, metrics, nav, rank, store, vector
from .operators.settle import settled, stored
from .plans import context
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
#: A table of one file is dealt anew below so many bytes; larger ones have row groups enough.
SMALL_BYTES = 1 << 30
#: Rows of keys for a task.
TASK_ROWS = 1 << 19
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small single-file table is read by one task, whatever its splits; work on long texts is dealt over the cluster's cores."""
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small and len(df.inputFiles()) < 2 else df


# the driver's tables as nodes, edges and queries

_EXT = {"en": ".go", "de": ".ts", "fr": ".py"}


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    ext = F.lit(".txt")
    for lang, e in _EXT.items():
        ext = F.when(F.col("lang") == lang, e).otherwise(ext)
    named = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("id"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    return named.select("id", T.file_type(F.col("id")).alias("type"), "content", F.sha2("content", 256).alias("hash"), "doc_id")


NODES = """nodes AS (SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.go' WHEN 'de' THEN '.ts' WHEN 'fr' THEN '.py' ELSE '.txt' END AS id,
 CASE lang WHEN 'en' THEN 'go_file' WHEN 'de' THEN 'ts_file' WHEN 'fr' THEN 'py_file' ELSE 'text_file' END AS type, coalesce(text, '') AS content, sha256(coalesce(text, '')) AS hash, doc_id, source AS dir FROM documents)"""


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in as many tasks as keep each at some TASK_ROWS, so that what a task holds does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), *keys)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """region contains nation contains customer calls order imports part."""
    edge = lambda df, a, ka, b, kb, rel: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("from_id"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("to_id"), F.lit(rel).alias("relation_type"))
    # repeats are of one relation; those of the large tables are dropped by their keys, before ids are made
    once = lambda name, ka, kb: dealt(table(spark, sf, name).select(ka, kb), ka, kb).distinct()
    made = edge(table(spark, sf, "nation"), "r", "n_regionkey", "n", "n_nationkey", "contains")
    made = made.union(edge(table(spark, sf, "customer"), "n", "c_nationkey", "c", "c_custkey", "contains")).distinct()
    made = made.union(edge(once("orders", "o_custkey", "o_orderkey"), "c", "o_custkey", "o", "o_orderkey", "calls"))
    return made.union(edge(once("lineitem", "l_orderkey", "l_partkey"), "o", "l_orderkey", "p", "l_partkey", "imports"))


EDGES = """edges AS (SELECT DISTINCT * FROM (SELECT 'r' || n_regionkey AS from_id, 'n' || n_nationkey AS to_id, 'contains' AS relation_type FROM nation UNION ALL
 SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'calls' FROM orders UNION ALL
 SELECT 'o' || l_orderkey, 'p' || l_partkey, 'imports' FROM lineitem))"""


def doc_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each document imports the one of the next id."""
    n = nodes(spark, sf).select("id", "doc_id")
    return n.alias("a").join(n.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.col("a.id").alias("from_id"), F.col("b.id").alias("to_id"), F.lit("imports").alias("relation_type"))


DOC_EDGES = "doc_edges AS (SELECT a.id AS from_id, b.id AS to_id, 'imports' AS relation_type FROM nodes a JOIN nodes b ON b.doc_id = a.doc_id + 1)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# SQL of the tokenisers

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_EDGE = r"""["''.,;:!?()\[\]{}/\\`]"""


def _raw_sql(x: str) -> str:
    bare = rf"list_transform(regexp_split_to_array(lower({x}), '[\s\p{{Z}}]+'), lambda t: regexp_replace(regexp_replace(t, '^{_EDGE}+', ''), '{_EDGE}+$', ''))"
    return f"list_filter({bare}, lambda t: strlen(t) > 1 AND t NOT IN ({_STOP}))"


def _terms_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"


def _split_sql(x: str) -> str:
    cut = r"regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(list_transform(flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda w: string_split({cut}, ' '))), lambda p: lower(p)), lambda p: length(p) >= 3)"


_STEM_SQL = r"regexp_replace(regexp_extract(id, '([^/]*)$', 1), '\.[^.]*$', '')"
_HEX_STEM = "CASE WHEN strlen(t) >= 10 THEN substr(hex(encode(t)), 1, 2 * (strlen(t) - 3)) ELSE hex(encode(t)) END"
_CUT = "CASE WHEN strlen(t) < 10 THEN t WHEN strlen(left(t, length(t) - 1)) <= strlen(t) - 3 THEN left(t, length(t) - 1) WHEN strlen(left(t, length(t) - 2)) <= strlen(t) - 3 THEN left(t, length(t) - 2) ELSE left(t, length(t) - 3) END"


# scans, lookups and maintenance


@query(f"WITH {NODES} SELECT id, type, hash, strlen(content) AS n_bytes FROM nodes")
def scan_files(spark, sf):
    return nodes(spark, sf).select("id", "type", "hash", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query(f"WITH {NODES} SELECT type, regexp_extract(id, '(\\.[^./]*)$', 1) AS ext, count(*) AS n FROM nodes GROUP BY ALL")
def ext_type_counts(spark, sf):
    return nodes(spark, sf).groupBy("type", T.extension(F.col("id")).alias("ext")).agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT id, type FROM nodes WHERE starts_with(id, 'src1')")
def prefix_scan(spark, sf):
    return nodes(spark, sf).filter(F.col("id").startswith("src1")).select("id", "type")


@query(f"WITH {NODES} SELECT id, hash FROM nodes WHERE id = 'src0/0.go' OR id = 'src0/0.py'")
def point_lookup(spark, sf):
    return nodes(spark, sf).filter(F.col("id").isin("src0/0.go", "src0/0.py")).select("id", "hash")


@query(f"WITH {NODES} SELECT id, type FROM nodes WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def multi_get(spark, sf):
    n = nodes(spark, sf)
    wanted = table(spark, sf, "labels").filter("quality = 1").join(n.select("doc_id", "id"), "doc_id").select("id")
    return store.lookup(n, wanted).select("id", "type")


@query(f"WITH {EDGES} SELECT relation_type, count(*) AS n, count(DISTINCT from_id) AS n_from, count(DISTINCT to_id) AS n_to FROM edges GROUP BY relation_type")
def node_edge_stats(spark, sf):
    return edges(spark, sf).groupBy("relation_type").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("n_from"), F.countDistinct("to_id").alias("n_to"))


def _versions(spark, sf):
    """Two versions of the files: the later one has toxic documents changed, short ones gone; the earlier lacks French."""
    n = nodes(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    before = n.filter("type <> 'py_file'").select("id", "type", "content", "hash")
    after = n.filter(F.length("content") >= 200).select("id", "type", "content", F.when(F.col("toxic") == 1, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("hash")).alias("hash"))
    return before, after


_VERSIONS = f"{NODES}, v AS (SELECT n.*, l.toxic FROM nodes n LEFT JOIN labels l USING (doc_id)), b AS (SELECT id, hash FROM v WHERE type <> 'py_file'), a AS (SELECT id, CASE WHEN toxic = 1 THEN sha256(content || '!') ELSE hash END AS hash FROM v WHERE length(content) >= 200)"


@query(f"WITH {_VERSIONS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.hash IS NULL THEN 'new' WHEN a.hash IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'same' ELSE 'changed' END AS state FROM b FULL JOIN a ON a.id = b.id")
def incremental_diff(spark, sf):
    return store.diff(*_versions(spark, sf))


@query(f"WITH {_VERSIONS} SELECT id, hash FROM a UNION ALL SELECT id, hash FROM b WHERE id NOT IN (SELECT id FROM a)")
def upsert_nodes(spark, sf):
    return store.upsert(*_versions(spark, sf), ["id"]).select("id", "hash")


@query(f"WITH {EDGES} SELECT relation_type, count(*) AS n FROM (SELECT * FROM edges UNION SELECT to_id, from_id, relation_type FROM edges WHERE relation_type = 'contains') GROUP BY relation_type")
def upsert_edges(spark, sf):
    e = edges(spark, sf)
    return store.insert_missing(e, e.filter("relation_type = 'contains'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "relation_type").union(e.filter("relation_type = 'contains'"))).groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"WITH {_VERSIONS} SELECT id FROM b WHERE starts_with(id, 'src') AND id NOT IN (SELECT id FROM a)")
def stale_cleanup(spark, sf):
    before, after = _versions(spark, sf)
    return store.stale(before, after, "src").select("id")


@query(f"WITH {EDGES}, gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal < 0) SELECT relation_type, count(*) AS n FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone) GROUP BY relation_type")
def delete_cascade(spark, sf):
    e = edges(spark, sf)
    ids = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    gone = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return store.delete_nodes(ids, e, gone)[1].groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"WITH {_VERSIONS} SELECT a.id AS id, b.hash IS NOT NULL AS known, coalesce(a.hash = b.hash, false) AS current FROM a LEFT JOIN b USING (id)")
def hash_current(spark, sf):
    """Which files the index knows, and which of them as they are now."""
    before, after = _versions(spark, sf)
    return store.current(before, after)


@query("""WITH gone AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT 'o' || o_orderkey AS id, 'file' AS kind FROM orders UNION ALL SELECT 'o' || l_orderkey || ':' || l_linenumber, 'symbol' FROM lineitem),
 e AS (SELECT 'o' || l_orderkey AS f, 'o' || l_orderkey || ':' || l_linenumber AS t FROM lineitem UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)
 SELECT kind, count(*) AS n FROM n WHERE split_part(id, ':', 1) NOT IN (SELECT id FROM gone) OR kind = 'file' GROUP BY kind UNION ALL SELECT 'edge', count(*) FROM e WHERE f NOT IN (SELECT id FROM gone)""")
def clear_contents(spark, sf):
    """Orders stand for files and their lines for symbols: what finished orders contain is cleared, the orders stay."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    of = lambda k: F.concat(F.lit("o"), F.col(k).cast("string"))
    line = F.concat(of("l_orderkey"), F.lit(":"), F.col("l_linenumber").cast("string"))
    n = orders.select(of("o_orderkey").alias("id")).union(lines.select(line))
    e = lines.select(of("l_orderkey").alias("from_id"), line.alias("to_id"), F.lit("contains").alias("relation_type")).union(orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), of("o_orderkey"), F.lit("imports")))
    kept, left = store.clear_contents(n, e, orders.filter("o_orderstatus = 'F'").select(of("o_orderkey").alias("id")))
    kind = F.when(F.instr("id", ":") > 0, "symbol").otherwise("file").alias("kind")
    return kept.groupBy(kind).agg(F.count("*").alias("n")).unionByName(left.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "n"))


@query("""WITH d AS (SELECT vec_id, embedding FROM embeddings), u AS (SELECT 'v' || vec_id % 1500 AS id, max(vec_id) AS vec_id FROM d GROUP BY 1)
 SELECT id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 4) AS total FROM u JOIN d USING (vec_id)""")
def upsert_vectors(spark, sf):
    """Vectors in two loads of which the later ones replace those of the same id; stored at unit length."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), (F.col("vec_id") % 1500).cast("string")).alias("id"), "vec_id", F.col("embedding").alias("vec"))
    none = spark.createDataFrame([], "id string, dim int, vec array<double>")
    first = store.upsert_vectors(none, e.filter("vec_id < 1500"), "vec_id")
    both = store.upsert_vectors(first, e.filter("vec_id >= 1500"), "vec_id")
    return both.select("id", F.col("dim").cast("bigint").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


# text functions


@query(f"WITH x AS (SELECT doc_id, list_distinct(list_transform({_raw_sql('text')}, lambda t: {_HEX_STEM})) AS k FROM documents) SELECT doc_id, len(k) AS n, md5(array_to_string(list_sort(k), ' ')) AS digest FROM x")
def tokenize_fts(spark, sf):
    k = F.sort_array(F.transform(T.token_set(F.col("text")), lambda t: F.hex(t.cast("binary"))))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents),
 p AS (SELECT doc_id, lower(unnest(regexp_split_to_array(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '))) AS t FROM w)
 SELECT doc_id, count(DISTINCT t) AS n, md5(string_agg(DISTINCT t, ' ' ORDER BY t)) AS digest FROM p WHERE length(t) >= 3 GROUP BY doc_id""")
def split_identifiers(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.sort_array(T.split_identifiers(F.col("text"))).alias("k")).filter(F.size("k") > 0)
    return d.select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query(f"WITH x AS (SELECT doc_id, {_terms_sql('text')} AS k FROM documents) SELECT doc_id, len(k) AS n, md5(array_to_string(k, ' ')) AS digest FROM x")
def unicode_terms(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.unicode_terms(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").cast("bigint").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


@query(f"WITH {NODES} SELECT dir, sum(greatest(1, strlen(content) // 4))::BIGINT AS tokens, max(greatest(1, strlen(content) // 4)) AS most FROM nodes GROUP BY dir")
def estimate_tokens(spark, sf):
    t = T.estimate_tokens(F.col("content"))
    return nodes(spark, sf).groupBy(T.directory(F.col("id")).alias("dir")).agg(F.sum(t).alias("tokens"), F.max(t).alias("most"))


@query(f"WITH {NODES}, l AS (SELECT id, content, string_split(content, chr(10)) AS x FROM nodes) SELECT id, md5(CASE WHEN len(x) > 8 THEN array_to_string(x[1:8], chr(10)) || chr(10) || '... (' || (len(x) - 8) || ' lines omitted)' ELSE content END) AS digest FROM l")
def truncate_lines(spark, sf):
    return nodes(spark, sf).select("id", F.md5(T.truncate_lines(F.col("content"), 8)).alias("digest"))


@query(f"WITH {NODES}, l AS (SELECT id, type, content, string_split(content, chr(10)) AS x FROM nodes) SELECT id, greatest(1, strlen(CASE WHEN len(x) > 8 THEN array_to_string(x[1:8], chr(10)) || chr(10) || '... (' || (len(x) - 8) || ' lines omitted)' ELSE content END) // 4) AS hard FROM l")
def compress_hard(spark, sf):
    return nodes(spark, sf).select("id", T.estimate_tokens(T.compress_hard(F.col("id"), F.col("type"), F.col("content"))).alias("hard"))


@query(f"WITH {NODES} SELECT id, '[' || CASE type WHEN 'go_file' THEN 'go' WHEN 'ts_file' THEN 'typescript' WHEN 'py_file' THEN 'python' ELSE 'text' END || regexp_extract(id, '(\\.[^./]*)$', 1) || '] ' || id || ' (' || len(string_split(content, chr(10))) || ' lines)' AS line FROM nodes")
def summary_line(spark, sf):
    return nodes(spark, sf).select("id", T.summary_line(F.col("id"), F.col("type"), F.col("content")).alias("line"))


@query(f"WITH {NODES} SELECT count(*) AS n, sum(length(content))::BIGINT AS n_chars FROM nodes")
def strip_augment(spark, sf):
    n = nodes(spark, sf).select(T.strip_augment(T.augment(F.col("content"), F.col("id"))).alias("c"))
    return n.agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("n_chars"))


@query(f"WITH {NODES} SELECT id, CASE WHEN type = 'text_file' THEN 0.3 ELSE 1.0 END::DOUBLE AS factor, CASE WHEN type = 'text_file' THEN 0.1 ELSE 0.2 END::DOUBLE AS boost FROM nodes")
def type_factor_boost(spark, sf):
    return nodes(spark, sf).select("id", T.type_factor(F.col("id"), F.col("type")).cast("double").alias("factor"), T.type_boost(F.col("type")).cast("double").alias("boost"))


@query(rf"WITH {NODES} SELECT id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(x), '^(import |from |def |class |async def )'))) AS n FROM nodes")
def compress_signatures(spark, sf):
    return nodes(spark, sf).select("id", T.signatures(F.col("content"), 1_000_000).alias("s")).select("id", F.when(F.col("s") == "", 0).otherwise(F.size(F.split("s", "\n"))).cast("bigint").alias("n"))


@query(f"WITH {NODES}, l AS (SELECT id, string_split(content, chr(10)) AS x FROM nodes) SELECT id, md5(array_to_string(list_transform(range(greatest(1, len(x) // 2 - 2), least(len(x), len(x) // 2 + 2) + 1), lambda i: CASE WHEN i = len(x) // 2 THEN '> ' ELSE '  ' END || printf('%4d: ', i) || x[i]), chr(10))) AS digest FROM l")
def file_context(spark, sf):
    """The middle line of every file between the two lines before and after it."""
    n = nodes(spark, sf)
    middle = F.floor(F.size(F.split("content", "\n")) / 2).cast("int")
    return n.select("id", F.md5(T.file_context(F.col("content"), middle, 2)).alias("digest"))


@query(f"WITH {NODES} SELECT id, left(content, 40) AS head FROM nodes")
def first_runes(spark, sf):
    return nodes(spark, sf).select("id", T.first_runes(F.col("content"), 40).alias("head"))


# full-text search

_INDEX = f"""{NODES}, t AS (SELECT id, type, {_terms_sql('content')} AS k FROM nodes), dl AS (SELECT id, type, len(k) AS dl FROM t), tot AS (SELECT count(*) AS n_docs, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl),
 post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(k) AS term FROM t) GROUP BY ALL)"""
_PHRASES = f"""tok AS (SELECT item_id AS query_id, unnest({_raw_sql('text')}) AS t, generate_subscripts({_raw_sql('text')}, 1) AS pos FROM benchmark),
 seen AS (SELECT query_id, t, pos, {_HEX_STEM} AS hx, {_CUT} AS s FROM tok),
 kept AS (SELECT * FROM seen a WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.query_id = a.query_id AND b.pos < a.pos AND b.hx = hex(encode(a.t)))),
 ph AS (SELECT query_id, pos, s, hx, regexp_full_match(s, '[a-z0-9_]{{3,}}') AND (strlen(t) < 10 OR strlen(s) = strlen(t) - 3) AS star, {_terms_sql('s')} AS terms FROM kept),
 one AS (SELECT query_id, pos, terms[1] AS want, star FROM ph WHERE len(terms) = 1 AND (star OR strlen(s) >= 2)),
 many AS (SELECT query_id, pos, len(terms) AS m, unnest(terms) AS want, generate_subscripts(terms, 1) - 1 AS i, star FROM ph WHERE len(terms) > 1 AND (star OR strlen(s) >= 2))"""
_BM25 = f"""{_INDEX}, {_PHRASES}, voc AS (SELECT DISTINCT term FROM post),
 placed AS (SELECT id, unnest(k) AS term, generate_subscripts(k, 1) AS p FROM t WHERE EXISTS (SELECT 1 FROM many)),
 whole AS (SELECT query_id, pos, id, p - i AS place, m FROM many JOIN placed ON CASE WHEN star AND i = m - 1 THEN starts_with(term, want) ELSE term = want END GROUP BY ALL HAVING count(*) = m),
 hit AS (SELECT query_id, pos, id, sum(tf) AS f FROM (SELECT query_id, pos, term FROM one JOIN voc ON CASE WHEN star THEN starts_with(term, want) ELSE term = want END) JOIN post USING (term) GROUP BY ALL UNION ALL SELECT query_id, pos, id, count(*) FROM whole GROUP BY ALL),
 n AS (SELECT query_id, pos, count(*) AS n_hits FROM hit GROUP BY ALL),
 bm AS (SELECT query_id, id, type, sum(CASE WHEN ln((n_docs - n_hits + 0.5) / (n_hits + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n_hits + 0.5) / (n_hits + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
 FROM hit JOIN n USING (query_id, pos) JOIN dl USING (id), tot GROUP BY ALL)"""


@query(f"WITH {_INDEX} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term")
def postings(spark, sf):
    return fts.postings(nodes(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"))


@query(f"""WITH {NODES}, w AS (SELECT id, content, array_to_string(list_distinct(list_concat({_split_sql('content')}, {_split_sql(_STEM_SQL)})), chr(10)) AS more FROM nodes), t AS (SELECT id, {_terms_sql("content || chr(10) || more")} AS k FROM w)
 SELECT id, len(k) AS dl, len(list_distinct(k)) AS n_terms FROM t""")
def augmented_index(spark, sf):
    """What the index holds of each file: its terms and the parts of its identifiers."""
    text = F.concat("content", F.lit("\n"), T.index_text(F.col("content"), F.col("id")))
    made = nodes(spark, sf).select("id", F.explode(F.array(T.unicode_terms(text))).alias("k"))
    return made.select("id", F.size("k").cast("bigint").alias("dl"), F.size(F.array_distinct("k")).cast("bigint").alias("n_terms"))


@query(f"WITH {_INDEX} SELECT id, dl FROM dl")
def doc_stats(spark, sf):
    return fts.doc_stats(nodes(spark, sf))


@query(f"WITH {_INDEX}, {_PHRASES} SELECT query_id, count(*) AS n, sum(star::INT)::BIGINT AS n_prefix FROM ph WHERE (star OR strlen(s) >= 2) AND len(terms) > 0 GROUP BY query_id")
def query_phrases(spark, sf):
    return fts.phrases(asked(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("prefix").cast("bigint")).alias("n_prefix"))


@query(f"WITH {_INDEX}, w AS (SELECT DISTINCT item_id AS query_id, unnest({_terms_sql('text')}) AS term FROM benchmark) SELECT query_id, count(DISTINCT id) AS n_docs_hit, sum(tf)::BIGINT AS n_hits FROM w JOIN post USING (term) GROUP BY query_id")
def term_matches(spark, sf):
    w = asked(spark, sf).select("query_id", F.explode(F.array_distinct(T.unicode_terms(F.col("query")))).alias("term"))
    return fts.term_matches(nodes(spark, sf), w)


@query(f"WITH {_BM25} SELECT query_id, id, round(bm25, 4) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rn FROM bm) WHERE rn <= 20")
def bm25_or_topk(spark, sf):
    found = fts.best(nodes(spark, sf), fts.phrases(asked(spark, sf)), 20)
    return found.select("query_id", "id", F.round("bm25", 4).alias("bm25"))


@query(f"WITH {_BM25} SELECT query_id, id, rn AS rank, round(bm25, 4) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rn FROM bm WHERE type LIKE '%_file') WHERE rn <= 10")
def bm25_blocks_topk(spark, sf):
    """The best files from a stored index in blocks, of which those that cannot hold any are skipped."""
    found, _ = blockmax.search(blockmax.build(nodes(spark, sf)), asked(spark, sf), 10)
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("bm25", 4).alias("bm25"))


@query(f"WITH {_BM25} SELECT query_id, id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rn FROM bm WHERE type LIKE '%_file') WHERE rn <= 10")
def fts_files_topk(spark, sf):
    found = fts.best(nodes(spark, sf), fts.phrases(asked(spark, sf)), 10, files_only=True)
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {NODES}, t AS (SELECT id, {_terms_sql('content')} AS k FROM nodes), p AS (SELECT id, unnest(k) AS term, generate_subscripts(k, 1) AS pos FROM t),
 q AS (SELECT item_id AS query_id, unnest(w) AS want, generate_subscripts(w, 1) AS i, len(w) AS m FROM (SELECT item_id, {_terms_sql('text')} AS w FROM benchmark)),
 met AS (SELECT query_id, id, pos - i AS place, m FROM q JOIN p ON term = want WHERE i < m UNION ALL SELECT query_id, id, pos - i, m FROM q JOIN p ON starts_with(term, want) WHERE i = m)
 SELECT query_id, id, count(*) AS f FROM (SELECT query_id, id, place FROM met GROUP BY query_id, id, place, m HAVING count(*) = m) GROUP BY query_id, id""")
def bm25_phrase(spark, sf):
    """Where documents hold a whole passage of the benchmark; its last word matches as a prefix."""
    terms = asked(spark, sf).select("query_id", T.unicode_terms(F.col("query")).alias("terms")).filter(F.size("terms") >= 1)
    wanted = terms.select("query_id", F.lit(0).alias("phrase_no"), "terms", F.lit(True).alias("prefix"))
    return fts.occurrences(nodes(spark, sf), wanted).select("query_id", "id", F.col("f").cast("bigint").alias("f"))


_SCORED = f"""{_BM25}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rn FROM bm) WHERE rn <= 200),
 qt AS (SELECT query_id, list(hx) AS hs FROM kept GROUP BY query_id),
 held AS (SELECT id, list_distinct(list_concat(list_transform({_raw_sql('content')}, lambda t: {_HEX_STEM}), list_transform({_raw_sql('id')}, lambda t: {_HEX_STEM}))) AS toks FROM nodes),
 sc AS (SELECT query_id, id, type, (0.5 + CASE WHEN max(bm25) OVER w - min(bm25) OVER w <= 1e-9 THEN 1 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END) * CASE WHEN type = 'text_file' THEN 0.3 ELSE 1 END
 * (0.2 + 0.8 * len(list_filter(hs, lambda h: list_contains(toks, h)))::DOUBLE / len(hs)) AS score FROM top JOIN qt USING (query_id) JOIN held USING (id) WINDOW w AS (PARTITION BY query_id))"""


def _scored(spark, sf):
    n = nodes(spark, sf)
    q = asked(spark, sf).select("query_id", "query", T.tokenise_query(F.col("query")).alias("tokens"))
    return n, rank.score_text(fts.best(n, fts.phrases(q), 200), n, q)


@query(f"WITH {_SCORED} SELECT query_id, id, round(score, 4) AS score FROM sc")
def fts_scores(spark, sf):
    return _scored(spark, sf)[1].select("query_id", "id", F.round("score", 4).alias("score"))


@query(f"WITH {_SCORED} SELECT query_id, id, round(score + CASE WHEN type = 'text_file' THEN 0.1 ELSE 0.2 END, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score + CASE WHEN type = 'text_file' THEN 0.1 ELSE 0.2 END, 9) DESC, id) AS rn FROM sc) WHERE rn <= 30")
def rank_candidates(spark, sf):
    r = _scored(spark, sf)[1].withColumn("total", F.col("score") + T.type_boost(F.col("type")))
    return fts.top(r, 30, "total").select("query_id", "id", F.round("total", 4).alias("total"))


@query(f"WITH {_SCORED} SELECT query_id, count(*) AS n_kept, max(n_all) - count(*) AS n_dropped FROM (SELECT query_id, score + CASE WHEN type = 'text_file' THEN 0.1 ELSE 0.2 END AS total, max(score + CASE WHEN type = 'text_file' THEN 0.1 ELSE 0.2 END) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS n_all FROM sc) WHERE round(total, 9) >= round(best * 0.25, 9) GROUP BY query_id")
def score_threshold(spark, sf):
    ranks = rank.ranked(_scored(spark, sf)[1])
    every = ranks.groupBy("query_id").agg(F.count("*").alias("n_all"))
    kept = rank.threshold(ranks).groupBy("query_id").agg(F.count("*").alias("n_kept"))
    return kept.join(every, "query_id").select("query_id", "n_kept", (F.col("n_all") - F.col("n_kept")).alias("n_dropped"))


@query(f"""WITH RECURSIVE {NODES}, i AS (SELECT dir, row_number() OVER (PARTITION BY dir ORDER BY doc_id) AS rank, id, greatest(1, strlen(content) // 4) AS soft, greatest(1, strlen(content) // 16) AS hard FROM nodes),
 f AS (SELECT dir, 0::BIGINT AS rank, ''::VARCHAR AS id, 0::BIGINT AS tokens, 0::BIGINT AS used, ''::VARCHAR AS form FROM (SELECT DISTINCT dir FROM i)
 UNION ALL SELECT i.dir, i.rank, i.id, CASE WHEN used + soft <= 4000 THEN soft WHEN used + hard <= 4000 THEN hard ELSE 0 END, used + CASE WHEN used + soft <= 4000 THEN soft WHEN used + hard <= 4000 THEN hard ELSE 0 END,
 CASE WHEN used + soft <= 4000 THEN 'soft' WHEN used + hard <= 4000 THEN 'hard' ELSE 'skip' END FROM f JOIN i ON i.dir = f.dir AND i.rank = f.rank + 1)
 SELECT dir AS query_id, rank, id, tokens, used, form FROM f WHERE rank > 0 AND form <> 'skip'""")
def budget_fill(spark, sf):
    size = F.octet_length("content")
    n = nodes(spark, sf).select(T.directory(F.col("id")).alias("query_id"), "id", "doc_id", F.greatest(F.lit(1), F.floor(size / 4)).alias("soft"), F.greatest(F.lit(1), F.floor(size / 16)).alias("hard"))
    items = n.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return rank.fill_budget(items).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "tokens", "used", "form")


@query(f"""WITH {_SCORED}, {DOC_EDGES}, sd AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM sc) WHERE rn <= 30),
 h1 AS (SELECT DISTINCT query_id, to_id AS id FROM sd JOIN doc_edges ON from_id = id), h2 AS (SELECT DISTINCT query_id, to_id AS id FROM h1 JOIN doc_edges ON from_id = id),
 hop AS (SELECT query_id, id, min(h) AS hop FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL)
 SELECT query_id, hop.id AS id, hop, sc.id IS NOT NULL AS known, round(CASE WHEN sc.id IS NULL THEN 0.3 ELSE 0.15 END / ln(hop + 2), 4) AS gain FROM hop LEFT JOIN sc USING (query_id, id)""")
def graph_expand_scores(spark, sf):
    n, found = _scored(spark, sf)
    found = settled(found)
    _, hops = graph.trace_many(doc_edges(spark, sf), rank.seeds(found), 2)
    hops = settled(hops)
    both = rank.expand_graph(found, hops, n.select("id", "type")).join(hops, ["query_id", "id"])
    known = F.col("source") != "graph"
    return both.select("query_id", "id", F.col("hop").cast("int").alias("hop"), known.alias("known"), F.round(F.when(known, F.col("boost")).otherwise(F.col("score")), 4).alias("gain"))


def _stored(spark, sf):
    """Nodes and edges, which an index has as tables and every step of the pipeline reads."""
    n = stored(nodes(spark, sf).select("id", "type", "content", "doc_id"))
    return n, settled(doc_edges(spark, sf))


def _lines_sql(n: int, lines: str = "x", content: str = "content") -> str:
    return f"CASE WHEN len({lines}) > {n} THEN array_to_string({lines}[1:{n}], chr(10)) || chr(10) || '... (' || (len({lines}) - {n}) || ' lines omitted)' ELSE {content} END"


_DEFINES = "list_filter(x, lambda l: regexp_matches(trim(l), '^(import |from |def |class |async def )'))"
_DENSE = """u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
 near AS (SELECT * FROM (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS r FROM (SELECT item_id AS query_id, nodes.id AS id, round(list_dot_product(q.v, c.v), 12) AS cosine FROM benchmark JOIN u q ON q.vec_id = item_id, u c JOIN nodes ON nodes.doc_id = c.vec_id)) WHERE r <= 10),
 bonus AS (SELECT query_id, near.id AS id, cosine * best * 0.25 AS bonus FROM near JOIN (SELECT query_id, max(score) AS best FROM sc GROUP BY query_id) USING (query_id)),
 c0 AS (SELECT query_id, id, coalesce(sc.type, nodes.type) AS type, coalesce(score, 0) + coalesce(bonus, 0) AS score, CASE WHEN score IS NULL THEN 'dense' ELSE 'fts' END AS source FROM sc FULL JOIN bonus USING (query_id, id) JOIN nodes USING (id))"""


def _context_sql(c0: str) -> str:
    """built: what the context pipeline returns, from candidates c0 (query_id, id, type, score, source)."""
    return f"""{_SCORED}, {DOC_EDGES}, {c0}, sd AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM c0) WHERE rn <= 30),
 h1 AS (SELECT DISTINCT query_id, to_id AS id FROM sd JOIN doc_edges ON from_id = id), h2 AS (SELECT DISTINCT query_id, to_id AS id FROM h1 JOIN doc_edges ON from_id = id),
 hop AS (SELECT query_id, id, min(h) AS hop FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL),
 cand AS (SELECT query_id, id, type, score, source, CASE WHEN hop IS NULL THEN 0 ELSE 0.15 / ln(hop + 2) END AS boost FROM c0 LEFT JOIN hop USING (query_id, id)
  UNION ALL SELECT query_id, hop.id, nodes.type, 0.3 / ln(hop + 2), 'graph', 0 FROM hop JOIN nodes ON nodes.id = hop.id WHERE (query_id, hop.id) NOT IN (SELECT (query_id, id) FROM c0)),
 ranks AS (SELECT *, score + boost + CASE WHEN type = 'text_file' THEN 0.1 ELSE 0.2 END AS total FROM cand), best AS (SELECT query_id, max(total) AS best FROM ranks GROUP BY query_id),
 marked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, id) AS rank, round(total, 9) < round(best * 0.25, 9) AS below FROM ranks JOIN best USING (query_id)),
 lined AS (SELECT id, content, type, string_split(content, chr(10)) AS x FROM nodes), outlined AS (SELECT *, {_DEFINES} AS d FROM lined),
 sizes AS (SELECT id, greatest(1, strlen(CASE type WHEN 'text_file' THEN {_lines_sql(30)} WHEN 'py_file' THEN {_lines_sql(60, 'd', 'array_to_string(d, chr(10))')} ELSE {_lines_sql(60)} END) // 4) AS soft, greatest(1, strlen({_lines_sql(8)}) // 4) AS hard FROM outlined),
 items AS (SELECT marked.*, soft, hard FROM marked JOIN sizes USING (id) WHERE NOT below),
 fill AS (SELECT query_id, 0::BIGINT AS rank, ''::VARCHAR AS id, 0::BIGINT AS tokens, 0::BIGINT AS used, 'skip'::VARCHAR AS form FROM (SELECT DISTINCT query_id FROM items)
  UNION ALL SELECT items.query_id, items.rank, items.id, CASE WHEN used + soft <= 4000 THEN soft ELSE hard END, used + CASE WHEN used + soft <= 4000 THEN soft WHEN used + hard <= 4000 THEN hard ELSE 0 END,
  CASE WHEN used + soft <= 4000 THEN 'soft' WHEN used + hard <= 4000 THEN 'hard' ELSE 'skip' END FROM fill JOIN items ON items.query_id = fill.query_id AND items.rank = fill.rank + 1),
 filled AS (SELECT * FROM fill WHERE form <> 'skip'),
 state AS (SELECT query_id, coalesce(any_value(below), false) OR any_value(n_filled) < any_value(n_kept) AS truncated FROM (SELECT query_id, bool_or(below) AS below, count(*) FILTER (NOT below) AS n_kept FROM marked GROUP BY query_id) LEFT JOIN (SELECT query_id, count(*) AS n_filled FROM filled GROUP BY query_id) USING (query_id) GROUP BY query_id),
 built AS (SELECT query_id, rank::INT AS rank, filled.id AS id, items.type AS type, items.source AS source, round(items.score, 4) AS score, filled.form AS form, filled.tokens AS tokens, filled.used AS used, truncated FROM filled JOIN items USING (query_id, rank) JOIN state USING (query_id))"""


_BUILT = _context_sql("c0 AS (SELECT query_id, id, type, score, 'fts' AS source FROM sc)")


@query(f"WITH RECURSIVE {_BUILT} SELECT * FROM built")
def build_context_batch(spark, sf):
    return context.build(*_stored(spark, sf), asked(spark, sf))


@query(f"WITH RECURSIVE {_context_sql(_DENSE)} SELECT * FROM built")
def build_context_dense(spark, sf):
    """The same with dense hits: a document's vector is that of its number, a query's that of its item."""
    (n, links), e = _stored(spark, sf), table(spark, sf, "embeddings")
    vectors = n.join(e, F.col("doc_id") == F.col("vec_id")).select("id", F.col("embedding").alias("vec"))
    queries = asked(spark, sf).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vec"))
    return context.build(n, links, asked(spark, sf), vectors=vectors, query_vectors=queries)


@query(f"""WITH RECURSIVE {_BUILT}, dirs AS (SELECT dir, count(*) AS n_files, (list(id ORDER BY id))[1:5] AS names FROM nodes GROUP BY dir), have AS (SELECT query_id, dir, count(DISTINCT built.id) AS n_covered FROM built JOIN nodes USING (id) GROUP BY ALL),
 open AS (SELECT query_id, dir, n_files, coalesce(n_covered, 0) AS n_covered, names FROM (SELECT DISTINCT query_id FROM built) CROSS JOIN dirs LEFT JOIN have USING (query_id, dir))
 SELECT query_id, dir, n_files, n_covered, 0::BIGINT AS n_symbols, array_to_string(list_transform(names, lambda n: regexp_replace(regexp_extract(n, '([^/]*)$', 1), '\\.[^.]*$', '')), ', ') || CASE WHEN n_files >= 5 THEN ', …' ELSE '' END AS summary
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_files DESC, dir) AS r FROM open WHERE n_covered < n_files) WHERE r <= 8""")
def context_branches(spark, sf):
    n, links = _stored(spark, sf)
    found = context.branches(n, context.build(n, links, asked(spark, sf)))
    return found.select("query_id", "dir", "n_files", F.col("n_covered").cast("bigint").alias("n_covered"), F.col("n_symbols").cast("bigint").alias("n_symbols"), "summary")


# nodes of all kinds: every document has one symbol, and imports the next document and a library


def mixed_nodes(spark, sf):
    n = nodes(spark, sf)
    symbols = n.select(F.concat("id", F.lit(":S")).alias("id"), F.lit("function").alias("type"), F.substring("content", 1, 80).alias("content"), F.lit("").alias("hash"))
    libraries = n.select(F.concat(F.lit("lib"), T.extension(F.col("id"))).alias("id")).distinct().select("id", F.lit("import").alias("type"), F.lit("").alias("content"), F.lit("").alias("hash"))
    return n.select("id", "type", "content", "hash").unionByName(symbols).unionByName(libraries)


def mixed_edges(spark, sf):
    """A file contains its symbol and imports a library; a symbol calls that of the next document."""
    n = nodes(spark, sf).select("id", "doc_id")
    held = n.select(F.col("id").alias("from_id"), F.concat("id", F.lit(":S")).alias("to_id"), F.lit("contains").alias("relation_type"))
    used = n.select(F.col("id").alias("from_id"), F.concat(F.lit("lib"), T.extension(F.col("id"))).alias("to_id"), F.lit("imports").alias("relation_type"))
    calls = n.alias("a").join(n.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 1).select(F.concat("a.id", F.lit(":S")).alias("from_id"), F.concat("b.id", F.lit(":S")).alias("to_id"), F.lit("calls").alias("relation_type"))
    back = n.alias("a").join(n.alias("b"), F.col("b.doc_id") == F.col("a.doc_id") + 2).select(F.concat("a.id", F.lit(":S")).alias("from_id"), F.col("b.id").alias("to_id"), F.lit("calls").alias("relation_type"))
    return held.union(used).union(calls).union(back)


_FILES = NODES.replace("nodes AS (", "files AS (", 1)
MIXED = f"""{_FILES}, nodes AS (SELECT id, type, content FROM files UNION ALL SELECT id || ':S', 'function', left(content, 80) FROM files UNION ALL SELECT DISTINCT 'lib' || regexp_extract(id, '(\\.[^./]*)$', 1), 'import', '' FROM files)"""
MIXED_EDGES = """edges AS (SELECT id AS from_id, id || ':S' AS to_id, 'contains' AS rel FROM files UNION ALL SELECT id, 'lib' || regexp_extract(id, '(\\.[^./]*)$', 1), 'imports' FROM files
 UNION ALL SELECT a.id || ':S', b.id || ':S', 'calls' FROM files a JOIN files b ON b.doc_id = a.doc_id + 1 UNION ALL SELECT a.id || ':S', b.id, 'calls' FROM files a JOIN files b ON b.doc_id = a.doc_id + 2)"""


@query(f"""WITH {_BM25.replace(NODES, MIXED)} SELECT query_id, rn AS rank, CASE WHEN top.type = 'function' THEN '[function] ' || id || ' — ' || trim(string_split(content, chr(10))[1]) WHEN top.type = 'import' THEN '[import] ' || id
 ELSE '[' || CASE top.type WHEN 'go_file' THEN 'go' WHEN 'ts_file' THEN 'typescript' WHEN 'py_file' THEN 'python' ELSE 'text' END || regexp_extract(id, '(\\.[^./]*)$', 1) || '] ' || id || ' (' || len(string_split(content, chr(10))) || ' lines)' END AS line
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id)::INT AS rn FROM bm) top JOIN nodes USING (id) WHERE rn <= 10""")
def hybrid_search(spark, sf):
    """Summary lines of the ten best nodes of any kind: files, symbols, imports."""
    n = stored(mixed_nodes(spark, sf).select("id", "type", "content"))
    hits = settled(fts.search(n, asked(spark, sf), 10, files_only=False).drop("type"))
    return n.join(fts._bounded(hits, hits.count()), "id").select("query_id", "rank", T.summary_line(F.col("id"), F.col("type"), F.col("content")).alias("line"))


@query(f"""WITH {_SCORED}, files AS (SELECT id, doc_id FROM nodes), {MIXED_EDGES}, kinds AS (SELECT id, type FROM nodes UNION ALL SELECT id || ':S', 'function' FROM nodes UNION ALL SELECT DISTINCT 'lib' || regexp_extract(id, '(\\.[^./]*)$', 1), 'import' FROM nodes),
 sd AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM sc) WHERE rn <= 30),
 e1 AS (SELECT DISTINCT query_id, e.from_id, e.to_id, e.rel FROM sd JOIN edges e ON e.from_id = sd.id), f1 AS (SELECT DISTINCT query_id, to_id AS id FROM e1 WHERE (query_id, to_id) NOT IN (SELECT (query_id, id) FROM sd)),
 e2 AS (SELECT DISTINCT query_id, e.from_id, e.to_id, e.rel FROM f1 JOIN edges e ON e.from_id = f1.id), found AS (SELECT query_id, from_id, to_id, rel, min(d) AS d FROM (SELECT *, 1 AS d FROM e1 UNION ALL SELECT *, 2 FROM e2) GROUP BY ALL),
 far AS (SELECT query_id, to_id AS id, min(d) AS hop FROM found WHERE rel <> 'contains' GROUP BY ALL),
 inside AS (SELECT found.query_id, found.to_id AS id, min(far.hop) AS hop FROM found JOIN far ON far.query_id = found.query_id AND far.id = found.from_id WHERE rel = 'contains' AND (found.query_id, found.to_id) NOT IN (SELECT (query_id, id) FROM far) GROUP BY ALL),
 hop AS (SELECT * FROM far UNION ALL SELECT * FROM inside), fresh AS (SELECT hop.query_id, hop.id, hop, type FROM hop JOIN kinds USING (id) WHERE (query_id, hop.id) NOT IN (SELECT (query_id, id) FROM sc)),
 parent AS (SELECT query_id, regexp_replace(id, ':[^:]*$', '') AS id, min(hop) AS hop FROM fresh WHERE type = 'function' GROUP BY ALL),
 boost AS (SELECT query_id, id, max(0.15 / ln(hop + 2)) AS boost FROM (SELECT query_id, id, hop FROM hop UNION ALL SELECT * FROM parent) WHERE (query_id, id) IN (SELECT (query_id, id) FROM sc) GROUP BY ALL),
 added AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT query_id, id, hop FROM fresh UNION ALL SELECT * FROM parent WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM sc)) GROUP BY ALL)
 SELECT query_id, id, round(score, 4) AS score, 'fts' AS source, round(coalesce(boost, 0), 4) AS boost FROM sc LEFT JOIN boost USING (query_id, id) UNION ALL SELECT query_id, id, round(0.3 / ln(hop + 2), 4), 'graph', 0 FROM added""")
def graph_expand_symbols(spark, sf):
    """Expansion over files, symbols and imports: symbols lift their files or bring them in."""
    found = settled(_scored(spark, sf)[1])
    _, hops = graph.trace_many(mixed_edges(spark, sf), rank.seeds(found), 2)
    out = rank.expand_graph(found, settled(hops), mixed_nodes(spark, sf).select("id", "type"))
    return out.select("query_id", "id", F.round("score", 4).alias("score"), "source", F.round("boost", 4).alias("boost"))


@query(f"WITH {_BM25} SELECT query_id, count(*) AS n, min(rn) AS first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS rn FROM bm) WHERE rn <= 200 GROUP BY query_id")
def baseline_paths(spark, sf):
    return context.baseline(nodes(spark, sf), asked(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").cast("bigint").alias("first"))


# graph


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT from_id, to_id, relation_type, 1 AS depth FROM edges WHERE from_id = 'r1' UNION SELECT e.from_id, e.to_id, e.relation_type, b.depth + 1 FROM b JOIN edges e ON e.from_id = b.to_id WHERE b.depth < 4)
 SELECT from_id, to_id, relation_type, min(depth)::BIGINT AS depth FROM b GROUP BY ALL""")
def trace_edges(spark, sf):
    return graph.trace(settled(edges(spark, sf)), "r1", 4, limit=None)


_MULTI = f"""{EDGES}, seeds AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 2), b AS (SELECT from_id, to_id, relation_type, 1 AS depth FROM edges WHERE from_id IN (SELECT id FROM seeds)
 UNION SELECT e.from_id, e.to_id, e.relation_type, b.depth + 1 FROM b JOIN edges e ON e.from_id = b.to_id WHERE b.depth < 3)"""


def _multi(spark, sf):
    seeds = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return graph.trace_many(settled(edges(spark, sf)), seeds, 3, limit=None)


@query(f"WITH RECURSIVE {_MULTI} SELECT from_id, to_id, relation_type, min(depth)::BIGINT AS depth FROM b GROUP BY ALL")
def trace_edges_multi(spark, sf):
    return _multi(spark, sf)[0]


@query(f"WITH RECURSIVE {_MULTI} SELECT to_id AS id, min(depth)::BIGINT AS hop FROM b WHERE relation_type <> 'contains' GROUP BY to_id")
def trace_min_hops(spark, sf):
    return _multi(spark, sf)[1]


@query(f"""WITH RECURSIVE {EDGES}, turned AS (SELECT from_id, to_id, CASE WHEN from_id LIKE 'r%' THEN 'calls' ELSE relation_type END AS rel FROM edges), b AS (SELECT from_id, to_id, rel, 1 AS depth FROM turned WHERE from_id LIKE 'r%'
 UNION SELECT e.from_id, e.to_id, e.rel, b.depth + 1 FROM b JOIN turned e ON e.from_id = b.to_id WHERE b.depth < 2), h AS (SELECT to_id AS id, min(depth) AS hop FROM b WHERE rel <> 'contains' GROUP BY to_id)
 SELECT id, hop::BIGINT AS hop FROM h UNION ALL SELECT b.to_id, min(h.hop)::BIGINT FROM b JOIN h ON h.id = b.from_id WHERE b.rel = 'contains' AND b.to_id NOT IN (SELECT id FROM h) GROUP BY b.to_id""")
def trace_contains(spark, sf):
    e = settled(edges(spark, sf).withColumn("relation_type", F.when(F.col("from_id").startswith("r"), "calls").otherwise(F.col("relation_type"))))
    seeds = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.trace_many(e, seeds, 2, limit=None)[1]


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT e.to_id, b.depth + 1 FROM b JOIN edges e ON e.from_id = b.id WHERE b.depth < 2) SELECT DISTINCT id FROM b""")
def trace_node_ids(spark, sf):
    return graph.trace_nodes(settled(edges(spark, sf)), "c1", 2, limit=None)


_CALLS = """sym AS (SELECT p_brand || '/' || p_partkey AS id, 'f' || p_partkey % 700 AS name, p_brand AS dir FROM part), pend AS (SELECT p_brand || '/' || p_partkey AS caller, p_brand AS dir, 'f' || p_partkey * 3 % 900 AS callee FROM part)"""


@query(f"""WITH {_CALLS}, l AS (SELECT name, dir, count(*) AS n, min(id) AS id FROM sym GROUP BY ALL), g AS (SELECT name, count(*) AS n, min(id) AS id FROM sym GROUP BY name)
 SELECT DISTINCT caller AS from_id, to_id FROM (SELECT caller, CASE WHEN l.n = 1 THEN l.id WHEN l.n IS NULL AND g.n = 1 AND pend.dir <> '(root)' THEN g.id END AS to_id FROM pend LEFT JOIN l ON l.name = callee AND l.dir = pend.dir LEFT JOIN g ON g.name = callee) WHERE to_id IS NOT NULL AND to_id <> caller""")
def resolve_calls(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("dir"), F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("id"))
    named = lambda key: F.concat(F.lit("f"), key.cast("string"))
    symbols = p.select("id", named(F.col("p_partkey") % 700).alias("name"), "dir")
    pending = p.select(F.col("id").alias("caller"), "dir", named(F.col("p_partkey") * 3 % 900).alias("callee"))
    return graph.resolve_calls(pending, symbols).select("from_id", "to_id")


# co-occurrence

_BASKET = "bt AS (SELECT DISTINCT l_orderkey AS doc, p_brand AS term FROM lineitem JOIN part ON p_partkey = l_partkey), bn AS (SELECT count(DISTINCT doc) AS n FROM bt), bdf AS (SELECT term, count(*) AS df FROM bt GROUP BY term), bp AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM bt a JOIN bt b ON a.doc = b.doc AND a.term < b.term GROUP BY ALL HAVING count(*) >= 2)"
_PPMI = f"{_BASKET}, w AS (SELECT a, b, ln(bp.n * (SELECT n FROM bn)::DOUBLE / (x.df * y.df)) AS weight FROM bp JOIN bdf x ON x.term = a JOIN bdf y ON y.term = b), nb AS (SELECT * FROM (SELECT term, neighbour, weight, row_number() OVER (PARTITION BY term ORDER BY round(weight, 9) DESC, neighbour) AS rn FROM (SELECT a AS term, b AS neighbour, weight FROM w WHERE weight > 0 UNION ALL SELECT b, a, weight FROM w WHERE weight > 0)) WHERE rn <= 10)"


def _baskets(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("p_brand").alias("term")).distinct()


@query(f"WITH {_BASKET} SELECT term, df FROM bdf")
def doc_freq(spark, sf):
    return cooccur.frequencies(_baskets(spark, sf))


@query(f"WITH {_BASKET} SELECT a, b, n FROM bp")
def cooccur_counts(spark, sf):
    return cooccur.pairs(_baskets(spark, sf))


def _ppmi(spark, sf):
    b = _baskets(spark, sf)
    return cooccur.ppmi(b, b.select("doc").distinct().count())


@query(f"WITH {_PPMI} SELECT term, neighbour, round(weight, 6) AS weight FROM nb")
def ppmi_topk(spark, sf):
    return _ppmi(spark, sf).select("term", "neighbour", F.round("weight", 6).alias("weight"))


@query(f"WITH {_PPMI} SELECT term, neighbour, round(weight, 6) AS weight FROM nb WHERE rn <= 2 AND term IN (SELECT min(p_brand) FROM part GROUP BY p_type)")
def neighbour_lookup(spark, sf):
    terms = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_brand").alias("term"))
    return cooccur.nearest(_ppmi(spark, sf), terms, 2).select("term", "neighbour", F.round("weight", 6).alias("weight"))


@query(f"WITH {_PPMI}, q AS (SELECT p_type AS query_id, min(p_brand) AS t FROM part GROUP BY p_type) SELECT query_id, t AS first, count(neighbour) + 1 AS n_terms FROM q LEFT JOIN (SELECT * FROM nb WHERE rn <= 3) ON term = t GROUP BY query_id, t")
def expand_query(spark, sf):
    q = table(spark, sf, "part").groupBy(F.col("p_type").alias("query_id")).agg(F.min("p_brand").alias("t")).select("query_id", F.array("t").alias("terms"))
    return cooccur.expand(q, _ppmi(spark, sf), 3).select("query_id", F.col("terms")[0].alias("first"), F.size("terms").cast("bigint").alias("n_terms"))


@query(f"""WITH v AS (SELECT DISTINCT doc_id AS doc, unnest(list_concat(list_transform({_raw_sql("coalesce(text, '')")}, lambda t: {_HEX_STEM}), list_transform({_split_sql("coalesce(text, '')")}, lambda p: hex(encode(p))))) AS term FROM documents),
 c AS MATERIALIZED (SELECT term, df, row_number() OVER (ORDER BY term)::INT AS k FROM (SELECT term, count(*) AS df FROM v GROUP BY term HAVING count(*) >= 2)), d AS MATERIALIZED (SELECT doc::INT AS doc, k FROM v JOIN c USING (term)),
 p AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM d x JOIN d y ON x.doc = y.doc AND x.k < y.k GROUP BY ALL HAVING count(*) >= 2),
 w AS (SELECT a, b, ln(n * (SELECT count(*) FROM documents)::DOUBLE / (x.df * y.df)) AS weight FROM p JOIN c x ON x.k = a JOIN c y ON y.k = b),
 t AS (SELECT * FROM (SELECT a, b, weight, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM (SELECT * FROM w WHERE weight > 0 UNION ALL SELECT b, a, weight FROM w WHERE weight > 0)) WHERE r <= 10)
 SELECT x.term AS term, y.term AS neighbour, round(weight, 6) AS weight FROM t JOIN c x ON x.k = a JOIN c y ON y.k = b""")
def ppmi_documents(spark, sf):
    """Neighbours of all terms of all documents; terms in hexadecimal, since stems can end inside a character."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("doc"), T.vocabulary_tokens(F.col("text")).alias("terms"))
    shown = lambda c: F.hex(F.col(c).cast("binary")).alias(c)
    return cooccur.document_ppmi(d, d.count()).select(shown("term"), shown("neighbour"), F.round("weight", 6).alias("weight"))


# vectors

_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS norm, len(embedding) AS dim FROM embeddings")
def vector_norms(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(vector.dot(F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double")))), 6).alias("norm"), F.size("embedding").cast("bigint").alias("dim"))


@query(f"WITH {_UNIT} SELECT query_id, id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rn FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(q.v, c.v) AS cosine FROM u q JOIN benchmark ON q.vec_id = item_id, u c)) WHERE rn <= 10")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = asked(spark, sf).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vec"))
    return vector.top_cosine(vectors, queries).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query(ORACLES["vector_topk"])
def vector_index_topk(spark, sf):
    """The same from a stored index, of which only the blocks that can hold a result are read."""
    e = table(spark, sf, "embeddings")
    queries = asked(spark, sf).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vec"))
    found, _ = clusters.search(clusters.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))), queries)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"))


# directories


@query(f"WITH {NODES} SELECT dir, count(*) AS n_files FROM nodes GROUP BY dir ORDER BY n_files DESC, dir LIMIT 8")
def branches_topk(spark, sf):
    n = nodes(spark, sf)
    none = n.select("id").limit(0)
    return nav.branches(n, none, nav.symbol_counts(n)).select("dir", "n_files")


@query("SELECT split_part(url, '/', 3) || '/' || split_part(url, '/', 4) AS dir, count(*) AS n_symbols FROM pages GROUP BY ALL")
def symbol_counts_by_dir(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.split("url", "/")[2], F.lit("/"), F.split("url", "/")[3], F.lit("/f:"), F.col("page_id").cast("string")).alias("id"))
    return nav.symbol_counts(p)


@query(f"WITH {NODES}, s AS (SELECT dir, id, row_number() OVER (PARTITION BY dir ORDER BY id) AS rn, count(*) OVER (PARTITION BY dir) AS n FROM nodes) SELECT dir, string_agg(regexp_replace(regexp_extract(id, '([^/]*)$', 1), '\\.[^.]*$', ''), ', ' ORDER BY id) || CASE WHEN max(n) >= 5 THEN ', …' ELSE '' END AS summary FROM s WHERE rn <= 5 GROUP BY dir")
def dir_summary(spark, sf):
    n = nodes(spark, sf).select("id", T.directory(F.col("id")).alias("dir"))
    first = n.withColumn("n", F.row_number().over(Window.partitionBy("dir").orderBy("id"))).filter("n <= 5")
    return first.groupBy("dir").agg(F.collect_list("id").alias("names")).select("dir", T.directory_summary(F.col("names")).alias("summary"))


@query(f"""WITH {NODES}, l AS (SELECT id, type, content, string_split(content, chr(10)) AS x FROM nodes WHERE starts_with(id, 'src3/')), d AS (SELECT *, {_DEFINES} AS d FROM l)
 SELECT id, type, greatest(1, strlen(CASE type WHEN 'py_file' THEN {_lines_sql(120, 'd', 'array_to_string(d, chr(10))')} ELSE {_lines_sql(120)} END) // 4) AS tokens, row_number() OVER (ORDER BY id)::INT AS rank FROM d""")
def drill_down(spark, sf):
    return nav.drill(nodes(spark, sf), "src3/").select("id", "type", "tokens", "rank")


# evaluation

_EVAL = "r AS (SELECT doc_id % 97 AS query_id, doc_id AS file, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY n_chars DESC, doc_id) AS rank, n_chars AS tokens FROM documents), g AS (SELECT DISTINCT doc_id % 97 AS query_id, doc_id AS file FROM labels WHERE quality = 1)"
_PER = f"{_EVAL}, gt AS (SELECT query_id, count(*) AS n_truth FROM g GROUP BY ALL), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN g USING (query_id, file) WHERE rank <= 5 GROUP BY ALL), m AS (SELECT query_id, coalesce(hits, 0) AS hits, coalesce(hits / 5.0, 0)::DOUBLE AS precision, coalesce(hits / n_truth, 0)::DOUBLE AS recall, coalesce(1.0 / first, 0)::DOUBLE AS mrr, coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i) WHERE i <= n_truth), 0)::DOUBLE AS ndcg FROM gt LEFT JOIN h USING (query_id))"


def _evaluated(spark, sf):
    """Documents ranked by length within 97 residue classes of their number, against those labelled good."""
    d = table(spark, sf, "documents").select((F.col("doc_id") % 97).alias("query_id"), F.col("doc_id").alias("file"), F.col("n_chars").alias("tokens"))
    r = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tokens"), "file")))
    return r, table(spark, sf, "labels").filter("quality = 1").select((F.col("doc_id") % 97).alias("query_id"), F.col("doc_id").alias("file")).distinct()


@query(f"WITH {_PER} SELECT query_id, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def metrics_per_query(spark, sf):
    m = metrics.per_query(*_evaluated(spark, sf))
    return m.select("query_id", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(f"WITH {_PER}, x AS (SELECT unnest(['precision', 'recall', 'mrr', 'ndcg']) AS metric, unnest([precision, recall, mrr, ndcg]) AS v FROM m) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, round(median(v), 6) AS median FROM x GROUP BY metric")
def metrics_summary(spark, sf):
    s = metrics.summary(metrics.per_query(*_evaluated(spark, sf)))
    return s.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "median")])


@query(f"WITH {_EVAL} SELECT query_id, sum(tokens)::BIGINT AS tokens, sum(CASE WHEN g.file IS NOT NULL THEN tokens ELSE 0 END)::BIGINT AS useful, round(sum(CASE WHEN g.file IS NOT NULL THEN tokens ELSE 0 END)::DOUBLE / sum(tokens), 6) AS density FROM r LEFT JOIN g USING (query_id, file) GROUP BY query_id")
def information_density(spark, sf):
    d = metrics.density(*_evaluated(spark, sf))
    return d.select("query_id", F.col("tokens").cast("bigint").alias("tokens"), F.col("useful").cast("bigint").alias("useful"), F.round("density", 6).alias("density"))


_EFFICIENT = f"""{_PER}, used AS (SELECT query_id, sum(tokens) AS tokens, sum(CASE WHEN g.file IS NOT NULL THEN tokens ELSE 0 END)::DOUBLE / sum(tokens) AS density FROM r LEFT JOIN g USING (query_id, file) WHERE rank <= 5 GROUP BY query_id),
 raw AS (SELECT query_id, sum(tokens) AS raw_tokens FROM r GROUP BY query_id), x AS (SELECT m.query_id, precision, coalesce(tokens, 0) AS tokens, coalesce(density, 0) AS density, tokens / raw_tokens AS ratio FROM m LEFT JOIN used USING (query_id) LEFT JOIN raw USING (query_id)),
 y AS (SELECT *, 1 - ratio AS compression, CASE WHEN 1 - ratio > 0 THEN CASE WHEN precision + density > 0 THEN 2 * precision * density / (precision + density) ELSE 0 END END AS efficiency FROM x)"""


def _efficient(spark, sf):
    retrieved, truth = _evaluated(spark, sf)
    used = metrics.density(retrieved.filter("rank <= 5"), truth)
    raw = retrieved.groupBy("query_id").agg(F.sum("tokens").alias("raw_tokens"))
    return metrics.efficiency(metrics.per_query(retrieved, truth), used, raw)


@query(f"WITH {_EFFICIENT} SELECT query_id, tokens::BIGINT AS tokens, tokens <= 4000 AS within, round(ratio, 6) AS ratio, round(efficiency, 6) AS efficiency FROM y")
def metrics_efficiency(spark, sf):
    return _efficient(spark, sf).select("query_id", F.col("tokens").cast("bigint").alias("tokens"), "within", F.round("ratio", 6).alias("ratio"), F.round("efficiency", 6).alias("efficiency"))


@query(f"""WITH {_EFFICIENT} SELECT count(*) AS n, round(avg(tokens), 3) AS tokens, round(100 * avg((tokens <= 4000)::INT), 3) AS pass_percent, round(coalesce(avg(ratio), 0), 3) AS ratio, round(coalesce(avg(compression) FILTER (compression > 0), 0), 3) AS compression,
 round(coalesce(avg(density) FILTER (compression > 0), 0), 3) AS density, round(coalesce(avg(efficiency) FILTER (compression > 0), 0), 3) AS efficiency FROM y""")
def metrics_totals(spark, sf):
    return metrics.totals(_efficient(spark, sf))


# code and events


def _sources(spark, sf, extension: str, text: str):
    """One source file per part: {n} is its key, {m} the next one's."""
    key = F.col("p_partkey").cast("string")
    pieces = [F.lit(x) if i % 2 == 0 else key if x == "n" else (F.col("p_partkey") + 1).cast("string") for i, x in enumerate(re.split(r"\{(n|m)\}", text))]
    return spread(table(spark, sf, "part").select("p_partkey")).select(F.concat(F.lit("s/"), key, F.lit(extension)).alias("id"), F.concat(*pieces).alias("content"))


def _symbols(files, precise=False):
    found = extract.parsed(files, precise).select("id", F.explode("symbols").alias("s"))
    return found.select("id", "s.name", "s.type", F.col("s.line").alias("line"), F.array_join("s.calls", " ").alias("calls"))


def _symbols_sql(extension: str, rows: list[tuple[str, str, int, str]]) -> str:
    """The expected symbols of every part: name, type, line and calls, {n} and {m} as in the source."""
    filled = lambda x: "'" + x.replace("{n}", "' || p_partkey || '").replace("{m}", "' || (p_partkey + 1) || '") + "'"
    return " UNION ALL ".join(f"SELECT 's/' || p_partkey || '{extension}' AS id, {filled(n)} AS name, '{t}' AS type, {line} AS line, {filled(c)} AS calls FROM part" for n, t, line, c in rows)


_GO = 'package s\n\nimport "fmt"\n\ntype T{n} struct {\n\tA int\n}\n\nconst C{n} = 1\n\nfunc (t *T{n}) Run{n}() {\n\thelp{n}()\n\tfmt.Println(Run{m}())\n}\n\nfunc help{n}() {}\n'
_PY = "import os, sys\nfrom a.b import c\n\nclass K{n}:\n    @cached\n    def run{n}(self):\n        print(len(go{m}()))\n        return self.go{n}(1)\n\nasync def go{n}(x):\n    return isinstance(x, K{n})\n"
_TS = "import a from './x{n}'\nexport interface I{n} { go(): void }\nexport class K{n} {\n  run{n}(a: string): void { help{n}(a); this.api.get(a); }\n}\nenum E{n} { A }\ntype Y{n} = string\nexport const f{n} = async (a) => go{m}(a)\nfunction help{n}() { new K{n}() }\n"
_RS = "pub struct S{n} { a: i32 }\npub enum E{n} { A }\ntrait T{n} {\n    fn area(&self);\n}\nimpl T{n} for S{n} {\n    fn area(&self) { help{n}(self.a); crate::go{m}(1); println!(\"x\"); }\n}\ntype Y{n} = S{n};\nasync fn help{n}() {}\n"


@query(_symbols_sql(".go", [("T{n}", "type", 5, ""), ("C{n}", "variable", 9, ""), ("Run{n}", "function", 11, "help{n} Run{m}"), ("help{n}", "function", 16, "")]))
def extract_go(spark, sf):
    return _symbols(_sources(spark, sf, ".go", _GO))


@query(_symbols_sql(".py", [("K{n}", "class", 4, ""), ("run{n}", "function", 6, "go{m} go{n}"), ("go{n}", "function", 10, "")]))
def extract_python(spark, sf):
    return _symbols(_sources(spark, sf, ".py", _PY))


@query(_symbols_sql(".py", [("K{n}", "class", 4, ""), ("run{n}", "function", 6, "go len print"), ("go{n}", "function", 10, "isinstance")]).replace("'go len print'", "array_to_string(list_sort(['go' || p_partkey, 'go' || (p_partkey + 1), 'len', 'print']), ' ')"))
def extract_python_precise(spark, sf):
    return _symbols(_sources(spark, sf, ".py", _PY), precise=True)


@query(_symbols_sql(".ts", [("I{n}", "interface", 2, ""), ("K{n}", "class", 3, ""), ("Y{n}", "type_alias", 7, ""), ("f{n}", "function", 8, ""), ("help{n}", "function", 9, "")]))
def extract_ts(spark, sf):
    return _symbols(_sources(spark, sf, ".ts", _TS))


@query(_symbols_sql(".ts", [("I{n}", "interface", 2, ""), ("K{n}", "class", 3, ""), ("run{n}", "method", 4, "get help{n}"), ("E{n}", "enum", 6, ""), ("Y{n}", "type_alias", 7, ""), ("f{n}", "function", 8, "go{m}"), ("help{n}", "function", 9, "")]))
def extract_ts_precise(spark, sf):
    return _symbols(_sources(spark, sf, ".ts", _TS), precise=True)


@query(_symbols_sql(".js", [("K{n}", "class", 3, ""), ("run{n}", "method", 4, "get help{n}"), ("f{n}", "function", 8, "go{m}"), ("help{n}", "function", 9, "")]))
def extract_js_precise(spark, sf):
    return _symbols(_sources(spark, sf, ".js", _TS), precise=True)


@query(_symbols_sql(".rs", [("S{n}", "struct", 1, ""), ("E{n}", "enum", 2, ""), ("T{n}", "trait", 3, ""), ("area", "function", 4, ""), ("T{n} for S{n}", "impl", 6, ""), ("area", "function", 7, ""), ("help{n}", "function", 10, "")]))
def extract_rust(spark, sf):
    return _symbols(_sources(spark, sf, ".rs", _RS))


@query(_symbols_sql(".rs", [("S{n}", "struct", 1, ""), ("E{n}", "enum", 2, ""), ("T{n}", "trait", 3, ""), ("S{n}", "impl", 6, ""), ("area", "function", 7, "go{m} help{n}"), ("Y{n}", "type_alias", 9, ""), ("help{n}", "function", 10, "")]))
def extract_rust_precise(spark, sf):
    return _symbols(_sources(spark, sf, ".rs", _RS), precise=True)


@query("""SELECT 's/' || p_partkey || x.e AS id, unnest(CASE x.e WHEN '.go' THEN ['fmt'] WHEN '.py' THEN ['os', 'sys', 'a.b'] ELSE ['./x' || p_partkey] END) AS imported FROM part, (VALUES ('.go'), ('.py'), ('.ts')) x(e)""")
def extract_imports(spark, sf):
    files = _sources(spark, sf, ".go", _GO).union(_sources(spark, sf, ".py", _PY)).union(_sources(spark, sf, ".ts", _TS))
    return extract.parsed(files).select("id", F.explode("imports").alias("imported"))


@query("""SELECT relation_type, count(*) AS n FROM (SELECT 'contains' AS relation_type FROM part, range(4) UNION ALL SELECT 'imports' FROM part UNION ALL SELECT 'calls' FROM part UNION ALL SELECT 'calls' FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)) GROUP BY relation_type""")
def parsed_edges(spark, sf):
    """Edges of Go files: what they contain and import, calls inside a file and, by the name of a method, across files."""
    files = _sources(spark, sf, ".go", _GO).select("id", F.lit("go_file").alias("type"), "content", F.sha2("content", 256).alias("hash"))
    return extract.graph(files, settled(extract.parsed(files)))[1].groupBy("relation_type").agg(F.count("*").alias("n"))


@query("""SELECT 's/' || p_partkey || '.go' AS id, 'package s' || chr(10) || 'import "fmt"' || chr(10) || 'type T' || p_partkey || ' struct' || chr(10) || 'const C' || p_partkey || ' = 1' || chr(10) || 'func (t *T' || p_partkey || ') Run' || p_partkey || '()' || chr(10) || 'func help' || p_partkey || '()' AS outline FROM part""")
def go_outlines(spark, sf):
    files = _sources(spark, sf, ".go", _GO).select("id", F.lit("go_file").alias("type"), "content")
    return extract.outlines(files)


@query("SELECT 's/' || p_partkey || '.rs' AS id, 7::BIGINT AS n, 'S' || p_partkey AS first FROM part")
def symbols_json(spark, sf):
    """Symbols to JSON and back."""
    back = extract.from_json(extract.as_json(extract.parsed(_sources(spark, sf, ".rs", _RS), precise=True)))
    return back.select("id", F.size("symbols").cast("bigint").alias("n"), F.col("symbols")[0]["name"].alias("first"))



@query("""SELECT name, type, count(*) AS n, min(line) AS line FROM (SELECT 'make_' || p_partkey AS name, 'function' AS type, 4 AS line FROM part UNION ALL SELECT 'Part' || p_size, 'class', 7 FROM part UNION ALL SELECT 'price', 'function', 8 FROM part) GROUP BY name, type""")
def extract_symbols(spark, sf):
    """Symbols of one small source file per part, made from its columns."""
    source = F.concat(F.lit("import os\n\n@cached\ndef make_"), F.col("p_partkey").cast("string"), F.lit("(x):\n    return build(x)\n\nclass Part"), F.col("p_size").cast("string"), F.lit(":\n    async def price(self):\n        return obj.lookup(self)\n"))
    files = spread(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")).select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("id"), source.alias("content"))
    return extract.parsed(files).select("id", F.explode("symbols").alias("s")).groupBy("s.name", "s.type").agg(F.count("*").alias("n"), F.min("s.line").alias("line"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    w = incremental.windowed_counts(table(spark, sf, "events").select("ts", "event_type", "value"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
