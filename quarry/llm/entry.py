"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dac, fm, html_cut, jaccard, line_dedup, oracles, packing, phrases, quality, quoting, spelling, vafile, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr"]
    return quality.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).select(*columns)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe.round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return fm.classify(documents, documents, table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations, one row each, from the lists that the operator builds."""
    return quoting.conversations(table(spark, sf_dir, "conversations"), most_levels=None, follow=True).select("root_conv", "root_turn", "part", F.inline("turns"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN, added=True)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return dac.write_and_read(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), added=True)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), slip=199))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {"op1_quality": op1_quality, "op2_byte_bpe": op2_byte_bpe, "op3_quality_classifier": op3_quality_classifier, "op4_top_k": op4_top_k, "op5_quotation_linking": op5_quotation_linking, "op6_jaccard": op6_jaccard, "op7_packing": op7_packing, "op8_token_files": op8_token_files, "op9_html": op9_html, "op10_warc": op10_warc, "op11_spelling": op11_spelling, "op12_phrases": op12_phrases, "op13_line_dedup": op13_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": oracles.QUALITY, "op4_top_k": oracles.TOP_K, "op5_quotation_linking": oracles.QUOTES, "op6_jaccard": oracles.JACCARD, "op10_warc": oracles.WARC, "op11_spelling": oracles.SPELLING, "op12_phrases": oracles.PHRASES, "op13_line_dedup": oracles.LINES}
