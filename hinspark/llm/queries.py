"""One query for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """The rank file and split pattern of the byte-level encoding."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import COUNTS, judge

    return judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link_documents

    return link_documents(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import write_and_read

    return write_and_read(_table(spark, sf_dir, "pages"), min_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import counted

    return counted(_table(spark, sf_dir, "documents"), *tokenizer())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest

    return digest(_table(spark, sf_dir, "documents"), *tokenizer())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, report

    rows = _table(spark, sf_dir, "conversations")
    return report(damaged(rows), rows)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assignment

    return assignment(_table(spark, sf_dir, "documents"), n_shards=8)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_html_extraction,
        op3_url_filters,
        op4_line_dedup,
        op5_ngram_jaccard_join,
        op6_warc,
        op7_token_counts,
        op8_byte_bpe,
        op9_language_id,
        op10_decontamination,
        op11_filter_audit,
        op12_conversation_repair,
        op13_sharding,
        pipeline,
    )
}

def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
