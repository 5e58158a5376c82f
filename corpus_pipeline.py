"""The training-corpus pipeline: language, lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and rereads it as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hinspark.llm import bpe, decontam, langid, line_dedup, ngram_join
from hinspark.llm.queries import tokenizer
from hinspark.scratch import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is one of those learned and has at least half of the text."""
    return langid.accepted(docs, langid.fit(docs.where(~langid.held_out())), least_share=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line is equal to or within one edit of; one without lines left goes."""
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by 5-word shingles at a similarity of 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    checked = bpe.encode_and_check(docs.select("doc_id", "lang", "source", "text"), *tokenizer())
    return checked.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", tokens),
]

#: SQL expresses neither the language mixtures nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
