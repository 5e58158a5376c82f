"""Empty tables, extra columns with clashing names, and very long values."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinspark.llm import bpe, langid, ngram_join, token_counts, warc
from hinspark.llm.queries import tokenizer


@pytest.fixture(scope="module")
def ranks():
    pytest.importorskip("public_tokenizers")
    return tokenizer()


def test_tokens_of_an_empty_table(docs, ranks):
    none = docs.where("false")
    assert token_counts.counted(none, *ranks).count() == 0
    assert bpe.digest(none, *ranks).count() == 0
    assert bpe.decode(bpe.encode(none, *ranks), *ranks).count() == 0


def test_languages_of_an_empty_table(docs):
    model = langid.fit(docs.where("false"))
    assert model.languages == [] and langid.predict(docs.where("false"), model).count() == 0
    known = langid.Mixture(["a"], np.ones((1, langid.CELLS)))
    assert langid.predict(docs.where("false"), known).count() == 0


def test_counts_of_languages_are_those_of_their_texts(docs):
    model = langid.fit(docs, max_docs_per_language=10**9)
    rows = docs.where("text is not null and lang is not null and doc_id is not null").select("lang", "text").collect()
    counts = np.zeros((len(model.languages), langid.CELLS))
    for lang, text in rows:
        np.add.at(counts[model.languages.index(lang)], langid.trigrams(np.frombuffer(text.encode(), dtype=np.uint8)), 1)
    assert np.array_equal(model.log_p, langid.Mixture(model.languages, counts).log_p)


def test_links_keep_to_id_and_text(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = plain.select("*", *(F.lit(9).alias(c) for c in ("n", "n_shingles", "component_id", "shingle", "key", "bits", "rep", "class_id", "pos", "size")))
    order = lambda df: sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())
    assert order(ngram_join.link_documents(clashing)) == order(ngram_join.link_documents(plain)) == [(1, 6, 1), (2, 6, 1), (3, 0, 3)]
    assert ngram_join.one_of_each(clashing).columns == clashing.columns


def test_archive_of_a_very_long_page_and_clashing_columns(spark):
    long = "漢字é<p>" * 1_000_000
    rows = [(3, "http://a.org/x", long), (1, "http://a.org/y", long), (2, "http://a.org/z", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.select("*", *(F.lit("other").alias(c) for c in ("sha1", "shard", "payload", "digest", "file", "record_type", "refers_to", "payload_bytes")))
    got = {r.page_id: r for r in warc.write_and_read(df, shard_bytes=1_000_000, roll_bytes=100_000).collect()}
    digest = base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert {i: (r.payload_bytes, r.record_type, r.refers_to) for i, r in got.items()} == {1: (len(long.encode()), "response", None), 2: (5, "response", None), 3: (len(long.encode()), "revisit", 1)}
    assert got[1].payload_digest == got[3].payload_digest == digest
