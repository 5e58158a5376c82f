"""The stages, each against its own input, and the SQL twins."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hinspark.llm import bpe, langid, queries
from hinspark.llm.queries import tokenizer
from hinspark.scratch import written


def test_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == [q for q in queries.QUERIES if q != "pipeline"] and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_stages(spark, sf_dir, docs):
    from .test_dedup import expected_lines, groups
    from .test_text_filters import hits

    model = langid.fit(docs.where(~langid.held_out()))
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in now.collect()]
        out = written(stage(spark, now, sf_dir), "stage")
        got = {r["doc_id"]: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert set(got) == {d for d, t in rows if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.5}
        elif k == 1:
            want = {d: t for d, _, n, t in expected_lines(rows) if n == 0 or t.strip()}
            assert {d: r["text"] for d, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif k == 2:
            assert set(got) == {d for d, _, c in groups(rows, 5, 80) if c == d}
        elif k == 3:
            assert set(got) == {d for d, t in rows if not hits(t, bench, 10)[4]}
        else:
            coder = bpe.encoding(*tokenizer())
            assert all(r["ids"] == coder.encode_ordinary(dict(rows)[d]) and r["decodes"] for d, r in got.items()) and len(got) == len(rows)
        now = out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(name, spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    twin = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(twin.columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[twin.columns.index(c)] for c in order)) for r in twin.fetchall())


def test_stage_columns_survive(odd):
    clean = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("extra"))
    assert corpus_pipeline.STAGES[1][1](None, clean, None).columns == clean.columns
