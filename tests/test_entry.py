"""The driver's contract, and every query with a twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from hinspark import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer", "brand", "w"] and df.count() > 0


def test_twins_have_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["metapath_adj_brand_customer", "prop_mean", "metapath_features", "label_propagate_no_leak", "two_hop_negative_candidates", "ranking_metrics", "roc_auc", "early_stopping", "gat_layer", "split_links"])
def test_twin(name, spark, duck, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    twin = duck.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(twin.columns)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    want = sorted(repr(tuple(r[twin.columns.index(c)] for c in order)) for r in twin.fetchall())
    assert got == want
