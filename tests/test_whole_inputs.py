"""Queries over whole tables, against brute force."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from hinspark import queries
from hinspark.operators import evaluate


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def read(sf_dir, name, *columns):
    return list(zip(*(pq.read_table(f"{sf_dir}/{name}.parquet", columns=[c])[c].to_pylist() for c in columns), strict=True))


def test_nhop_pairs_of_all_lines(spark, sf_dir):
    brand, nation, region = (dict(read(sf_dir, *x)) for x in (("part", "p_partkey", "p_brand"), ("customer", "c_custkey", "c_nationkey"), ("nation", "n_nationkey", "n_regionkey")))
    want = {(f"order-{o}", f"brand-{brand[p]}") for o, p in read(sf_dir, "lineitem", "l_orderkey", "l_partkey")}
    want |= {(f"order-{o}", f"nation-{nation[c]}") for o, c in read(sf_dir, "orders", "o_orderkey", "o_custkey")}
    want |= {(f"customer-{c}", f"region-{region[n]}") for c, n in nation.items()}
    assert rows(queries.QUERIES["nhop_pairs_all"](spark, sf_dir)) == sorted(want)


def test_homophily_of_all_customers(spark, sf_dir):
    people = read(sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    shares = [[a[2] == b[2] for b in people if a[1] == b[1] and a[0] != b[0]] for a in people]
    node = [sum(x) / len(x) for x in shares if x]
    edge = [x for s in shares for x in s]
    assert rows(queries.QUERIES["node_homophily_all"](spark, sf_dir))[0][0] == pytest.approx(sum(node) / len(node), abs=2e-6)
    assert rows(queries.QUERIES["edge_homophily_all"](spark, sf_dir))[0][0] == pytest.approx(sum(edge) / len(edge), abs=2e-6)


def test_homophily_from_counts_is_that_of_pairs(spark):
    links = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7), (4, 8), (5, 9), (6, 9), (9, 9)], "nid long, mid long")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1), (9, None)], "nid long, label long")
    pairs = links.select(links.nid.alias("dst"), "mid").distinct().join(links.select(links.nid.alias("src"), "mid").distinct(), "mid").select("dst", "src")
    got = rows(evaluate.co_member_homophily(links, labels))[0]
    assert got == pytest.approx((rows(evaluate.node_homophily(pairs, labels))[0][0], rows(evaluate.edge_homophily(pairs, labels))[0][0]))
    with pytest.raises(Exception, match="more than one middle node"):
        evaluate.co_member_homophily(links.union(spark.createDataFrame([(1, 8)], links.schema)), labels).collect()


def test_blocks_of_all_customers(spark, sf_dir):
    want = {("placed-by", o, c) for o, c in read(sf_dir, "orders", "o_orderkey", "o_custkey")}
    want |= {("in-order", p, o) for o, p in read(sf_dir, "lineitem", "l_orderkey", "l_partkey")}
    assert rows(queries.QUERIES["full_neighbor_blocks_all"](spark, sf_dir)) == sorted(want)


def test_neighbours_of_all_nations(spark, sf_dir):
    links = read(sf_dir, "customer", "c_custkey", "c_nationkey")
    got = rows(queries.QUERIES["neighbor_sample_all"](spark, sf_dir))
    size = Counter(n for _, n in links)
    assert set(got) <= set(links) and Counter(n for _, n in got) == {n: min(4, k) for n, k in size.items()}


def test_all_stored_rows(spark, sf_dir):
    want = Counter()
    for o, p, q in read(sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity"):
        want[o, p] += q
    assert rows(queries.QUERIES["stored_rows_all"](spark, sf_dir)) == sorted((*k, v) for k, v in want.items())
