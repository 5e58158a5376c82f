"""Pairs met through middle nodes: none is shuffled where its head has one middle node, and none is lost."""

import random

import pytest

from pyspark.sql import functions as F

from hinspark import queries, scratch
from hinspark.operators import atomize, features, linalg, propagate, sample
from hinspark.sources import relational


def _pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("heads", [1, 3])
def test_joined_pairs_are_whole_and_distinct(spark, heads, monkeypatch):
    monkeypatch.setattr(linalg, "LIST_NODES", 4)
    monkeypatch.setattr(linalg, "TASK_PAIRS", 50)
    rng = random.Random(heads)
    first = {(s, rng.randrange(6)) for s in range(60) for _ in range(rng.randint(1, heads))}
    second = {(m, d) for m in range(7) for d in range(40) if rng.random() < 0.4}
    without = {(s, d) for s in range(0, 60, 2) for d in range(40) if rng.random() < (0.9 if s % 4 else 0.1)}  # some heads leave out more than they carry
    want = {(s, d) for s, m in first for n, d in second if m == n}
    made = spark.createDataFrame(sorted(first), "src long, mid long"), spark.createDataFrame(sorted(second), "mid long, dst long")
    assert _pairs(linalg.joined_pairs(*made)) == want
    assert _pairs(linalg.joined_pairs(*made, spark.createDataFrame(sorted(without), "src long, dst long"))) == want - without


def test_pairs_of_a_hub_are_not_shuffled(spark):
    """A hub's pairs used to be grouped and compared: an exchange after the last join."""
    leaves = spark.range(40).selectExpr("id + 1 as src", "0L as dst")
    for df in (sample.two_hop_candidates(leaves, leaves), sample.n_hop_candidates([[leaves, leaves.selectExpr("dst as src", "src as dst")]], leaves.selectExpr("src", "src as dst"))):
        assert df.count() == 40 * 39
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(b_list") < plan.index("RepartitionByExpression")
        assert "Aggregate" not in plan[: plan.index("Generate explode(b_list")]


def test_folds_without_strata_join_nothing_by_a_constant(spark):
    """All rows used to meet the one stratum's first place in one task."""
    rows = spark.range(5000).withColumnRenamed("id", "nid")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for stratum, parts in ((None, 0), (F.lit("all"), 64)):
            folds = sample.k_folds(rows, 5, stratum, "nid", 3)
            assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [1000] * 5
            plan = folds._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(__s" in plan) == bool(parts) and ("__part" in plan) == bool(parts)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _plans(monkeypatch):
    """Optimised plans of the tables that sampling writes, by their names."""
    plans, kept = [], sample.written

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(sample, "written", written)
    return plans


def test_every_edge_has_one_draw_first(spark, monkeypatch):
    """All eight draws of every edge used to meet the links, though the first nearly always does."""
    edges, plans = spark.range(300).selectExpr("id % 30 as src", "id * 7 % 50 as dst").distinct(), _plans(monkeypatch)
    got, links = sample.random_pairs(edges, 60, 60, 3).collect(), {tuple(r) for r in edges.collect()}
    assert len(got) == len(links) and not links & {tuple(r) for r in got}
    draws = [plan for name, plan in plans if name == "draws"]
    assert len(draws) > 1 and [plan.count("Generate explode") for plan in draws[:2]] == [1, 1] and "min_by" not in draws[0]


def test_short_lists_are_drawn_from_as_ranges_are(spark, monkeypatch):
    """Every candidate used to be numbered over all heads, its hash shuffled twice and written."""
    candidates = spark.range(900).selectExpr("id % 7 * (id % 3) as src", "id * 11 % 131 as dst").distinct()
    asked, plans = spark.range(15).selectExpr("id as src", "id % 5 + 1 as n"), _plans(monkeypatch)
    got = {}
    for limit in (4096, 40, 0):
        monkeypatch.setattr(sample, "LISTED", limit)
        got[limit] = sorted(map(tuple, sample.drawn(candidates, asked, 4).collect()))
        assert limit < 4096 or not any("md5" in plan for _, plan in plans)
    assert got[4096] == got[40] == got[0] and got[0]


def test_both_weights_of_words_need_one_shuffle_of_cells(spark, sf_dir):
    """Cells used to be joined to the sums of their rows and words apart, and then to each other."""
    rows = spark.createDataFrame([(1, "a b A  c"), (1, "b"), (2, "c c\tc"), (3, ""), (4, None), (5, "d a")], "doc_id long, text string")
    per_row, per_word = atomize.bag_of_words(atomize.words(rows, "doc_id", "text"))
    want = sorted(map(tuple, per_row.join(per_word.withColumnRenamed("weight", "x"), ["row", "word"]).collect()))
    assert sorted(map(tuple, atomize.bag_of_words_both(rows, "doc_id", "text").collect())) == want
    plan = queries.atomize_bow_docs(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_lines_are_grouped_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    """Tasks used to grow with the lines, as many as the session's partitions whatever the table."""
    want = sorted(map(tuple, queries.row_normalize(spark, sf_dir).collect()))
    monkeypatch.setattr(relational, "TASK_ROWS", 500)
    made = queries.row_normalize(spark, sf_dir)
    assert sorted(map(tuple, made.collect())) == want
    lines = relational.table(spark, sf_dir, "lineitem")
    assert relational.commerce(spark, sf_dir).edge("contains").rdd.getNumPartitions() == -(-lines.count() // 500)


def test_labels_that_few_nodes_gathered_are_sent_to_the_edges(spark, sf_dir, monkeypatch):
    """One task used to hold all cells of the last edge, as it was the gathered labels' one partition that edges were sent to."""
    made = []
    monkeypatch.setattr(propagate, "written", lambda df, name: made.append(scratch.written(df, name)) or made[-1])
    out = queries.label_propagate_no_leak(spark, sf_dir)
    assert [set(df.columns) for df in made] == [{"nid", "slot", "col", "val", "n"}]
    assert made[0].count() <= 25 * 5
    build = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin [src" in line and "[nid" in line]
    assert build and all("BuildRight" in line for line in build)


def test_products_are_made_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    """Only the lines were spread: orders, and what comes along them, stayed in as many tasks as the session has partitions."""
    want = sorted(map(tuple, queries.metapath_features(spark, sf_dir).collect()))
    for module in (relational, linalg):
        monkeypatch.setattr(module, "TASK_ROWS", 40)
    assert sorted(map(tuple, queries.metapath_features(spark, sf_dir).collect())) == want
    g = relational.commerce(spark, sf_dir)
    orders = g.nodes["order"].count()
    assert g.edge("places").rdd.getNumPartitions() == -(-orders // 40)
    cells = features.identity(g.nodes["order"], "order")
    adj, feats = linalg.by_source(linalg.row_normalized(linalg.adjacency(g.edge("placed-by"))), cells)
    assert adj.rdd.getNumPartitions() == feats.rdd.getNumPartitions() == -(-orders // 40)
    few = features.identity(g.nodes["nation"], "nation")
    assert linalg.by_source(adj, few) == (adj, few)
