"""Leaves of boosted trees, against walks through them."""

import pytest

from hinspark.operators import trees
from hinspark.queries_stores import QUERIES, customer_rows


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return customer_rows(spark, sf_dir)


def walked(node, x):
    """(leaf's number from the left, leaves below) of a row in a subtree."""
    if node.getClass().getSimpleName() == "LeafNode":
        return 0, 1
    (a, n), (b, m) = walked(node.leftChild(), x), walked(node.rightChild(), x)
    split = node.split()
    return (a if x[split.featureIndex()] <= split.threshold() else n + b), n + m


def test_leaves_are_those_of_walks(spark, rows):
    models = trees.boosted(rows, 2, 3, 3)
    got = {(r.nid, r.tree): r.leaf for r in trees.leaves(models, rows).collect()}
    roots = [t._call_java("rootNode") for m in models for t in m.trees]
    assert len(roots) == 6 and any(walked(r, [0.0] * 4)[1] > 1 for r in roots)
    people = rows.collect()
    assert len(got) == 6 * len(people)
    for r in people[::7]:
        for k, root in enumerate(roots):
            assert got[r.nid, k] == walked(root, r.x)[0]


def test_leaf_ids_are_equal_on_reruns(spark, sf_dir):
    a, b = (sorted(tuple(r) for r in QUERIES["tree_leaf_ids"](spark, sf_dir).collect()) for _ in range(2))
    assert a == b
    pairs = sorted({(t, leaf) for _, t, leaf, _ in a})
    assert {(t, leaf): i for _, t, leaf, i in a} == {p: i for i, p in enumerate(pairs)}


def test_rows_are_scored_in_one_pass(spark, rows):
    """A pass for each class used to be united, and Spark put all of them into one task."""
    models = trees.boosted(rows, 3, 2, 2)
    for made in (trees.leaves(models, rows), trees.margins(models, rows)):
        assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
    for c, m in enumerate(models):
        alone = {(r.nid, r.tree + 2 * c, r.leaf) for r in trees.leaves([m], rows).collect()}
        assert alone == {tuple(r) for r in trees.leaves(models, rows).collect() if r.tree // 2 == c}
        assert {(r.nid, c, r.logit) for r in trees.margins([m], rows).collect()} == {tuple(r) for r in trees.margins(models, rows).collect() if r.cls == c}


def test_only_training_rows_teach(spark, rows):
    from pyspark.sql import functions as F

    other = rows.withColumn("label", F.when(F.col("split") == "train", F.col("label")).otherwise(F.col("nid") % 2))
    x, y = (sorted(tuple(r) for r in trees.leaves(trees.boosted(t, 1, 2, 2), rows).collect()) for t in (rows, other))
    assert x == y
    margins = trees.margins(trees.boosted(rows, 2, 1, 1), rows)
    assert margins.count() == 2 * rows.count() and margins.columns == ["nid", "cls", "logit"]


def test_embeddings_of_leaves_add_up(spark):
    ids = spark.createDataFrame([(0, 0), (0, 2), (1, 1)], "nid long, id long")
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [5.0, 5.0]), (2, [0.5, -1.0])], "id long, h array<double>")
    assert {r.nid: r.h for r in trees.leaf_embeddings(ids, table).collect()} == {0: [1.5, 1.0], 1: [5.0, 5.0]}
