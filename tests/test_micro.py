"""A network of a few nodes with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from hinspark.graph import HinGraph, is_identity
from hinspark.operators import atomize, evaluate, features, linalg, propagate
from hinspark.types import Aliases, CEType, MetaGraph, in_prefix_order, self_loop

WRITES, WRITTEN = CEType("author", "writes", "paper"), CEType("paper", "written-by", "author")
CONTAINS, IS_IN = CEType("paper", "contains", "term"), CEType("term", "is-in", "paper")


@pytest.fixture(scope="module")
def g(spark):
    ids = lambda n: spark.range(n).withColumnRenamed("id", "nid")
    authors = spark.createDataFrame([(0, 0, "train"), (1, 1, "train"), (2, None, None)], "nid long, label int, split string")
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    w, c = [(0, 0), (0, 1), (1, 1), (2, 3)], [(0, 0), (1, 0), (1, 1), (2, 1)]
    back = lambda rows: [(b, a) for a, b in rows]
    return HinGraph(
        {"author": authors, "paper": ids(4), "term": ids(2)},
        {WRITES: e(w), WRITTEN: e(back(w)), CONTAINS: e(c), IS_IN: e(back(c))},
        {WRITES: WRITTEN, WRITTEN: WRITES, CONTAINS: IS_IN, IS_IN: CONTAINS},
        "author",
    )


def cells(df, *cols):
    return {tuple(r[:-1]): round(r[-1], 6) for r in df.select(*cols).collect()}


def norm(g, c):
    return linalg.row_normalized(linalg.adjacency(g.edges[c]))


def test_row_normalized(g):
    assert cells(norm(g, WRITTEN), "dst", "src", "w") == {(0, 0): 0.5, (0, 1): 0.5, (1, 1): 1, (2, 3): 1}
    assert cells(norm(g, WRITES), "dst", "src", "w") == {(0, 0): 1, (1, 0): 0.5, (1, 1): 0.5, (3, 2): 1}
    assert cells(norm(g, CONTAINS), "dst", "src", "w") == {(0, 0): 0.5, (0, 1): 0.5, (1, 1): 0.5, (1, 2): 0.5}


def test_row_of_zeros_stays_zero(spark):
    adj = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.0), (1, 1, -2.0), (1, 2, 2.0)], "dst long, src long, w double")
    assert cells(linalg.row_normalized(adj), "dst", "src", "w") == {(0, 1): 0, (0, 2): 0, (1, 1): -0.5, (1, 2): 0.5}


def test_metapath_products_and_diagonal(g):
    adjs = {c: norm(g, c) for c in g.edges}
    term = propagate.metapath_adjacency(adjs, (self_loop("term"), IS_IN, WRITTEN))
    assert cells(term, "dst", "src", "w") == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.5}
    apa = (WRITES, WRITTEN)
    assert cells(propagate.metapath_adjacency(adjs, apa), "dst", "src", "w") == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.5, (2, 2): 1}
    assert cells(propagate.metapath_diagonal(adjs, apa), "nid", "w") == {(0,): 0.75, (1,): 0.5, (2,): 1}


def test_product_is_associative(g):
    adjs = {c: norm(g, c) for c in g.edges}
    left = linalg.compose(linalg.compose(adjs[WRITTEN], adjs[WRITES]), linalg.compose(adjs[WRITTEN], adjs[IS_IN]))
    right = propagate.metapath_adjacency(adjs, (IS_IN, WRITTEN, WRITES, WRITTEN))
    assert cells(left, "dst", "src", "w") == cells(right, "dst", "src", "w")


def test_labels_do_not_leak(spark, g):
    adjs = {c: norm(g, c) for c in g.edges}
    labels = spark.createDataFrame([(0, "label", 0, 1.0), (1, "label", 1, 1.0)], features.LONG)
    out = propagate.label_features(adjs, (WRITES, WRITTEN), labels)
    assert cells(out, "nid", "col", "val") == {(0, 1): 0.25, (1, 0): 0.5}
    with pytest.raises(ValueError):
        propagate.label_features(adjs, (WRITES,), labels)


def test_training_labels_must_be_a_part(g):
    with pytest.raises(ValueError):
        propagate.training_labels(g.nodes["author"])


def test_mean_counts_zero_messages(g):
    own = features.identity(g.nodes["term"], "term")
    out = propagate.slots(g, {"term": own}, reduce="mean")
    assert cells(out["paper"], "nid", "col", "val") == {(0, 0): 1, (1, 0): 0.5, (1, 1): 0.5, (2, 1): 1}
    assert cells(out["author"], "nid", "col", "val") == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.5}


def test_absmax(spark, g):
    own = features.identity(g.nodes["term"], "term")
    out = propagate.slots(g, {"term": own}, reduce="absmax")
    assert cells(out["paper"], "nid", "col", "val") == {(0, 0): 1, (1, 0): 1, (1, 1): 1, (2, 1): 1}
    sent = spark.createDataFrame([(0, "s", 0, -2.0, 0), (0, "s", 0, 2.0, 1), (0, "s", 0, 1.0, 2)], "dst long, slot string, col int, val double, eid long")
    assert linalg.reduce_absmax(sent).first()["val"] == -2.0


def test_slots_refuse_two_paths_at_once():
    meta = MetaGraph(("a", "b"), (CEType("a", "x", "b"), CEType("a", "y", "b")))
    with pytest.raises(NotImplementedError):
        meta.hops("a", 3)


def test_metapath_features_share_prefixes(g):
    adjs = {c: norm(g, c) for c in g.edges}
    f = propagate.MetapathFeatures(adjs, {"term": features.identity(g.nodes["term"], "term")})
    t = self_loop("term")
    made = f.build([(t,), (t, IS_IN), (t, IS_IN, WRITTEN), (t, IS_IN, CONTAINS)])
    assert len(f.held) == 1
    assert cells(made[t, IS_IN, WRITTEN], "nid", "col", "val") == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.5, (1, 1): 0.5}
    f.free()
    assert not f.held


def test_pattern(g):
    pairs = {tuple(r) for r in propagate.metapath_pattern(g, [["writes", "written-by"]]).collect()}
    assert pairs == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}


def test_numeric_normalisation(spark):
    rows = spark.createDataFrame([(0, 2.0, -2.0), (1, 1.0, 0.0), (2, 0.0, 0.0), (3, 0.0, -3.0)], "k long, n0 double, n1 double")
    per_row, per_col = atomize.numeric_columns(rows, "k", ["n0", "n1"])
    assert cells(per_row, "row", "col", "weight") == {(0, "n0"): 1, (0, "n1"): -1, (1, "n0"): 2, (3, "n1"): -2}
    assert cells(per_col, "row", "col", "weight") == {(0, "n0"): round(8 / 3, 6), (1, "n0"): round(4 / 3, 6), (0, "n1"): -1.6, (3, "n1"): -2.4}


def test_one_hot_block_refuses_other_values(spark):
    assert atomize.one_hot_block(spark.createDataFrame([(0, "s", 1, 1.0)], features.LONG)).first()[:] == (0, 1)
    with pytest.raises(Exception, match="other than 1"):
        atomize.one_hot_block(spark.createDataFrame([(0, "s", 1, 2.0)], features.LONG)).collect()


def test_dense_ids_are_in_order(spark):
    ids = atomize.dense_ids(spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "k string"), "k")
    assert {(r["k"], r["nid"]) for r in ids.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_unreachable_types_go(g):
    assert set(g.without_etypes(["is-in"]).nodes) == {"author", "paper"}
    assert g.meta.pruned("author").pruned("author") == g.meta.pruned("author")
    with pytest.raises(ValueError):
        g.without_etypes([c.etype for c in g.edges])


def test_merge_is_idempotent_and_refuses_weights(spark, g):
    e = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    cites, cited = CEType("paper", "cites", "paper"), CEType("paper", "cited", "paper")
    h = HinGraph({"paper": g.nodes["paper"]}, {cites: e, cited: e}, {cites: cited, cited: cites})
    once = h.symmetric()
    assert list(once.edges) == [cites] and once.edges[cites].count() == 2
    w = HinGraph(h.nodes, {cites: e.withColumn("weight", F.lit(1.0)), cited: e}, h.inverse)
    with pytest.raises(ValueError):
        w.merged("cites", "cited")


def test_self_loops_and_identity(g):
    h = g.with_self_loops(["term"])
    loop = h.edge("term-self")
    assert is_identity(loop, g.nodes["term"]).first()[0] and not is_identity(g.edges[WRITES], g.nodes["author"]).first()[0]


def test_homogeneous_ids(g):
    nodes, edges = g.homogeneous(["paper", "author", "term"])
    assert nodes.count() == nodes.select("gid").distinct().count() == 9
    assert {tuple(r) for r in edges.where("etype = 0").select("src", "dst").collect()} == {(4, 0), (4, 1), (5, 1), (6, 3)}


def test_save_and_load(spark, g, tmp_path):
    g.save(f"file://{tmp_path}/g")
    h = HinGraph.load(spark, f"file://{tmp_path}/g")
    assert h.target == "author" and h.inverse == g.inverse
    assert all(evaluate.same_rows(h.edges[c], g.edges[c]) for c in g.edges)


def test_metapath_enumeration(g):
    meta = MetaGraph(("author", "paper"), (WRITES, WRITTEN))
    walks = meta.metapaths(1)
    assert walks == [(self_loop("author"),), (self_loop("paper"),), (self_loop("author"), WRITES), (self_loop("paper"), WRITTEN)]
    assert meta.simple_metapaths("author", 4) == [(WRITES, WRITTEN)]
    assert meta.extensions(1) == [("writes", 0, 2), ("written-by", 1, 3)]
    assert in_prefix_order(walks)[0][0].src == "author"


def test_aliases_round_trip(g):
    a = Aliases(g.meta)
    path = (self_loop("term"), IS_IN, WRITTEN)
    assert a.short(path) == "APT" and a.canonical("APT") == path
    b = Aliases(MetaGraph(("price", "product"), (CEType("price", "x", "product"),)))
    assert b.of == {"price": "Pri", "product": "Pro"} and b.short(b.canonical("ProPri")) == "ProPri"


def test_feature_kinds():
    assert features.Kind.parse("id_emb") == features.Kind("nid", "emb")
    assert features.Kind.parse("u(3,-1,1,0x1f)").args == (3, -1.0, 1.0, 31)
    with pytest.raises(ValueError):
        features.Kind.parse("other")


def test_popular_stops_at_the_first_threshold_that_fits(spark):
    rows = [(i, "s", c, 1.0) for c, n in enumerate([5, 4, 4, 1]) for i in range(n)]
    f = spark.createDataFrame(rows, features.LONG)
    assert features.popular(f, threshold=1).count() == 3
    assert {r["col"] for r in features.popular(f, target=2).collect()} == {0}


def test_concatenated_slots(spark):
    f = spark.createDataFrame([(0, "a", 1, 1.0), (0, "b", 0, 2.0), (1, "b", 2, 3.0)], features.LONG)
    assert cells(features.concatenated(f, ["b", "a"]), "nid", "col", "val") == {(0, 4): 1, (0, 0): 2, (1, 2): 3}
    wide = features.dense(features.concatenated(f, ["b", "a"]).withColumn("slot", F.lit("x")), spark.range(3).withColumnRenamed("id", "nid"), 5)
    assert {r["nid"]: r["feat"] for r in wide.collect()} == {0: [2, 0, 0, 0, 1], 1: [0, 0, 3, 0, 0], 2: [0] * 5}


def test_refinement_propagates_before_edges_go(g):
    from hinspark.plans.selection import Selection, points, refined

    left, feats = refined(g, Selection.of(g, {"term": True, "contains": False}))
    assert set(left.nodes) == {"author", "paper"} and cells(feats["author"], "nid", "col", "val")[0, 0] == 0.75
    assert Selection.of_point(g, {"term": 1}, {"is-in": 1}).excluded == {"is-in", "contains"}
    with pytest.raises(ValueError):
        Selection.of_point(g, {"term": 0}, {})
    assert len(list(points(["a"], ["b"]))) == 2


def test_dense_ids_do_not_depend_on_the_plan(spark):
    keys = spark.range(20_000).selectExpr("sha1(string(id)) as k", "id")
    for name, value in (("spark.sql.exchange.reuse", "false"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
        try:
            got = [r["k"] for r in atomize.dense_ids(keys, "k").orderBy("nid").collect()]
        finally:
            spark.conf.unset(name)
        assert got == sorted(got) and len(got) == 20_000
    assert [r["nid"] for r in atomize.dense_ids(keys, "k").select("nid").orderBy("nid").collect()] == list(range(20_000))


def test_labels_along_longer_closed_paths(spark, g):
    adjs = {c: norm(g, c) for c in g.edges}
    labels = spark.createDataFrame([(0, "label", 0, 1.0), (1, "label", 1, 1.0)], features.LONG)
    path = (WRITES, CONTAINS, IS_IN, WRITTEN)
    dense = {(r["dst"], r["src"]): r["w"] for r in propagate.metapath_adjacency(adjs, path).collect()}
    want = {(d, s): round(w, 6) for (d, s), w in dense.items() if d != s and s in (0, 1)}
    assert cells(propagate.label_features(adjs, path, labels), "nid", "col", "val") == want


def test_z_scores_of_odd_rows(spark):
    from hinspark.functions import vectors

    rows = [([1.0, 2.0, 3.0],), ([5.0, 5.0],), ([7.0],), ([],), (None,)]
    got = [r["z"] for r in spark.createDataFrame(rows, "a array<double>").select(vectors.z_scored(F.col("a")).alias("z")).collect()]
    assert got == [[-1.0, 0.0, 1.0], [0.0, 0.0], [0.0], [], None]
