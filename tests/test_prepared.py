"""Draws of negatives from dense heads, graph preparation's errors, typed attention and p-values by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinspark.graph import HinGraph
from hinspark.operators import layers, prepare, runs, sample
from hinspark.types import CEType


def test_negatives_of_dense_heads(spark):
    # head 0 has all tails but one, head 1 all, head 2 one, and a tail outside the range
    rows = [(0, d) for d in range(50) if d != 17] + [(1, d) for d in range(50)] + [(2, 3), (2, 77)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    got = sample.unlinked_tails(edges, 50, tries=2).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == sorted(rows)
    assert {r["neg"] for r in got if r["src"] == 0} == {17}
    assert {r["neg"] for r in got if r["src"] == 1} == {None}
    assert all(0 <= r["neg"] < 50 and r["neg"] != 3 for r in got if r["src"] == 2)


def test_places_are_even(spark):
    linked = [d for d in range(40) if d % 4]
    edges = spark.createDataFrame([(0, d) for d in linked], "src long, dst long")
    wanted = spark.range(2000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    got = [r["neg"] for r in sample._placed_tails(edges, wanted, 40, F.lit(0), 1).collect()]
    assert len(got) == 2000 and set(got) == {d for d in range(40) if d % 4 == 0}
    assert min(got.count(d) for d in set(got)) > 130


def test_random_pairs_of_a_dense_graph(spark):
    rows = [(s, d) for s in range(6) for d in range(6) if (s, d) != (2, 5)] + [(0, 0)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    got = sample.random_pairs(edges, 6, 6, tries=2).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == {(2, 5)}
    with pytest.raises(ValueError):
        sample.random_pairs(spark.createDataFrame([(0, 0)], "src long, dst long"), 1, 1)


def _graph(spark):
    ids = lambda n: spark.range(n).withColumnRenamed("id", "nid")
    edge = lambda rows, weight=False: spark.createDataFrame(rows, "src long, dst long" + (", weight double" if weight else ""))
    edges = {CEType("a", "to", "b"): edge([(0, 1), (1, 0)]), CEType("b", "from", "a"): edge([(1, 0, 2.0)], True), CEType("c", "next", "c"): edge([(0, 1)])}
    return HinGraph({"a": ids(2), "b": ids(3), "c": ids(2)}, edges, {}, "a")


def test_preparation(spark):
    g = _graph(spark)
    nodes, edges = prepare.homogeneous_for(g, ["a", "b"], loops="target")
    assert nodes.count() == 5
    assert sorted(tuple(r) for r in edges.select("src", "dst", "weight").collect()) == [(0, 0, 1.0), (0, 3, 1.0), (1, 1, 1.0), (1, 2, 1.0), (3, 0, 2.0)]
    for wrong in (lambda: prepare.without_featureless(g, ["b"]), lambda: prepare.without_featureless(g, ["a", "c"]), lambda: prepare.homogeneous_for(g, weights="refuse"), lambda: prepare.homogeneous_for(g, loops="some")):
        with pytest.raises(ValueError):
            wrong()
    rows = nodes.select(F.col("gid").alias("nid"), "type")
    assert {tuple(r) for r in prepare.target_rows(prepare.without_featureless(g, ["a", "b"]), rows, ["b", "a"]).collect()} == {(0, 1), (1, 1)}


def test_union_of_graphs(spark):
    g = _graph(spark)
    from dataclasses import replace

    more = replace(g, edges={CEType("b", "from", "a"): spark.createDataFrame([(2, 1)], "src long, dst long"), CEType("a", "like", "a"): spark.createDataFrame([(0, 1)], "src long, dst long")})
    u = prepare.united(g, more)
    assert sorted(tuple(r) for r in u.edge("from").collect()) == [(1, 0, 2.0), (2, 1, 1.0)] and u.edge("like").count() == 1


def test_typed_attention_with_two_heads(spark):
    rng = np.random.default_rng(1)
    a, b = CEType("x", "r", "y"), CEType("y", "s", "y")
    x, y = rng.normal(size=(4, 4)), rng.normal(size=(3, 4))
    e = {a: [(0, 0), (1, 0), (2, 1), (3, 1)], b: [(0, 1), (1, 0), (1, 1)]}
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "nid long, h array<double>")
    m = lambda *shape: rng.normal(size=shape)
    q, k, v = m(4, 4), {t: m(4, 4) for t in "xy"}, {t: m(4, 4) for t in "xy"}
    rel, msg, prior, out, skip = {c: m(2, 2, 2) for c in e}, {c: m(2, 2, 2) for c in e}, {c: [1.5, 0.5] for c in e}, m(4, 4), 0.3
    edges = {c: spark.createDataFrame(r, "src long, dst long") for c, r in e.items()}
    plain = lambda d: {n: z.tolist() for n, z in d.items()}
    got = layers.hgt_conv(edges, {"x": frame(x), "y": frame(y)}, "y", q.tolist(), plain(k), plain(v), plain(rel), plain(msg), prior, out.tolist(), skip)
    got = {r["nid"]: r["h"] for r in got.collect()}
    gate = 1 / (1 + math.exp(-skip))
    for n in range(3):
        total = np.zeros(4)
        for h in range(2):
            part = slice(2 * h, 2 * h + 2)
            found = []
            for c, pairs in e.items():
                for s, d in pairs:
                    if d == n:
                        z = (x if c.src == "x" else y)[s]
                        score = (q @ y[n])[part] @ ((k[c.src] @ z)[part] @ rel[c][h]) * prior[c][h] / math.sqrt(2)
                        found.append((score, (v[c.src] @ z)[part] @ msg[c][h]))
            if found:
                w = np.exp([f[0] for f in found])
                total[part] = sum(a_ * f[1] for a_, f in zip(w / w.sum(), found))
        o = out @ total
        o = 0.5 * o * (1 + np.tanh(math.sqrt(2 / math.pi) * (o + 0.044715 * o**3)))
        assert np.allclose(got[n], o * gate + y[n] * (1 - gate))


def test_student_tail(spark):
    # values of the usual table of Student's distribution
    known = [(1.0, 1, 0.25), (2.0, 2, 0.0917517), (2.0, 3, 0.0696630), (2.0, 5, 0.0509697), (2.0, 10, 0.0366940), (-2.0, 10, 0.9633060), (1.812461, 10, 0.05), (2.042272, 30, 0.025)]
    rows = spark.createDataFrame([(t, df, p) for t, df, p in known], "t double, df long, p double")
    for r in rows.withColumn("got", runs.student_tail(F.col("t"), F.col("df"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-7)
