"""Sampled subgraphs, squared powers and slot attention, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hinspark.graph import HinGraph
from hinspark.operators import layers, linalg, sample
from hinspark.types import CEType

AB, BA, BB = CEType("a", "ab", "b"), CEType("b", "ba", "a"), CEType("b", "bb", "b")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def net(spark):
    draw = random.Random(3)
    edges = {c: sorted({(draw.randrange(20), draw.randrange(20)) for _ in range(60)}) for c in (AB, BA, BB)}
    ids = spark.range(20).select((F.col("id")).alias("nid"))
    return HinGraph({"a": ids, "b": ids}, {c: spark.createDataFrame(e, "src long, dst long") for c, e in edges.items()}), edges


def expanded(edges, seeds, hops):
    """Closure by all in-edges: the nodes after each hop and the last hop's edges."""
    now, last = {"a": set(seeds), "b": set()}, {}
    for _ in range(hops):
        last = {c: {(s, d) for s, d in e if d in now[c.dst]} for c, e in edges.items()}
        for c, e in last.items():
            now[c.src] = now[c.src] | {s for s, _ in e}
    return now, last


@pytest.mark.parametrize("hops", [1, 2])
def test_subgraph_of_all_neighbours(spark, net, hops):
    g, edges = net
    seeds = [2, 3, 19]
    small, begun = sample.subgraph(g, {"a": spark.createDataFrame([(i,) for i in seeds], "nid long")}, [-1] * hops)
    nodes, last = expanded(edges, seeds, hops)
    for t in small.nodes:
        assert rows(small.nodes[t]) == [(k, i) for k, i in enumerate(sorted(nodes[t]))]
    old = {t: dict(rows(small.nodes[t])) for t in small.nodes}
    for c, e in small.edges.items():
        assert {(old[c.src][s], old[c.dst][d]) for s, d in rows(e)} == last[c]
    assert rows(begun["a"]) == sorted((k, i) for k, i in old["a"].items() if i in seeds)


def test_subgraph_has_fanouts_and_keeps_lone_seeds(spark, net):
    g, edges = net
    alone = spark.createDataFrame([(99,), (2,)], "nid long")
    small, begun = sample.subgraph(g, {"a": alone}, [2, {BB: 1, AB: 0, BA: 3}], seed=4)
    assert 99 in {i for _, i in rows(small.nodes["a"])} and begun["a"].count() == 2
    assert AB not in small.edges
    for c, most in ((BB, 1), (BA, 3)):
        assert all(r[0] <= most for r in small.edges[c].groupBy("dst").count().select("count").collect())
    again, _ = sample.subgraph(HinGraph({t: n.repartition(3) for t, n in g.nodes.items()}, {c: e.repartition(5) for c, e in g.edges.items()}), {"a": alone}, [2, {BB: 1, AB: 0, BA: 3}], seed=4)
    assert all(rows(small.edges[c]) == rows(again.edges[c]) for c in small.edges)


def test_powers_are_squares_until_nothing_changes(spark):
    draw = random.Random(4)
    edges = {(draw.randrange(30), draw.randrange(30)) for _ in range(25)}
    nodes = spark.range(30).withColumnRenamed("id", "nid")
    got = [set(rows(p)) for p in linalg.squared_powers(spark.createDataFrame(sorted(edges), "src long, dst long"), nodes, 6)]
    want = [{(a, b) for a, b in edges if a != b} | {(i, i) for i in range(30)}]
    while True:
        squared = {(a, d) for a, b in want[-1] for c, d in want[-1] if b == c}
        if squared == want[-1] or len(want) == 6:
            break
        want.append(squared)
    assert got == want and 1 < len(want)
    assert len(linalg.squared_powers(spark.createDataFrame(sorted(edges), "src long, dst long"), nodes, 1)) == 1


def slot_gat(edges, feats, weight, left, right, slope):
    """Dense loops over zeros too."""
    slots, heads = sorted(weight), len(next(iter(weight.values())))
    out_width = len(weight[slots[0]][0])
    f = lambda n, s, k: [sum(w * x for w, x in zip(row, feats.get((n, s), [0.0] * len(row)))) for row in weight[s][k]]
    end = lambda n, part, k: sum(sum(p * x for p, x in zip(part[s][k], f(n, s, k))) for s in slots)
    out, attention = {}, {}
    for d in {d for _, d, _ in edges}:
        into = [(s, e) for s, x, e in edges if x == d]
        for k in range(heads):
            z = [end(s, left, k) + end(d, right, k) + e for s, e in into]
            z = [math.exp(x if x >= 0 else slope * x) for x in z]
            for (s, _), x in zip(into, z):
                attention[s, d, k] = x / sum(z)
            for slot in slots:
                v = [sum(x / sum(z) * f(s, slot, k)[i] for (s, _), x in zip(into, z)) for i in range(out_width)]
                out.setdefault((d, slot), []).extend(v)
    return out, attention


@pytest.fixture(scope="module")
def slots(spark):
    draw = random.Random(5)
    r = lambda *shape: [r(*shape[1:]) for _ in range(shape[0])] if shape else draw.uniform(-1, 1)
    pairs = sorted({(draw.randrange(8), draw.randrange(8)) for _ in range(30)})
    edges = [(s, d, draw.uniform(-1, 1)) for s, d in pairs]
    feats = {(n, s): r(3) for n in range(8) for s in ("p", "q") if draw.random() < 0.6}
    weight, left, right = ({s: r(2, *shape) for s in ("p", "q")} for shape in ((2, 3), (2,), (2,)))
    e = spark.createDataFrame(edges, "src long, dst long, etype_logit double")
    n = spark.createDataFrame([(*k, v) for k, v in feats.items()], "nid long, slot string, h array<double>")
    return e, n, weight, left, right, slot_gat(edges, feats, weight, left, right, 0.2)


def test_slot_attention_is_shared_and_messages_are_not(slots):
    e, n, weight, left, right, (out, attention) = slots
    got, a = layers.slot_gat_conv(e, n, weight, left, right)
    assert {tuple(r[:3]): r[3] for r in a.collect()} == pytest.approx(attention)
    got = {(r.nid, r.slot): r.h for r in got.collect()}
    assert all(got[k] == pytest.approx(out[k]) for k in got) and all(max(map(abs, v)) < 1e-12 for k, v in out.items() if k not in got)


def test_attention_of_the_layer_before_is_mixed_in(slots, spark):
    e, n, weight, left, right, (_, attention) = slots
    before = spark.createDataFrame([(s, d, k, 0.5) for s, d, k in attention if k == 0], "src long, dst long, head int, a double")
    _, a = layers.slot_gat_conv(e, n, weight, left, right, before=before, alpha=0.25)
    assert {tuple(r[:3]): r[3] for r in a.collect()} == pytest.approx({k: v * 0.75 + 0.125 if k[2] == 0 else v for k, v in attention.items()})


def test_slots_are_merged_in_four_ways(spark):
    table = {(0, "p"): [1.0, -2.0], (0, "q"): [3.0, -4.0], (1, "q"): [-1.0, 5.0]}
    df = spark.createDataFrame([(*k, v) for k, v in table.items()], "nid long, slot string, h array<double>")
    full = {n: [table.get((n, s), [0.0, 0.0]) for s in ("p", "q", "r")] for n in (0, 1)}
    w, b, q = [[0.5, 0.1], [0.0, -0.3]], [0.2, -0.1], [1.0, 0.5]
    score = [sum(sum(y * math.tanh(sum(p * x for p, x in zip(row, full[n][k])) + c) for row, c, y in zip(w, b, q)) for n in full) / 2 for k in range(3)]
    beta = [math.exp(x) / sum(map(math.exp, score)) for x in score]
    want = {
        "mean": lambda v: [sum(x) / 3 for x in zip(*v)],
        "max": lambda v: [max(x) for x in zip(*v)],
        "concat": lambda v: sum(v, []),
        "softmax": lambda v: [sum(y * z for y, z in zip(x, beta)) for x in zip(*v)],
    }
    for how, f in want.items():
        got = {r.nid: r.h for r in layers.slots_merged(df, ["p", "q", "r"], 2, how, w, b, q).collect()}
        assert got == {n: pytest.approx(f(v)) for n, v in full.items()}, how
    with pytest.raises(ValueError):
        layers.slots_merged(df, ["p"], 2, "median")
