"""Sequence attention, polynomials of metapaths and self-training, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hinspark.functions import vectors
from hinspark.graph import HinGraph
from hinspark.operators import layers, linalg, prepare, propagate, sequences
from hinspark.plans import stages
from hinspark.types import CEType, coded, expansions, transposed


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def leaky(x, slope=0.01):
    return x if x >= 0 else slope * x


def mv(m, v):
    return [sum(a * b for a, b in zip(r, v)) for r in m]


def attend(items, p, beta, temper):
    """Every place of a sequence after one layer."""
    left, right, al, ar, source, target, out, gain, bias = p
    heads, width = len(al), len(left) // len(al)
    cut = lambda v, k: v[k * width : (k + 1) * width]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    made = []
    for h, r in items:
        mix = []
        for k in range(heads):
            z = [(dot(al[k], map(leaky, cut(mv(left, h), k))) + dot(ar[k], map(leaky, cut(mv(right, g), k))) + beta * dot(mv(source[k], r), mv(target[k], q))) / temper for g, q in items]
            e = [math.exp(x - max(z)) for x in z]
            mix += [sum(x * cut(mv(right, g), k)[i] for x, (g, _) in zip(e, items)) / sum(e) for i in range(width)]
        v = [a + b for a, b in zip(h, mv(out, mix))]
        m = sum(v) / len(v)
        d = math.sqrt(sum((x - m) ** 2 for x in v) / len(v) + 1e-5)
        made.append(([(x - m) / d * g + b for x, g, b in zip(v, gain, bias)], r))
    return made


def test_sequence_attention_in_two_layers(spark):
    draw = random.Random(2)
    r = lambda *shape: [r(*shape[1:]) for _ in range(shape[0])] if shape else draw.uniform(-1, 1)
    h, rel = {i: r(4) for i in range(9)}, {i: r(3) for i in range(9)}
    seqs = {i: [i, *draw.sample([j for j in range(9) if j != i], draw.randrange(4))] for i in range(9)}
    padded = [(i, s + [None] * (4 - len(s))) for i, s in seqs.items()]
    p = (r(4, 4), r(4, 4), r(2, 2), r(2, 2), r(2, 3, 3), r(2, 3, 3), r(4, 4), r(4), r(4))
    df = sequences.gathered(spark.createDataFrame(padded, "nid long, seq array<long>"), spark.createDataFrame(list(h.items()), "nid long, h array<double>"), spark.createDataFrame(list(rel.items()), "nid long, h array<double>"))
    assert df.agg(F.max(F.size("items"))).first()[0] <= 4
    for _ in range(2):
        df = sequences.sequence_attention(df, *p, beta=0.7, temper=1.5)
    got = {x.nid: x.h for x in sequences.first_places(df).collect()}
    for i, s in seqs.items():
        items = [(h[j], rel[j]) for j in s]
        for _ in range(2):
            items = attend(items, p, 0.7, 1.5)
        assert got[i] == pytest.approx(items[0][0], abs=1e-9)


def test_values_that_a_formula_names_twice_are_made_once(spark):
    """A score's largest, a sum or a whole context used to be made again for each element, and what is random shows it."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i + F.rand(5))
    one = spark.range(20).select(vectors.matvec([[1.0, 0, 0, 2.0]] * 3, drawn).alias("m"), vectors.l2_normalized(drawn).alias("n"), layers.group_norm(drawn, 1, 0.0).alias("g"), sequences._layer_norm(drawn, [1.0] * 4, [0.0] * 4, 0.0).alias("s"))
    for r in one.collect():
        assert len(set(r.m)) == 1 and sum(x * x for x in r.n) == pytest.approx(1)
        for v in (r.g, r.s):
            assert sum(v) == pytest.approx(0, abs=1e-9) and sum(x * x for x in v) == pytest.approx(4)
    items = spark.createDataFrame([(1, [([1.0, 2.0], [1.0]), ([0.5, 0.0], [2.0])])], "nid long, items array<struct<h:array<double>,r:array<double>>>")
    m = [[0.5, 0.0], [0.0, 0.25]]
    plan = sequences.sequence_attention(items, m, m, [[0.3, -0.2]], [[0.1, 0.4]], [[[1.0]]], [[[0.2]]], m, [1.0, 2.0], [0.0, 0.1])._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("exp(") == 1


def test_degree_conv_and_relation_encoding(spark):
    edges, h = [(0, 1), (0, 2), (1, 2), (2, 2), (0, 1)], {0: [1.0, -2.0], 1: [0.5, 3.0], 2: [-1.0, 1.0], 3: [4.0, 4.0]}
    w, b, scale = [[0.5, 1.0], [-1.0, 0.25], [2.0, 0.0]], [0.1, -0.2, 0.3], {0: 2.0, 1: -0.5}
    e = spark.createDataFrame(edges, "src long, dst long")
    out = lambda n: max(1, sum(s == n for s, _ in edges))
    into = lambda n: max(1, sum(d == n for _, d in edges))
    got = {x.nid: x.h for x in sequences.degree_conv(e, spark.createDataFrame(list(h.items()), "nid long, h array<double>"), w, b).collect()}
    for n in h:
        v = [sum(mv(w, h[s])[i] / math.sqrt(out(s)) for s, d in edges if d == n) / math.sqrt(into(n)) + b[i] for i in range(3)]
        assert got[n] == pytest.approx([max(0.0, x) for x in v])
    typed = spark.createDataFrame([(n, n % 2, v) for n, v in h.items()], "nid long, type int, h array<double>")
    got = {x.nid: x.h for x in sequences.degree_conv(e, typed, scale=scale, relu=False).collect()}
    for n in h:
        assert got[n] == pytest.approx([sum(h[s][i] * scale[s % 2] / math.sqrt(out(s)) for s, d in edges if d == n) / math.sqrt(into(n)) for i in range(2)])


# ---- polynomials

AB, BA, BC, CB = CEType("a", "ab", "b"), CEType("b", "ba", "a"), CEType("b", "bc", "c"), CEType("c", "cb", "b")


def test_expansions_and_their_transposes():
    inverse = {AB: BA, BA: AB, BC: CB, CB: BC}
    found = expansions([AB, BA, BC, CB], 3)
    brute = [(x,) for x in inverse]
    for _ in range(2):
        brute += [(*p, c) for p in brute for c in inverse if p[-1].dst == c.src and (*p, c) not in brute]
    assert sorted(found) == sorted(set(brute)) and [len(p) for p in found] == sorted(len(p) for p in found)
    codes = {AB: "AB", BA: "BA", BC: "BC", CB: "CB"}
    assert coded(transposed((AB, BC), inverse), codes) == "CBBA" and all(transposed(transposed(p, inverse), inverse) == p for p in found)


def test_polynomial_equals_explicit_products(spark, monkeypatch):
    draw = random.Random(6)
    size = {"a": 4, "b": 5, "c": 3}
    dense = {c: [[draw.choice([0.0, 0.0, 1.0, draw.uniform(-1, 1)]) for _ in range(size[c.src])] for _ in range(size[c.dst])] for c in (AB, BA, BC, CB)}
    adjs = {c: spark.createDataFrame([(i, j, w) for i, r in enumerate(m) for j, w in enumerate(r) if w], "dst long, src long, w double") for c, m in dense.items()}
    x = {"a": [draw.uniform(-1, 1) for _ in range(4)], "b": [draw.uniform(-1, 1) for _ in range(5)]}
    feats = {n: spark.createDataFrame([(i, "s", 0, v) for i, v in enumerate(vs)], "nid long, slot string, col int, val double") for n, vs in x.items()}
    paths = [p for p in expansions([AB, BA, BC, CB], 3) if p[0].src in x]
    coefficients = {p: draw.uniform(-1, 1) for p in paths}
    calls = []
    real = linalg.apply
    monkeypatch.setattr(linalg, "apply", lambda a, f: calls.append(1) or real(a, f))
    there = propagate.polynomial_along(adjs, feats, coefficients)
    assert len(calls) == len({p[:k] for p in paths for k in range(1, len(p) + 1)})  # an edge of the prefix tree each
    del calls[:]
    back = propagate.polynomial_back(adjs, there, coefficients)
    assert len(calls) == len({p[:k] for p in paths for k in range(1, len(p) + 1)})
    want = {n: [0.0] * k for n, k in size.items()}
    for p, w in coefficients.items():
        v = x[p[0].src]
        for c in p:
            v = mv(dense[c], v)
        want[p[-1].dst] = [a + w * b for a, b in zip(want[p[-1].dst], v)]
    wrong = lambda df, v: max(abs(r.val - v[r.nid]) for r in df.collect())
    assert set(there) == {"a", "b", "c"} and all(wrong(df, want[n]) < 1e-9 for n, df in there.items())
    again = {n: [0.0] * k for n, k in size.items()}
    for p, w in coefficients.items():
        v = want[p[-1].dst]
        for c in reversed(p):
            v = mv(list(zip(*dense[c])), v)
        again[p[0].src] = [a + w * b for a, b in zip(again[p[0].src], v)]
    assert all(wrong(df, again[n]) < 1e-9 for n, df in back.items())


def test_types_without_features_keep_their_place(spark):
    ids = lambda n: spark.range(n).withColumnRenamed("id", "nid")
    aa = CEType("a", "aa", "a")
    e = lambda x: spark.createDataFrame(x, "src long, dst long")
    g = HinGraph({"b": ids(2), "a": ids(3)}, {AB: e([(0, 1), (2, 1)]), aa: e([(0, 1), (0, 1), (1, 1), (2, 0)])})
    feats = {"a": spark.createDataFrame([(0, "a", 0, 1.0), (2, "a", 4, 2.0)], "nid long, slot string, col int, val double")}
    x, widths, adjs = prepare.polynomial_inputs(g, feats, binary=["aa"])
    assert widths == {"b": 1, "a": 5} and rows(x) == [(2, "a", 0, 1.0), (4, "a", 4, 2.0)]
    assert rows(adjs[AB]) == [(1, 2, 0.5), (1, 4, 0.5)]
    assert rows(adjs[aa]) == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 0.5), (2, 4, 0.5), (3, 2, 0.5), (3, 3, 0.5), (4, 4, 1.0)]
    with pytest.raises(ValueError):
        prepare.polynomial_inputs(g, {})


# ---- stages


@pytest.mark.parametrize("n_true,n_pseudo,share", [(10, 3, 0.25), (3, 10, 0.5), (5, 0, 0.5), (0, 4, 0.5), (0, 0, 0.5), (7, 7, 0.0)])
def test_batches_are_mixed_in_proportion(spark, n_true, n_pseudo, share):
    table = lambda n, at: spark.createDataFrame([(at + i, i % 2, 1.0) for i in range(n)], "nid long, label long, p double")
    got = stages.mixed(table(n_true, 0), table(n_pseudo, 100), 4, share, seed=1).collect()
    wanted = {k for k, n in (("true", n_true), ("pseudo", n_pseudo)) if n and (k == "true" or share or not n_true)}
    assert {r.kind for r in got} == wanted
    for kind in wanted:
        ids = [r.nid for r in got if r.kind == kind]
        assert set(ids) == set(range(n_true) if kind == "true" else range(100, 100 + n_pseudo))
    batches = [[r for r in got if r.batch == b] for b in range(max((r.batch for r in got), default=-1) + 1)]
    if len(wanted) == 2:
        assert all(sum(r.kind == "pseudo" for r in b) == round(4 * share) for b in batches[:-1])


def test_best_stage_is_kept_and_others_are_deleted(spark):
    nodes = spark.createDataFrame([(i, i % 2, "train" if i < 4 else "val" if i < 8 else "test") for i in range(12)], "nid long, label long, split string")
    seen, tables = [], []

    def learn(number, examples):
        tables.append(examples.inputFiles()[0])
        seen.append({(r.nid, r.label, r.kind) for r in examples.collect()})
        right = F.when((F.col("label") == F.col("cls")) | ((F.col("nid") == 5) & F.lit(number != 1)), 3.0).otherwise(F.when(F.col("nid") > 9, 2.9).otherwise(0.0))
        return nodes.withColumn("cls", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))).select("nid", "cls", right.alias("logit"))

    best = stages.self_training(nodes, learn, 3, 0.9, batch=4, share=0.5)
    assert best.number == 1 and best.score == 1.0 and best.examples.count() > 0
    assert seen[0] == {(i, i % 2, "true") for i in range(4)}
    assert {x for x in seen[1] if x[2] == "pseudo"} == {(i, i % 2, "pseudo") for i in (4, 6, 7, 8, 9)}  # the others are unsure
    assert {x for x in seen[2] if x[2] == "pseudo"} == {(i, i % 2, "pseudo") for i in (4, 5, 6, 7, 8, 9)}
    import os

    assert [os.path.exists(t.removeprefix("file://")) for t in tables] == [False, True, True]
