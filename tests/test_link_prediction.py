"""Link tasks, hops from heads, inputs of models, and model parts against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from hinspark import queries_models
from hinspark.graph import HinGraph
from hinspark.operators import evaluate, layers, runs, sample
from hinspark.plans import inputs
from hinspark.plans.linkpred import LinkTask
from hinspark.types import CEType

LIKES, LIKED, KNOWS = CEType("u", "likes", "v"), CEType("v", "liked", "u"), CEType("u", "knows", "u")


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs) or [], "src long, dst long")


def small(spark, likes, knows, n_u=6, n_v=5):
    nodes = {"u": spark.range(n_u).toDF("nid"), "v": spark.range(n_v).toDF("nid"), "alone": spark.range(2).toDF("nid")}
    edges = {LIKES: edges_of(spark, likes), LIKED: edges_of(spark, {(b, a) for a, b in likes}), KNOWS: edges_of(spark, knows)}
    return HinGraph(nodes, edges, {LIKES: LIKED, LIKED: LIKES}, "u")


LIKE = {(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (4, 0), (4, 4)}
KNOW = {(0, 1), (1, 2), (3, 3), (5, 0)}


def walked(graph_edges, head, tail, hops, heads):
    """Pairs (head, node of the tail type) with a walk of at most hops edges from the node to the head."""
    found = set()
    for h in heads:
        level = {(head, h)}
        for left in range(hops, -1, -1):
            found |= {(h, n) for t, n in level if t == tail}
            level = {(c.src, a) for c, pairs in graph_edges.items() for a, b in pairs if (c.dst, b) in level}
    return found


@pytest.mark.parametrize("head,tail", [("u", "v"), ("u", "u"), ("v", "v"), ("u", "alone")])
@pytest.mark.parametrize("hops", [0, 1, 2, 3])
def test_reached_within(spark, head, tail, hops):
    g = small(spark, LIKE, KNOW)
    heads = spark.createDataFrame([(0,), (1,), (3,), (3,)], "nid long")
    got = sample.reached_within(g, heads, head, tail, hops).collect()
    want = walked({LIKES: LIKE, LIKED: {(b, a) for a, b in LIKE}, KNOWS: KNOW}, head, tail, hops, (0, 1, 3))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_draws_follow_the_numbers_of_a_hot_head(spark):
    hot = spark.range(5000).select(F.lit(7).cast("long").alias("src"), F.col("id").alias("dst"))
    few = spark.createDataFrame([(1, 3), (2, 9)], "src long, dst long")
    asked = spark.createDataFrame([(7, 3000), (1, 2), (3, 4)], "src long, n long")
    got = sample.drawn(hot.unionByName(few), asked, 4).collect()
    assert sorted((r.src, r.k) for r in got) == [(1, 1), (1, 2), *((7, k) for k in range(1, 3001))]
    assert {r.dst for r in got if r.src == 1} == {3}
    assert len({r.dst for r in got if r.src == 7}) > 1500
    again = sample.drawn(hot.repartition(7).unionByName(few), asked, 4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


@pytest.fixture
def task(spark):
    train, val, test = {(0, 0), (1, 1), (2, 3), (4, 0)}, {(0, 1), (1, 2)}, {(4, 4)}
    g = small(spark, train, KNOW)
    return LinkTask(g, LIKES, {"train": edges_of(spark, train), "val": edges_of(spark, val), "test": edges_of(spark, test)}, {"test": edges_of(spark, {(4, 2)})})


def test_known_links_grow_with_the_split(task):
    assert {s: task.known(s).edges[LIKES].count() for s in ("train", "val", "test")} == {"train": 4, "val": 6, "test": 7}
    assert {(r.dst, r.src) for r in task.known("test").edges[LIKED].select("src", "dst").collect()} == LIKE


def test_negatives_by_choice(task):
    assert [tuple(r) for r in task.negatives("test", "static").collect()] == [(4, 2)]
    even = task.negatives("train").collect()
    assert sorted(r.src for r in even) == [0, 1, 2, 4] and all(0 <= r.dst < 5 for r in even)
    near = task.negatives("val", "hops", hops=2, k=3).collect()
    # head 0 is reached by v0, v1 (liked), and by nobody's likes else; head 1 by those of 0, who knows it
    assert {r.src for r in near} <= {0, 1} and not {(r.src, r.dst) for r in near} & LIKE
    both = task.sampled({"train": "uniform", "test": "static"}).collect()
    assert sorted(r.split for r in both) == ["test"] + ["train"] * 4
    with pytest.raises(ValueError):
        task.negatives("val", "other")


def test_two_hop_pairs_against_sets(task):
    got = task.two_hop_pairs("val", 3).collect()
    links = {(("u", a), ("v", b)) for a, b in LIKE} | {(("u", a), ("u", b)) for a, b in KNOW}
    links |= {(b, a) for a, b in links}
    two = {(a, d) for a, b in links for c, d in links if b == c}
    free = {h: {d[1] for a, d in two if a == ("u", h) and d[0] == "v" and (a, d) not in links} for h in (0, 1)}
    assert sorted((r.src, r.dst) for r in got if r.y == 1) == [(0, 1), (1, 2)]
    others = [(r.src, r.dst) for r in got if r.y == 0]
    assert sorted(a for a, _ in others) == [h for h in (0, 1) if free[h]]
    assert all(d in free[a] for a, d in others)


def test_link_task_splits_one_edge_type(spark):
    likes = {(a, b) for a in range(40) for b in range(a % 5)}
    t = LinkTask.of(small(spark, likes, KNOW, 40), "likes", 0.5, 2)
    train, val = ({tuple(r) for r in t.positives[s].collect()} for s in ("train", "val"))
    assert train | val == likes and not train & val and val
    assert {a for a, _ in train} == {a for a, _ in likes}
    assert {tuple(r) for r in t.graph.edges[LIKES].collect()} == train == {(r.dst, r.src) for r in t.graph.edges[LIKED].collect()}


def test_link_metrics_is_both_bundles(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 0), (1, 1, 0.3, 0), (1, 2, 0.2, 1), (2, 5, 0.1, 0)], "src long, dst long, score double, y int")
    got = evaluate.link_metrics(rows, ["src"]).first()
    assert got.mrr == pytest.approx(0.75) and got.auc == pytest.approx(4 / 6)


def test_inputs_of_models(spark):
    meta = small(spark, LIKE, KNOW).meta
    assert {len(p) for p in inputs.feature_paths(meta, "u", 2)} == {1, 2, 3}
    back = inputs.label_paths(meta, "u", 2)
    assert {tuple(c.etype for c in p[1:]) for p in back} == {("knows",), ("likes", "liked"), ("knows", "knows")}
    named = inputs.named_paths(meta, "u", ["UV", "UUV"])
    assert list(named) == ["U", "UV", "UUV"] and [c.etype for c in named["UUV"][1:]] == ["liked", "knows"]
    widths = inputs.path_widths(named, {"u": {"a": 2, "b": 3}, "v": {"c": 4}})
    assert widths == {"U": 5, "UV": 4, "UUV": 4} and inputs.unlike(widths) == ["UV", "UUV"] and inputs.unlike(widths, 4) == ["U"]
    with pytest.raises(ValueError):
        inputs.named_paths(meta, "u", ["VU"])


def test_norms_and_mixtures(spark):
    row = spark.createDataFrame([(0, [1.0, 3.0, 5.0, 5.0])], "nid long, h array<double>")
    h = row.select(layers.group_norm(F.col("h"), 2)).first()[0]
    assert h == pytest.approx([-1 / math.sqrt(1 + 1e-5), 1 / math.sqrt(1 + 1e-5), 0, 0])
    hs = F.array(F.col("h"), F.transform("h", lambda x: x * 2), F.transform("h", lambda x: -x))
    mixed = row.select(layers.searched_paths(hs, [0.0, 9.0, math.log(3)], [0, 2])).first()[0]
    assert mixed == pytest.approx([0.25 * x - 0.75 * x for x in (1.0, 3.0, 5.0, 5.0)])


def test_missing_metapaths_are_zeros(spark):
    rows = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "b", [3.0])], "nid long, mp string, h array<double>")
    got = {r.nid: r.hs for r in layers.paths_stacked(rows, {"b": 1, "a": 2}).collect()}
    assert got == {0: [[0.0], [1.0, 2.0]], 1: [[3.0], [0.0, 0.0]]}


@pytest.mark.parametrize("name", sorted(queries_models.ORACLE_SQL))
def test_twin(name, spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, twin = queries_models.QUERIES[name](spark, sf_dir), con.sql(queries_models.ORACLE_SQL[name])
    order = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    want = sorted(repr(tuple(r[twin.columns.index(c)] for c in order)) for r in twin.fetchall())
    assert order == sorted(twin.columns) and got == want


def test_folds_hold_each_link_out_once(task):
    folds = task.folds(3, 1)
    placed = {(r.src, r.dst): r.fold for r in folds.collect()}
    assert len(placed) == 6 and sorted(placed.values()) == [0, 0, 1, 1, 2, 2]
    held = task.held(folds, 2)
    train = {p for p, f in placed.items() if f != 2}
    assert {tuple(r) for r in held.positives["train"].collect()} == train
    assert {(r.dst, r.src) for r in held.graph.edges[LIKED].select("src", "dst").collect()} == train
    assert {tuple(r) for r in held.positives["val"].collect()} == set(placed) - train
    assert [tuple(r) for r in held.positives["test"].collect()] == [(4, 4)]


def test_thresholds_by_another_objective(spark):
    rows = [(i, 0, float(i - 5), int(i in (3, 6, 7, 9))) for i in range(10)]
    scored = spark.createDataFrame(rows, "nid long, cls int, logit double, y int")
    precise = evaluate.best_thresholds(scored, lambda tp, fp, fn: tp - 10 * fp).first()
    assert precise.f1 == 1 and 1 / (1 + math.exp(-3)) < precise.threshold < 1 / (1 + math.exp(-4))
    assert evaluate.best_thresholds(scored.limit(0)).count() == 0


def test_searched_f1_keeps_half_for_classes_it_never_saw(spark):
    rows = [(0, 0, -2.0, 1, "train"), (1, 0, -3.0, 0, "train"), (2, 0, -2.1, 1, "val"), (3, 1, 1.0, 1, "val"), (4, 1, -1.0, 0, "val"), (5, 0, 9.0, 1, None)]
    got = {r.split: r for r in evaluate.searched_f1(spark.createDataFrame(rows, "nid long, cls int, logit double, y int, split string")).collect()}
    assert set(got) == {"train", "val"} and got["val"].micro_f1 == got["val"].macro_f1 == 1.0


def test_running_sums_over_ranges(spark):
    rows = spark.range(500).select(((F.col("id") * 37) % 501).alias("at"), F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    seen_a = seen_b = 0
    for r in sorted(evaluate.with_running_sums(rows, "at", {"a": "before_a", "b": "before_b"}).collect(), key=lambda r: r["at"]):
        assert (r.before_a, r.before_b) == (seen_a, seen_b)
        seen_a, seen_b = seen_a + r.a, seen_b + r.b


def test_missed_checkpoints(spark):
    history = spark.createDataFrame([("x", 1, 9.0), ("x", 2, 5.0), ("x", 3, 4.0), ("y", 2, 1.0), ("y", 3, 1.0)], "run string, epoch long, value double")
    asked = spark.createDataFrame([(2, 4.0), (3, 4.0)], "epoch long, bound double")
    assert [tuple(r) for r in runs.missed_checkpoints(history, asked, ["run"]).collect()] == [("x", 2)]
    assert sorted(tuple(r) for r in runs.missed_checkpoints(history, asked, ["run"], minimise=False).collect()) == [("y", 2)]
