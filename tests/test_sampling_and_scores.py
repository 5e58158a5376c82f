import math

import pytest
from pyspark.sql import functions as F

from hinspark.functions import vectors
from hinspark.operators import evaluate, layers, linalg, runs, sample
from hinspark.types import CEType


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def ring(spark):
    return spark.range(40).select(F.col("id").alias("src"), F.explode(F.array(*(F.pmod(F.col("id") * k + k, F.lit(40)) for k in (1, 3, 7)))).alias("dst"))


def test_split_first_lines(spark):
    lines = spark.range(11).withColumnRenamed("id", "line_no")
    assert [r["line_no"] for r in sample.split_first_lines(lines).where("split = 'val'").orderBy("line_no").collect()] == [0, 1]


def test_split_is_the_same_in_any_partitioning(ring):
    assert rows(sample.split_links(ring.distinct(), 0.5, 3)) == rows(sample.split_links(ring.distinct().repartition(7), 0.5, 3))


def test_first_tail_is_always_train(ring):
    split = sample.split_links(ring.distinct(), 0.0)
    assert split.where("split = 'train'").count() == ring.select("src").distinct().count()


def test_negatives_are_no_links(ring):
    links = {tuple(r) for r in ring.collect()}
    got = sample.unlinked_tails(ring.distinct(), 40, tries=20).collect()
    assert len(got) == len(links) and all((r["src"], r["neg"]) not in links for r in got)
    assert all((r["src"], r["dst"]) not in links for r in sample.random_pairs(ring, 40, 40).collect())


def test_two_hop_candidates(ring):
    links = {tuple(r) for r in ring.collect()}
    both = links | {(b, a) for a, b in links}
    want = {(a, d) for a, b in both for c, d in both if b == c and a != d and (a, d) not in both}
    assert {tuple(r) for r in sample.two_hop_candidates(ring, ring).collect()} == want


def test_draws_come_from_the_candidates(spark):
    c = spark.createDataFrame([(0, 5), (0, 6), (1, 7)], "src long, dst long")
    n = spark.createDataFrame([(0, 50), (1, 2), (2, 3)], "src long, n long")
    got = rows(sample.drawn(c, n))
    assert len(got) == 52 and {d for s, _, d in got if s == 0} == {5, 6} and {d for s, _, d in got if s == 1} == {7}


def test_folds_are_even(spark):
    f = sample.k_folds(spark.range(103).withColumn("y", F.col("id") % 2), 5, F.col("y"), "id")
    assert max(r["count"] for r in f.groupBy("y", "fold").count().collect()) - min(r["count"] for r in f.groupBy("y", "fold").count().collect()) <= 1


def test_fanouts(ring, spark):
    seeds = spark.createDataFrame([(0,), (1,)], "nid long")
    assert sample.neighbours(ring.distinct(), seeds, 0).count() == 0
    full = sample.neighbours(ring.distinct(), seeds, -1)
    assert full.count() == ring.distinct().where("dst in (0, 1)").count()
    assert max(r["count"] for r in sample.neighbours(ring.distinct(), seeds, 1).groupBy("dst").count().collect()) == 1


def test_sequences_start_with_the_target(ring, spark):
    seq = sample.node_sequences(ring.distinct(), spark.createDataFrame([(0,), (5,)], "nid long"), 6, 2).collect()
    assert all(r["seq"][0] == r["nid"] and len(r["seq"]) == 6 and len(set(r["seq"])) == 6 for r in seq)


def test_blocks_stay_together(spark):
    b = sample.block_shuffled(spark.range(64).withColumnRenamed("id", "k"), "k", 8, 16)
    got = {r["k"]: r["batch"] for r in b.collect()}
    assert all(got[k] == got[k - k % 8] for k in got) and sorted(got.values()) == sorted([i // 16 for i in range(64)])


def test_ranking(spark):
    s = spark.createDataFrame([(0, 1, 0.9, 0), (0, 2, 0.8, 1), (0, 3, 0.7, 0), (0, 4, 0.6, 1), (1, 1, 0.5, 0)], "src long, dst long, score double, y int")
    m = evaluate.ranking(s, ["src"]).first()
    assert [round(x, 6) for x in m] == [0.5, 0.375, 0.5, 0.650921]
    assert evaluate.roc_auc(s.where("src = 0")).first()[0] == 0.25


def test_auc_with_ties_against_all_pairs(spark):
    data = [(i * 7 % 5 / 2.0, int(i % 3 == 0)) for i in range(60)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert evaluate.roc_auc(spark.createDataFrame(data, "score double, y int")).first()[0] == pytest.approx(want)


def test_best_thresholds_against_a_scan(spark):
    data = [(i, c, ((i * 37 + c * 11) % 23 - 11) / 4.0, int((i + c) % 3 == 0)) for i in range(40) for c in range(3)]
    got = {r["cls"]: (r["threshold"], r["f1"]) for r in evaluate.best_thresholds(spark.createDataFrame(data, "nid long, cls long, logit double, y int")).collect()}
    for c in range(3):
        def f1(t):
            tp = sum(y for _, k, x, y in data if k == c and 1 / (1 + math.exp(-x)) > t)
            fp = sum(1 - y for _, k, x, y in data if k == c and 1 / (1 + math.exp(-x)) > t)
            fn = sum(y for _, k, x, y in data if k == c) - tp
            return 2 * tp / (2 * tp + fp + fn) if tp else 0
        best = max(f1(p - 1e-9) for p in {1 / (1 + math.exp(-x)) for _, k, x, _ in data if k == c})
        assert got[c][1] == pytest.approx(best) and f1(got[c][0]) == pytest.approx(best)


def test_softmax_sums_to_one(spark):
    r = spark.createDataFrame([(0, 1000.0), (0, 999.0), (1, -5.0)], "g long, x double")
    for normalize in (False, True):
        s = evaluate.softmax(r, ["g"], "x", "p", normalize)
        assert all(x["s"] == pytest.approx(1) for x in s.groupBy("g").agg(F.sum("p").alias("s")).collect())


def test_homophily(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "nid long, label int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 2)], "dst long, src long")
    assert evaluate.node_homophily(pairs, labels).first()[0] == 0.75
    assert evaluate.edge_homophily(pairs, labels).first()[0] == pytest.approx(2 / 3)
    multi = spark.createDataFrame([(0, [1, 0]), (1, [1, 1])], "nid long, label array<int>")
    assert evaluate.multi_label_edge_homophily(pairs.where("dst < 2 and src < 2"), multi).first()[0] == 0.5


def test_early_stopping_and_best(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([3.0, 2.0, 2.0, 4.0, 1.0])], "run string, epoch long, value double")
    got = runs.early_stopping(h, ["run"], 2).orderBy("epoch").collect()
    assert [r["waited"] for r in got] == [0, 0, 1, 2, 0] and [r["stop"] for r in got] == [False, False, False, True, False]
    tagged = h.withColumn("tag", F.lit("loss"))
    assert runs.best_scalars(tagged.where("epoch < 4"), ["run"], "loss").first()["epoch"] == 1


def test_csv_runs(spark, tmp_path):
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "x.csv").write_text("f1\n0.5\n0.7\n")
    (tmp_path / "runs" / "a" / "_y.csv").write_text("f1\n9\n")
    got = runs.read_csvs(spark, f"{tmp_path}/runs", "f1 double")
    assert rows(runs.mean_std(got, ["profile"], "f1").select("profile", "n", F.round("mean", 6))) == [("a/x", 2, 0.6)]


def test_t_statistic(spark):
    m = spark.createDataFrame([("a", 1.0, 0.1, 5), ("b", 0.9, 0.2, 5)], "profile string, mean double, std double, n long")
    t = runs.t_statistic(m, "a").first()
    assert t["t"] == pytest.approx(0.1 / math.sqrt((0.01 + 0.04) / 2 * 0.4)) and t["df"] == 8


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0],)], "a array<double>").select(
        vectors.l2_normalized(F.col("a")), vectors.dot(F.col("a"), F.col("a")), vectors.matvec([[1.0, 1.0]], F.col("a")), vectors.argmax(F.col("a")), vectors.one_hot(F.lit(1), 3), vectors.bilinear(F.col("a"), [[0.0, 1.0], [0.0, 0.0]], F.col("a"))
    ).first()
    assert r[0] == [0.6, 0.8] and r[1] == 25 and r[2] == [7] and r[3] == 1 and r[4] == [0, 1, 0] and r[5] == 12


def test_attention_layers(spark):
    n = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])], "nid long, h array<double>")
    e = spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "src long, dst long")
    got = {r["nid"]: r["h"] for r in layers.gat_conv(e, n, [0.0, 0.0], [1.0, 1.0]).collect()}
    assert got[2] == [0.5, 0.5] and got[0] == [2, 2]
    a = layers.linear_attention(n, n, n).collect()
    q, k = {r["nid"]: r["h"] for r in n.collect()}, [r["h"] for r in n.collect()]
    for r in a:
        w = [sum(x * y for x, y in zip(q[r["nid"]], v)) for v in k]
        assert r["h"] == pytest.approx([sum(wi * v[j] for wi, v in zip(w, k)) / sum(w) for j in range(2)])


def test_relation_weights():
    a, b, c = CEType("x", "a", "z"), CEType("y", "b", "z"), CEType("z", "c", "x")
    w = layers.relation_weights({a: 0.0, b: 0.0, c: 9.0})
    assert w == {a: 0.5, b: 0.5, c: 1.0}


def test_metapath_weights(spark):
    ext = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "etype string, mp long, to long")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.2)], "etype string, w double")
    start = spark.createDataFrame([(0, 1.0)], "mp long, weight double")
    assert rows(layers.metapath_weights(ext, [w, w], start)) == [(0, 1.0), (1, 0.5), (2, 0.1)]


def test_nhop(ring):
    links = {tuple(r) for r in ring.collect()}
    assert {tuple(r) for r in linalg.within_hops(ring, 2).collect()} == {(a, d) for a, b in links for c, d in links if b == c and a != d}


def test_running_sum_over_sampled_ranges(spark):
    """More rows than the range sampler reads whole, with a column that one pass doesn't need."""
    conf = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        scores = spark.range(0, 20_000, numPartitions=7).select((F.col("id") * 7919 % 20_000).alias("s"), F.lit(1).alias("n"), F.col("id").cast("string").alias("more"))
        got = evaluate.with_running_sum(scores, "s", "n", "below").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(got) == 20_000 and all(r["below"] == r["s"] for r in got)
