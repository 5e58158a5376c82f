"""Queries on link prediction, the inputs of models and whole models, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.vectors import dot
from .operators import evaluate, features, layers, linalg, propagate, runs
from .plans import inputs
from .plans.linkpred import LinkTask
from .queries import _BRANDS, _BUYS, _CONTAINS, _CUSTOMERS, _IN_ORDER, _NATION_LOOP, _PLACED_BY, _RING, _VEC, _customer_vectors, _ring, _typed, buys, rounded
from .scratch import written
from .sources.relational import commerce, table
from .types import Aliases, CEType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- link prediction

_U = lambda key: f"('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"

_BASKETS = f"""{_BUYS}, lines AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
    links AS (SELECT src, dst, CASE WHEN dst = min(dst) OVER (PARTITION BY src) OR {_U("src || '-' || dst || '-7'")} < 0.9 THEN 'train' ELSE 'val' END AS split FROM lines),
    heads AS (SELECT src, count(*) AS n FROM links WHERE split = 'val' GROUP BY 1),
    near AS (SELECT heads.src, buys.dst FROM heads JOIN orders ON o_orderkey = heads.src JOIN buys ON buys.src = o_custkey EXCEPT SELECT src, dst FROM lines)"""


def _drawn_sql(seed: int) -> str:
    """Draws of as many near tails as a head has links, numbered by hash."""
    return f"""numbered AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(src || '-' || dst || '-{seed}'), dst) - 1 AS i, count(*) OVER (PARTITION BY src) AS size FROM near),
    asked AS (SELECT src, unnest(range(1, n + 1)) AS k FROM heads),
    others AS (SELECT a.src, m.dst FROM asked a JOIN numbered m ON m.src = a.src AND m.i = floor({_U(f"a.src || '-' || k || '-{seed + 1}'")} * m.size)::BIGINT)"""


def baskets(spark: SparkSession, sf_dir: str) -> LinkTask:
    """Which parts an order has, from what the customer buys; some lines are held out."""
    g = commerce(spark, sf_dir)
    known = ("places", "placed-by", "contains", "in-order")
    buy, sold = CEType("customer", "buys", "part"), CEType("part", "bought-by", "customer")
    edges = g.edges.only(g.meta.canonical(e) for e in known) | {buy: lambda: buys(spark, sf_dir), sold: lambda: buys(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    inverse = {a: b for a, b in g.inverse.items() if a.etype in known} | {buy: sold, sold: buy}
    return LinkTask.of(replace(g, nodes=g.nodes.only(("customer", "order", "part")), edges=edges, inverse=inverse), "contains", 0.9, 7)


@query(
    f"WITH {_BASKETS}, {_drawn_sql(1)} SELECT src, dst, 1::INT AS y FROM links WHERE split = 'val' UNION ALL SELECT src, dst, 0 FROM others"
)
def two_hop_test_pairs(spark, sf_dir):
    """The held-out lines of all orders and as many parts that the order's customer bought at other times."""
    return baskets(spark, sf_dir).two_hop_pairs("val", 1)


@query(
    f"""WITH {_BASKETS}, {_drawn_sql(5)}, n AS (SELECT max(p_partkey) + 1 AS n FROM part)
    SELECT split, src, floor({_U("src || '-' || dst || '-5'")} * n)::BIGINT AS dst FROM links, n WHERE split = 'train' UNION ALL SELECT 'val', src, dst FROM others"""
)
def negatives_by_split(spark, sf_dir):
    """Even draws for the training lines; for the held-out ones draws within two hops."""
    return baskets(spark, sf_dir).sampled({"train": "uniform", "val": "hops"}, seed=5)


@query(
    f"""WITH {_BASKETS}, {_drawn_sql(1)}, pairs AS (SELECT src, dst, 1 AS y FROM links WHERE split = 'val' UNION ALL SELECT src, dst, 0 FROM others),
    s AS (SELECT src, dst, y, round(o_totalprice / 100000 * (p_retailprice / 1000) + p_size / 50 - 0.5 + 1e-9, 6) AS score FROM pairs JOIN orders ON o_orderkey = src JOIN part ON p_partkey = dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst, y DESC) AS r FROM s), h AS (SELECT src, sum(y) AS n, min(CASE WHEN y = 1 THEN r END) AS first, sum(y / r) AS rr, sum(y / log2(r + 1)) AS dcg FROM r GROUP BY 1),
    m AS (SELECT avg(1 / first) AS mrr, avg(rr / n) AS amrr, avg(rr / list_sum([1 / i FOR i IN range(1, n::BIGINT + 1)])) AS nmrr, avg(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, n::BIGINT + 1)])) AS ndcg FROM h),
    t AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s),
    a AS (SELECT (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM t)
    SELECT round(mrr + 1e-9, 6) AS mrr, round(amrr + 1e-9, 6) AS amrr, round(nmrr + 1e-9, 6) AS nmrr, round(ndcg + 1e-9, 6) AS ndcg, round(auc + 1e-9, 6) AS auc FROM m, a"""
)
def link_metrics(spark, sf_dir):
    """Held-out lines scored by the dot product of both ends' vectors, against parts two hops away."""
    pairs = written(baskets(spark, sf_dir).two_hop_pairs("val", 1), "pairs")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nid"), F.array(F.col("o_totalprice") / 100000, F.lit(1.0)).alias("h"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.array(F.col("p_retailprice") / 1000, F.col("p_size") / 50 - 0.5).alias("h"))
    scored = layers.pair_scores(pairs, orders, parts, lambda a, b: rounded(dot(a, b)))
    return evaluate.link_metrics(scored, ["src"]).select(*(rounded(c).alias(c) for c in ("mrr", "amrr", "nmrr", "ndcg", "auc")))


@query(
    f"""WITH {_BASKETS}, f AS (SELECT src, dst, (row_number() OVER (ORDER BY md5('{{' || src || ', ' || dst || '}}-3'), src, dst) - 1) % 4 AS fold FROM links),
    t AS (SELECT src, dst, CASE WHEN fold = 1 THEN 'val' ELSE 'train' END AS split FROM f) SELECT split, src, count(*) AS links, sum(dst)::BIGINT AS parts FROM t GROUP BY 1, 2"""
)
def link_kfold(spark, sf_dir):
    """All lines in four even folds; one is held out, and the network's edges and their inverse follow."""
    task = baskets(spark, sf_dir)
    task = task.held(task.folds(4, 3), 1)
    inverse = task.graph.edges[task.graph.inverse[task.target]]
    parts = [inverse.select(F.lit("train").alias("split"), F.col("dst").alias("src"), F.col("src").alias("dst")), task.positives["val"].select(F.lit("val").alias("split"), "src", "dst")]
    return parts[0].unionByName(parts[1]).groupBy("split", "src").agg(F.count("*").alias("links"), F.sum("dst").alias("parts"))


# ---- thresholds and checkpoints

_MANY = f"""{_CUSTOMERS}, g AS (SELECT nid, cls, split, ((nid * 37 + cls * 11) % 101) / 25.0 - 2 AS logit, CASE WHEN (nid * 37 + cls * 11) % 101 + (nid % 40) > 60 THEN 1 ELSE 0 END AS y FROM customers, range(0, 3) AS r(cls)),
    per AS (SELECT cls, logit, sum(y) AS pos, count(*) AS n FROM g WHERE split = 'train' GROUP BY 1, 2), run AS (SELECT cls, logit, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY cls) AS total FROM per WINDOW w AS (PARTITION BY cls ORDER BY logit DESC)),
    best AS (SELECT cls, arg_max(logit, row(2.0 * tp / (k + total), -logit)) AS lowest FROM run GROUP BY 1)"""


@query(
    f"""WITH {_MANY}, c AS (SELECT split, cls, count(*) FILTER (logit >= lowest AND y = 1) AS tp, count(*) FILTER (logit >= lowest AND y = 0) AS fp, count(*) FILTER (logit < lowest AND y = 1) AS fn FROM g JOIN best USING (cls) WHERE split IS NOT NULL GROUP BY 1, 2)
    SELECT split, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) + 1e-9, 6) AS micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)) + 1e-9, 6) AS macro_f1 FROM c GROUP BY 1"""
)
def threshold_search(spark, sf_dir):
    """Thresholds of three classes searched on the training customers and used on every split."""
    n = commerce(spark, sf_dir).nodes["customer"].select("nid", "split", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cls"))
    cell = F.pmod(F.col("nid") * 37 + F.col("cls") * 11, F.lit(101))
    scored = n.withColumns({"logit": cell / 25.0 - 2, "y": (cell + F.pmod(F.col("nid"), F.lit(40)) > 60).cast("int")})
    return evaluate.searched_f1(scored).select("split", rounded("micro_f1").alias("micro_f1"), rounded("macro_f1").alias("macro_f1"))


@query(
    """WITH h AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, o_totalprice AS value FROM orders), c AS (SELECT * FROM (VALUES (2, 150000.0), (5, 200000.0)) AS t(epoch, bound))
    SELECT run, min(epoch) AS epoch FROM h JOIN c USING (epoch) WHERE value > bound GROUP BY 1"""
)
def checkpoint_thresholds(spark, sf_dir):
    """Customers' orders as the epochs of runs: where each first is above what is asked at the second and the fifth."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    history = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.row_number().over(w).cast("long").alias("epoch"), F.col("o_totalprice").alias("value"))
    asked = spark.createDataFrame([(2, 150000.0), (5, 200000.0)], "epoch long, bound double")
    return runs.missed_checkpoints(history, asked, ["run"])


# ---- inputs of models

@query(
    f"""WITH {_CONTAINS}, {_IN_ORDER}, {_PLACED_BY}, {_BRANDS}, n1 AS (SELECT in_order.dst, nid AS col, sum(w) AS val FROM in_order JOIN part ON src = p_partkey JOIN brands USING (p_brand) GROUP BY 1, 2),
    r AS (SELECT 'C' AS mp, c_custkey AS nid, 0 AS col, c_acctbal / 1000 AS val FROM customer UNION ALL SELECT 'CN', c_custkey, c_nationkey, 1 FROM customer
    UNION ALL SELECT 'CNR', c_custkey, n_regionkey, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'COPaB', placed_by.dst, col, sum(w * val) FROM placed_by JOIN n1 ON src = n1.dst GROUP BY 2, 3)
    SELECT mp, nid, col::BIGINT AS col, round(val + 1e-9, 6) AS val, CASE mp WHEN 'C' THEN 1 WHEN 'CN' THEN (SELECT max(n_nationkey) + 1 FROM nation) WHEN 'CNR' THEN (SELECT max(r_regionkey) + 1 FROM region) ELSE (SELECT count(*) FROM brands) END::BIGINT AS width FROM r"""
)
def named_path_inputs(spark, sf_dir):
    """Features of all customers along metapaths given by short names, their own first, with the width of each block."""
    g = commerce(spark, sf_dir)
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), F.lit("balance").alias("slot"), F.lit(0).alias("col"), (F.col("c_acctbal") / 1000).alias("val"))
    feats = {"customer": own} | {n: features.identity(g.nodes[n], n) for n in ("nation", "region", "brand")}
    paths = inputs.named_paths(g.meta, "customer", ["CN", "CNR", "COPaB"])
    slots = {n: {n: f.agg(F.max("col") + 1).first()[0]} for n, f in feats.items()}
    widths = inputs.path_widths(paths, slots)
    adjs = linalg.row_normalized_adjacencies(g.edges, {c for p in paths.values() for c in p if not c.is_self_loop})
    made, out = propagate.MetapathFeatures(adjs, feats).build(list(paths.values())), None
    for name, path in paths.items():
        part = made[path].select(F.lit(name).alias("mp"), "nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"), F.lit(widths[name]).cast("long").alias("width"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_CUSTOMERS}, {_NATION_LOOP} SELECT 'CNC' AS mp, loop.dst AS nid, label AS col, round(sum(w) + 1e-9, 6) AS val FROM loop JOIN customers ON loop.src = nid WHERE split = 'train' AND loop.dst <> loop.src GROUP BY 2, 3"""
)
def label_path_inputs(spark, sf_dir):
    """Labels along all metapaths of two edges from customers back to them; orders lead back to their own customer only, so nothing comes by them."""
    g = commerce(spark, sf_dir)
    short, labels, out = Aliases(g.meta).short, propagate.training_labels(g.nodes["customer"]), None
    for path in inputs.label_paths(g.meta, "customer", 2):
        adjs = linalg.row_normalized_adjacencies(g.edges, {c for c in path if not c.is_self_loop})
        part = propagate.label_features(adjs, path, labels).select(F.lit(short(path)).alias("mp"), "nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- whole models

def _normed_sql(xs: list[str]) -> list[str]:
    mean = f"(({' + '.join(xs)}) / {len(xs)})"
    var = f"(({' + '.join(f'({x} - {mean}) * ({x} - {mean})' for x in xs)}) / {len(xs)})"
    return [f"({x} - {mean}) / sqrt({var} + 1e-5)" for x in xs]


def _prelu_sql(xs: list[str], slope: float) -> list[str]:
    return [f"CASE WHEN {x} >= 0 THEN {x} ELSE {slope} * {x} END" for x in xs]


def _named(xs: list[str]) -> str:
    return ", ".join(f"{x} AS v{i}" for i, x in enumerate(xs))


_FOUR = ["v0", "v1", "v2", "v3"]


@query(
    f"""WITH a AS (SELECT c_custkey AS nid, c_acctbal / 1000 AS x, (c_custkey % 7)::DOUBLE AS y, n_regionkey::DOUBLE AS r, 1.0 AS one FROM customer JOIN nation ON c_nationkey = n_nationkey),
    b AS (SELECT nid, 0.5 * x + 0.1 * y AS v0, -0.25 * x + y + 0.5 AS v1, r - 0.5 * one AS v2, 0.2 * r + one + 0.1 AS v3, x, y, r, one FROM a), c AS (SELECT nid, x, y, r, one, {_named(_normed_sql(_FOUR))} FROM b), d AS (SELECT nid, x, y, r, one, {_named(_prelu_sql(_FOUR, 0.25))} FROM c)
    SELECT nid, round(v0 - v1 + 0.5 * v2 + 0.25 * v3 + 0.1 + 1e-9, 6) AS logit, round(x * exp(1) / (exp(1) + exp(2)) + r * exp(2) / (exp(1) + exp(2)) + 1e-9, 6) AS s0, round(y * exp(1) / (exp(1) + exp(2)) + one * exp(2) / (exp(1) + exp(2)) + 1e-9, 6) AS s1 FROM d"""
)
def path_projection_layer(spark, sf_dir):
    """Customers' own vectors and their nations', each projected apart, normalised together, put side by side; and a search's softmax mixture of both."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.col("n_regionkey").cast("double"), F.lit(1.0)).alias("h"))
    by_nation = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("nid"), F.lit("CN").alias("mp"), "h")
    per_path = _customer_vectors(spark, sf_dir).select("nid", F.lit("C").alias("mp"), "h").unionByName(by_nation)
    hs = layers.paths_stacked(per_path, {"C": 2, "CN": 2})
    projected = layers.path_projection(F.col("hs"), [[[0.5, 0.1], [-0.25, 1.0]], [[1.0, -0.5], [0.2, 1.0]]], [[0.0, 0.5], [0.0, 0.1]], 0.25)
    logit = layers.affine([[1.0, -1.0, 0.5, 0.25]], [0.1], F.flatten(projected))
    mixed = layers.searched_paths(F.col("hs"), [1.0, 2.0], [0, 1])
    return hs.select("nid", rounded(F.get(logit, 0)).alias("logit"), rounded(F.get(mixed, 0)).alias("s0"), rounded(F.get(mixed, 1)).alias("s1"))


@query(
    f"""WITH {_RING}, {_VEC}, p AS (SELECT 'a' AS mp, src, dst FROM f UNION ALL SELECT 'b', dst, src FROM f), z AS (SELECT mp, p.dst, a.h, CASE mp WHEN 'a' THEN 0.5 * a.h[1] - 0.25 * a.h[2] + 0.125 * b.h[1] + 0.5 * b.h[2] ELSE 0.1 * a.h[1] + 0.2 * b.h[2] END AS z
    FROM p JOIN v a ON a.nid = p.src JOIN v b ON b.nid = p.dst), l AS (SELECT *, exp(CASE WHEN z >= 0 THEN z ELSE 0.2 * z END) AS e FROM z),
    g AS (SELECT mp, dst AS nid, sum(e * h[1]) / sum(e) AS x, sum(e * h[2]) / sum(e) AS y FROM l GROUP BY 1, 2), u AS (SELECT m.mp, v.nid, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM v CROSS JOIN (VALUES ('a'), ('b')) AS m(mp) LEFT JOIN g ON g.mp = m.mp AND g.nid = v.nid),
    k AS (SELECT mp, nid, CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END AS x, CASE WHEN y > 0 THEN y ELSE exp(y) - 1 END AS y FROM u), s AS (SELECT mp, avg(tanh(0.1 * x) - 0.5 * tanh(0.2 * y)) AS s FROM k GROUP BY 1),
    w AS (SELECT mp, exp(s) / (SELECT sum(exp(s)) FROM s) AS w FROM s) SELECT nid, round(sum(w * x) + 1e-9, 6) AS x, round(sum(w * y) + 1e-9, 6) AS y FROM k JOIN w USING (mp) GROUP BY 1"""
)
def han_layer(spark, sf_dir):
    """Customers attend along two metapaths, then to the metapaths."""
    ring = _ring(spark, sf_dir)
    paths = {"a": ring, "b": ring.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    out = layers.han_conv(paths, _customer_vectors(spark, sf_dir), {"a": [0.5, -0.25], "b": [0.1, 0.0]}, {"a": [0.125, 0.5], "b": [0.0, 0.2]}, [[0.1, 0.0], [0.0, 0.2]], [1.0, -0.5])
    return out.select("nid", rounded(F.get("h", 0)).alias("x"), rounded(F.get("h", 1)).alias("y"))


@query(
    """WITH e AS (SELECT c_nationkey::BIGINT AS dst, 0 AS etype, c_acctbal / 1000 AS x, 0.5 AS r, 1.0 AS p, 1.0 AS m0, 0.5 AS m1, n_nationkey % 3 AS q FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT s_nationkey, 1, s_acctbal / 1000, -0.25, 2.0, 2.0, -1.0, n_nationkey % 3 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    z AS (SELECT *, exp(q * x * r * p) AS z0, exp(0.5 * q * x * 0.1 * p) AS z1 FROM e), t AS (SELECT dst, etype, 0.3 * sum(z0 * x * m0) / sum(z0) - 0.2 * sum(z1 * x * m1) / sum(z1) AS o FROM z GROUP BY 1, 2),
    s AS (SELECT dst, sum(o) / 2 AS o FROM t GROUP BY 1) SELECT n_nationkey::BIGINT AS nid, round(coalesce(o, 0) / (1 + exp(-0.4)) + (n_nationkey % 3) * (1 - 1 / (1 + exp(-0.4))) + 1e-9, 5) AS x FROM nation LEFT JOIN s ON dst = n_nationkey"""
)
def hgt_layer_by_type(spark, sf_dir):
    """Nations attend to their customers and to their suppliers apart; both are averaged."""
    edges, nodes, p = _typed(spark, sf_dir)
    return layers.hgt_conv(edges, nodes, "nation", *p, per_type=True).select("nid", F.round(F.get("h", 0) + 1e-9, 5).alias("x"))


_TWO = ["v0", "v1"]


@query(
    f"""WITH c AS (SELECT c_custkey AS nid, c_nationkey AS n, {_named(_normed_sql(["(0.5 * c_acctbal / 1000)", "(0.1 * c_acctbal / 1000 + 1)"]))} FROM customer), s AS (SELECT s_suppkey AS nid, s_nationkey AS n, {_named(_normed_sql(["(s_acctbal / 1000 - 0.5)", "(-0.2 * s_acctbal / 1000)"]))} FROM supplier),
    h AS (SELECT n_nationkey AS nid, {_named(_normed_sql(["(n_regionkey + 0.25)", "(0.5 * n_regionkey)"]))} FROM nation), cm AS (SELECT n, avg(v0) AS v0, avg(v1) AS v1 FROM c GROUP BY 1), sm AS (SELECT n, avg(v0) AS v0, avg(v1) AS v1 FROM s GROUP BY 1),
    k AS (SELECT exp(1) / (exp(1) + exp(2)) AS a, exp(2) / (exp(1) + exp(2)) AS b, exp(0.5) / (exp(0.5) + 1) AS a2, 1 / (exp(0.5) + 1) AS b2),
    one AS (SELECT h.nid, {", ".join(f"a * coalesce(cm.v{i}, 0) + b * coalesce(sm.v{i}, 0) AS m{i}, h.v{i} * (CASE WHEN cm.n IS NULL THEN 0 ELSE a2 END + CASE WHEN sm.n IS NULL THEN 0 ELSE b2 END) AS t{i}" for i in (0, 1))} FROM k, h LEFT JOIN cm ON cm.n = h.nid LEFT JOIN sm ON sm.n = h.nid),
    two AS (SELECT nid, t0 + 0.5 * m0 AS v0, t1 + 0.5 * m1 AS v1 FROM one), f AS (SELECT nid, v0 + 0.5 * v1 AS v0, v1 - v0 + 0.2 AS v1 FROM two), g AS (SELECT nid, {_named(_normed_sql(_TWO))} FROM f), o AS (SELECT nid, {_named(_prelu_sql(_TWO, 0.25))} FROM g)
    SELECT nid::BIGINT AS nid, round(v0 + 2 * v1 + 0.1 + 1e-9, 5) AS x, round(-0.5 * v0 + v1 + 1e-9, 5) AS y FROM o"""
)
def srgcn_model(spark, sf_dir):
    """Two layers over customers, suppliers and nations, projected into one space, and a readout of nations' logits."""
    g = commerce(spark, sf_dir)
    lives, based, home, base = (g.meta.canonical(e) for e in ("lives-in", "based-in", "home-of", "base-of"))
    column = lambda name, key, x: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("nid"), F.array(x).alias("h"))
    feats = {"customer": column("customer", "c_custkey", F.col("c_acctbal") / 1000), "supplier": column("supplier", "s_suppkey", F.col("s_acctbal") / 1000), "nation": column("nation", "n_nationkey", F.col("n_regionkey").cast("double"))}
    projection = {"customer": ([[0.5], [0.1]], [0.0, 1.0]), "supplier": ([[1.0], [-0.2]], [-0.5, 0.0]), "nation": ([[1.0], [0.5]], [0.25, 0.0])}
    weights = [{lives: 1.0, based: 2.0, home: 0.0, base: 0.0}, {lives: 0.5, based: 0.0, home: 0.0, base: 0.0}]
    out = layers.srgcn({c: g.edges[c] for c in (lives, based, home, base)}, feats, projection, weights, 1, 0.5, "nation", [([[1.0, 0.5], [-1.0, 1.0]], [0.0, 0.2], 0.25)], [[1.0, 2.0], [-0.5, 1.0]], [0.1, 0.0])
    return out.select("nid", F.round(F.get("h", 0) + 1e-9, 5).alias("x"), F.round(F.get("h", 1) + 1e-9, 5).alias("y"))
