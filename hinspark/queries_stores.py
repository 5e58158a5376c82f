"""Queries on stores, caches, builders and prepared networks, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import evaluate, features, layers, linalg, prepare, propagate, runs, sample, sequences, trees
from .operators.cache import FeatureCache
from .plans import stages
from .queries import _BRANDS, _CONTAINS, _CUSTOMERS, _IN_ORDER, _PLACED_BY, _RING, _ring, rounded
from .scratch import new_path, written
from .sources import rowstore
from .sources.builders import build
from .sources.relational import commerce, spread
from .sources.specs import Relation, Spec
from .types import CEType, expansions


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- features by row, kept features, rows on demand

_BRAND_ROWS = f"""{_CONTAINS}, {_IN_ORDER}, {_PLACED_BY}, {_BRANDS},
    n1 AS (SELECT in_order.dst, nid AS col, sum(w) AS val FROM in_order JOIN part ON src = p_partkey JOIN brands USING (p_brand) GROUP BY 1, 2),
    n2 AS (SELECT placed_by.dst AS nid, col, sum(w * val) AS val FROM placed_by JOIN n1 ON src = n1.dst GROUP BY 1, 2)"""

_CUSTOMER_ROWS = f"""{_BRAND_ROWS},
    rows_ AS (SELECT 'brands' AS mp, nid, 'brand' AS slot, col, val FROM n2 UNION ALL SELECT 'nation', c_custkey, 'nation', c_nationkey, 1.0 FROM customer
    UNION ALL SELECT 'region', c_custkey, 'region', n_regionkey, 1.0 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def customer_metapaths(spark: SparkSession, sf_dir: str) -> propagate.MetapathDataset:
    """The brands that customers buy, their nation and their region, each by a metapath."""
    g = commerce(spark, sf_dir)
    of = lambda *names: tuple(map(g.meta.canonical, names))
    paths = {"brands": of("brand-of", "in-order", "placed-by"), "nation": of("home-of"), "region": of("has-nation", "home-of")}
    return propagate.MetapathDataset(g, {n: features.identity(g.nodes[n], n) for n in ("brand", "nation", "region")}, paths)


def _cells(df: DataFrame) -> DataFrame:
    return df.select("mp", "nid", "slot", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))


@query(f"WITH {_CUSTOMER_ROWS} SELECT mp, nid, slot, col::BIGINT AS col, round(val + 1e-9, 6) AS val FROM rows_")
def transposed_store(spark, sf_dir):
    """All customers' features by three metapaths, written by row and read back in two ranges that meet at the middle id."""
    store = rowstore.RowStore.write(customer_metapaths(spark, sf_dir).all(), new_path(spark, "rows"))
    low, high = store.index.agg(F.min("low"), F.max("high")).first()
    half = (low + high) // 2
    return _cells(rowstore.cells_of(store.between(low, half).unionByName(store.between(half + 1, high))))


@query(f"WITH {_CUSTOMER_ROWS} SELECT mp, nid, slot, col::BIGINT AS col, round(val + 1e-9, 6) AS val FROM rows_")
def lazy_metapath_rows(spark, sf_dir):
    """The same features, made for the rows that are asked for: here every customer."""
    rows = customer_metapaths(spark, sf_dir)
    return _cells(rows.rows(rows.graph.nodes["customer"]))


@query(
    f"""WITH {_BRAND_ROWS} SELECT 'customer' AS ntype, nid, col, round(val + 1e-9, 6) AS val FROM n2 UNION ALL SELECT 'order', dst, col, round(val + 1e-9, 6) FROM n1"""
)
def cached_metapath_features(spark, sf_dir):
    """The brands of orders are made and kept; a second cache over the same folder goes on from them to customers."""
    folder = new_path(spark, "cache")
    for paths in ([("brand-of", "in-order")], [("brand-of", "in-order", "placed-by"), ("brand-of", "in-order")]):
        g = commerce(spark, sf_dir)
        steps = [tuple(map(g.meta.canonical, p)) for p in paths]
        made = FeatureCache(spark, folder).features(g, {"brand": features.identity(g.nodes["brand"], "brand")}, steps)
    parts = [df.select(F.lit(p[-1].dst).alias("ntype"), "nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val")) for p, df in made.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    """WITH n AS (SELECT n_nationkey AS nid, n_regionkey AS col FROM nation)
    SELECT 'region' AS ntype, r_regionkey::BIGINT AS nid, r_regionkey::BIGINT AS col, 1.0::DOUBLE AS val FROM region UNION ALL SELECT 'nation', nid, col, 1.0 FROM n
    UNION ALL SELECT 'customer', c_custkey, col, 1.0 FROM customer JOIN n ON c_nationkey = nid UNION ALL SELECT 'supplier', s_suppkey, col, 1.0 FROM supplier JOIN n ON s_nationkey = nid"""
)
def cached_slots(spark, sf_dir):
    """Regions propagated to every type, kept, and read again."""
    folder, out = new_path(spark, "cache"), None
    for _ in range(2):
        g = commerce(spark, sf_dir)
        g = g.of_meta(type(g.meta)(("region", "nation", "customer", "supplier"), tuple(g.meta.canonical(e) for e in ("has-nation", "home-of", "base-of"))))
        out = FeatureCache(spark, folder).slots(g, {"region": features.identity(g.nodes["region"], "region")})
    parts = [f.select(F.lit(n).alias("ntype"), "nid", F.col("col").cast("long").alias("col"), "val") for n, f in out.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- networks from raw folders

_RAW = Spec(
    ("customer", "order", "part", "nation", "region"),
    (Relation("customer", "places", "order", "placed-by"), Relation("order", "contains", "part", "in-order"), Relation("customer", "lives-in", "nation", "home-of"), Relation("nation", "part-of", "region", "has-nation")),
    target="customer",
)


def raw_folder(spark: SparkSession, sf_dir: str) -> str:
    """The commerce network as files of nodes, links and labels, as a benchmark would come."""
    g = commerce(spark, sf_dir)
    g = replace(g, nodes=g.nodes.only(_RAW.ntypes), edges=g.edges.only(g.meta.canonical(r.name) for r in _RAW.relations), inverse={})
    path, text = new_path(spark, "raw"), lambda *c: F.concat_ws("\t", *c).alias("value")
    nodes, links = g.homogeneous(_RAW.ntypes)
    names = F.concat(F.array(*map(F.lit, _RAW.ntypes))[F.col("type")], F.lit("-"), F.col("nid"))
    nodes.select(text("gid", names, "type")).write.text(f"{path}/node.dat")
    links.select(text("src", "dst", "etype", "weight")).write.text(f"{path}/link.dat")
    known = g.nodes["customer"].where("split is not null")
    for split in ("train", "val", "test"):
        known.where(F.col("split") == split).select(text("nid", F.concat(F.lit("customer-"), F.col("nid")), F.lit("0"), "label")).write.text(f"{path}/data_{split}.dat")
    return path


_RAW_EDGES = """e AS (SELECT 'places' AS a, 'placed-by' AS b, o_custkey::BIGINT AS src, o_orderkey::BIGINT AS dst FROM orders UNION ALL SELECT DISTINCT 'contains', 'in-order', l_orderkey, l_partkey FROM lineitem
    UNION ALL SELECT 'lives-in', 'home-of', c_custkey, c_nationkey FROM customer UNION ALL SELECT 'part-of', 'has-nation', n_nationkey, n_regionkey FROM nation),
    ways AS (SELECT a AS etype, src, dst FROM e UNION ALL SELECT b, dst, src FROM e)"""


@query(f"WITH {_RAW_EDGES} SELECT etype, src, dst FROM ways")
def raw_network(spark, sf_dir):
    """Every edge type of the network that is written as raw files and built from them by declaration."""
    g = build(spark, raw_folder(spark, sf_dir), _RAW).graph
    return reduce(DataFrame.unionByName, [e.select(F.lit(c.etype).alias("etype"), "src", "dst") for c, e in g.edges.items()])


@query(f"WITH {_CUSTOMERS} SELECT nid, CASE WHEN split IS NOT NULL THEN label END AS label, split FROM customers")
def raw_network_labels(spark, sf_dir):
    """The target nodes of the network built from raw files, with their classes and splits."""
    return build(spark, raw_folder(spark, sf_dir), _RAW).graph.nodes["customer"].select("nid", "label", "split")


# ---- sampled subgraphs, powers, slots

_PICK = lambda rows, n, seed: f"(SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY md5(src || '-' || dst || '-{seed}'), src) AS r FROM {rows}) WHERE r <= {n})"


@query(
    f"""WITH pb AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders), pl AS (SELECT dst AS src, src AS dst FROM pb), io AS (SELECT DISTINCT l_partkey AS src, l_orderkey AS dst FROM lineitem),
    one AS (SELECT * FROM {_PICK("pb", 3, 5)} WHERE dst IN (SELECT c_custkey FROM customer)), f_order AS (SELECT DISTINCT src AS nid FROM one),
    e AS (SELECT 'placed-by' AS etype, src, dst FROM {_PICK("pb", 2, 6)} WHERE dst IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'places', src, dst FROM {_PICK("pl", 2, 6)} WHERE dst IN (FROM f_order) UNION ALL SELECT 'in-order', src, dst FROM {_PICK("io", 2, 6)} WHERE dst IN (FROM f_order)),
    n AS (SELECT 'customer' AS t, c_custkey AS old FROM customer UNION SELECT 'order', nid FROM f_order UNION SELECT 'order', src FROM e WHERE etype = 'placed-by'
      UNION SELECT 'customer', src FROM e WHERE etype = 'places' UNION SELECT 'part', src FROM e WHERE etype = 'in-order'),
    i AS (SELECT t, old, row_number() OVER (PARTITION BY t ORDER BY old) - 1 AS nid FROM n),
    k AS (SELECT * FROM (VALUES ('placed-by', 'order', 'customer'), ('places', 'customer', 'order'), ('in-order', 'part', 'order')) AS x(etype, s, d))
    SELECT e.etype, a.nid AS src, b.nid AS dst, a.old AS old_src, b.old AS old_dst FROM e JOIN k USING (etype) JOIN i a ON a.t = k.s AND a.old = e.src JOIN i b ON b.t = k.d AND b.old = e.dst"""
)
def sampled_subgraph(spark, sf_dir):
    """Two layers sampled from all customers, re-numbered; edges under their new and old ids."""
    g = commerce(spark, sf_dir)
    g = g.of_meta(type(g.meta)(("customer", "order", "part"), tuple(g.meta.canonical(e) for e in ("placed-by", "places", "in-order"))))
    small, _ = sample.subgraph(g, {"customer": g.nodes["customer"]}, [3, 2], seed=5)
    parts = []
    for c, e in small.edges.items():
        a, b = (small.nodes[t].select(F.col("nid").alias(end), F.col("old").alias(f"old_{end}")) for t, end in ((c.src, "src"), (c.dst, "dst")))
        parts.append(e.join(a, "src").join(b, "dst").select(F.lit(c.etype).alias("etype"), "src", "dst", "old_src", "old_dst"))
    return reduce(DataFrame.unionByName, parts)


@query(
    """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS k FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
    a AS (SELECT k AS src, k AS dst FROM n UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    b AS (SELECT DISTINCT x.src, y.dst FROM a x JOIN a y ON x.dst = y.src) SELECT 1 AS power, src, dst FROM a UNION ALL SELECT 2, src, dst FROM b"""
)
def adjacency_powers(spark, sf_dir):
    """People to nations to regions with loops: A and A²; A⁴ is A² again, so there are no more."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda a, c: F.concat(F.lit(a), F.col(c))
    nodes = [t(name).select(key(a, c).alias("nid")) for name, a, c in (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"))]
    ends = (("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"))
    edges = [t(name).select(key(a, x).alias("src"), key(b, y).alias("dst")) for name, a, x, b, y in ends]
    powers = linalg.squared_powers(reduce(DataFrame.union, edges), reduce(DataFrame.union, nodes), 5)
    return reduce(DataFrame.unionByName, [p.select(F.lit(2**k).alias("power"), "src", "dst") for k, p in enumerate(powers)])


_SLOTS = f"""{_RING}, v AS (SELECT c_custkey AS nid, 0.5 * c_acctbal / 1000 AS a, -0.25 * (c_custkey % 7) AS b FROM customer),
    z AS (SELECT f.dst, s.a, s.b, 0.3 * s.a + 0.2 * s.b - 0.1 * d.a + 0.4 * d.b AS z FROM f JOIN v s ON s.nid = f.src JOIN v d ON d.nid = f.dst), w AS (SELECT *, exp(CASE WHEN z >= 0 THEN z ELSE 0.2 * z END) AS w FROM z),
    h AS (SELECT dst AS nid, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM w GROUP BY 1),
    q AS (SELECT avg(0.7 * tanh(0.5 * a + 0.1)) AS qa, avg(0.7 * tanh(0.5 * b + 0.1)) AS qb FROM h)"""


@query(
    f"""WITH {_SLOTS} SELECT 'mean' AS how, nid, 0 AS i, round((a + b) / 2 + 1e-9, 6) AS x FROM h UNION ALL SELECT 'max', nid, 0, round(greatest(a, b) + 1e-9, 6) FROM h
    UNION ALL SELECT 'concat', nid, 0, round(a + 1e-9, 6) FROM h UNION ALL SELECT 'concat', nid, 1, round(b + 1e-9, 6) FROM h
    UNION ALL SELECT 'softmax', nid, 0, round((exp(qa) * a + exp(qb) * b) / (exp(qa) + exp(qb)) + 1e-9, 6) FROM h, q"""
)
def slot_attention_layer(spark, sf_dir):
    """Customers with two slots; attention shared by both, slots merged in four ways."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    slot = lambda name, x: people.select(F.col("c_custkey").alias("nid"), F.lit(name).alias("slot"), F.array(x.cast("double")).alias("h"))
    nodes = slot("balance", F.col("c_acctbal") / 1000).unionByName(slot("rest", F.col("c_custkey") % 7).where("h[0] <> 0"))
    rows, _ = layers.slot_gat_conv(_ring(spark, sf_dir), nodes, {"balance": [[[0.5]]], "rest": [[[-0.25]]]}, {"balance": [[0.3]], "rest": [[0.2]]}, {"balance": [[-0.1]], "rest": [[0.4]]})
    rows, parts = written(rows, "slots"), []
    for how in ("mean", "max", "concat", "softmax"):
        merged = layers.slots_merged(rows, ["balance", "rest"], 1, how, [[0.5]], [0.1], [0.7])
        parts.append(merged.select(F.lit(how).alias("how"), "nid", F.posexplode("h").alias("i", "x")).select("how", "nid", "i", rounded("x").alias("x")))
    return reduce(DataFrame.unionByName, parts)


# ---- sequences, polynomials, stages


@query(
    f"""WITH {_RING}, v AS (SELECT c_custkey AS nid, c_acctbal / 1000 AS x, (c_custkey % 7)::DOUBLE AS y, (c_nationkey % 2)::DOUBLE AS r FROM customer),
    a AS (SELECT nid, nid AS node, 0 AS depth FROM v UNION ALL SELECT DISTINCT src, dst, 1 FROM f WHERE src <> dst),
    s AS (SELECT nid, node, row_number() OVER (PARTITION BY nid ORDER BY depth, md5(nid || '-' || node || '-4'), node) AS k FROM a), q AS (SELECT s.nid, k, x, y, r FROM s JOIN v ON v.nid = node WHERE k <= 3),
    z AS (SELECT i.nid, i.x, i.y, j.x AS fx, -0.5 * j.y AS fy, exp((0.3 * (CASE WHEN i.x >= 0 THEN 0.5 * i.x ELSE 0.005 * i.x END) - 0.2 * 0.25 * i.y + 0.1 * (CASE WHEN j.x >= 0 THEN j.x ELSE 0.01 * j.x END) + 0.4 * 0.01 * -0.5 * j.y
      + 0.5 * (i.r + 0.5 * (1 - i.r)) * (0.2 * j.r - (1 - j.r))) / 2) AS e FROM q i JOIN q j ON i.nid = j.nid WHERE i.k = 1),
    c AS (SELECT nid, x + sum(e * fx) / sum(e) + 0.5 * sum(e * fy) / sum(e) AS a, y + sum(e * fy) / sum(e) AS b FROM z GROUP BY nid, x, y),
    n AS (SELECT nid, a, b, (a + b) / 2 AS m, sqrt(((a - b) / 2) ** 2 + 1e-5) AS d FROM c)
    SELECT nid, round((a - m) / d + 1e-9, 5) AS x, round(2 * (b - m) / d + 0.1 + 1e-9, 5) AS y FROM n"""
)
def sequence_attention_layer(spark, sf_dir):
    """Customers with up to two neighbours attend to each other inside their sequences, with their nations' encodings."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nodes = people.select(F.col("c_custkey").alias("nid"), F.array(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 7).cast("double")).alias("h"))
    half = (F.col("c_nationkey") % 2).cast("double")
    relations = people.select(F.col("c_custkey").alias("nid"), F.array(half, 1 - half).alias("h"))
    seqs = sample.node_sequences(_ring(spark, sf_dir), nodes.select("nid"), 3, 1, 4)
    rows = sequences.sequence_attention(
        sequences.gathered(seqs, nodes, relations),
        [[0.5, 0.0], [0.0, 0.25]], [[1.0, 0.0], [0.0, -0.5]], [[0.3, -0.2]], [[0.1, 0.4]], [[[1.0, 0.5]]], [[[0.2, -1.0]]], [[1.0, 0.5], [0.0, 1.0]], [1.0, 2.0], [0.0, 0.1], beta=0.5, temper=2.0,
    )
    return sequences.first_places(rows).select("nid", F.round(F.get("h", 0) + 1e-9, 5).alias("x"), F.round(F.get("h", 1) + 1e-9, 5).alias("y"))


@query(
    """WITH yn AS (SELECT n_nationkey::BIGINT AS nid, 'region' AS slot, n_regionkey::BIGINT AS col, 0.5 AS val FROM nation),
    yc AS (SELECT c_custkey AS nid, 'nation' AS slot, c_nationkey::BIGINT AS col, -1.5 AS val FROM customer UNION ALL SELECT c_custkey, 'region', n_regionkey, 0.25 FROM customer JOIN nation ON c_nationkey = n_nationkey),
    zn AS (SELECT c_nationkey::BIGINT AS nid, slot, col, sum(-1.5 * val) AS val FROM yc JOIN customer ON c_custkey = nid GROUP BY ALL),
    zr AS (SELECT n_regionkey::BIGINT AS nid, slot, col, sum(v) AS val FROM (SELECT nid, slot, col, 0.5 * val AS v FROM yn UNION ALL SELECT c_nationkey, slot, col, 0.25 * val FROM yc JOIN customer ON c_custkey = nid) JOIN nation ON n_nationkey = nid GROUP BY ALL)
    SELECT 'there' AS way, 'nation' AS ntype, nid, slot, col, round(val + 1e-9, 6)::DOUBLE AS val FROM yn UNION ALL SELECT 'there', 'customer', nid, slot, col, round(val + 1e-9, 6) FROM yc
    UNION ALL SELECT 'back', 'nation', nid, slot, col, round(val + 1e-9, 6) FROM zn UNION ALL SELECT 'back', 'region', nid, slot, col, round(val + 1e-9, 6) FROM zr"""
)
def metapath_polynomial(spark, sf_dir):
    """A polynomial of all metapaths of two hops from regions by nations to customers, and its transpose on the result."""
    g = commerce(spark, sf_dir)
    steps = [g.meta.canonical(e) for e in ("has-nation", "home-of")]
    adjs = linalg.row_normalized_adjacencies(g.edges, set(steps))
    paths = expansions(steps, 2)
    coefficients = dict(zip(paths, (0.5, -1.5, 0.25), strict=True))
    there = propagate.polynomial_along(adjs, {n: features.identity(g.nodes[n], n) for n in ("region", "nation")}, coefficients)
    back = propagate.polynomial_back(adjs, there, coefficients)
    parts = [df.select(F.lit(way).alias("way"), F.lit(n).alias("ntype"), "nid", "slot", F.col("col").cast("long").alias("col"), rounded("val").alias("val")) for way, made in (("there", there), ("back", back)) for n, df in made.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {_RING}, k AS (SELECT max(c_custkey) + 1 AS c FROM customer), m AS (SELECT c, (SELECT max(n_nationkey) + 1 FROM nation) AS n FROM k),
    every AS (SELECT c_custkey AS g FROM customer UNION ALL SELECT c + n_nationkey FROM nation, m), b AS (SELECT dst, src FROM f UNION SELECT g, g FROM every)
    SELECT 'cites' AS etype, dst::BIGINT AS dst, src::BIGINT AS src, round(1.0 / count(*) OVER (PARTITION BY dst) + 1e-9, 6) AS w FROM b
    UNION ALL SELECT 'lives-in', c + c_nationkey, c_custkey, round(1.0 / count(*) OVER (PARTITION BY c_nationkey) + 1e-9, 6) FROM customer, m"""
)
def polynomial_preparation(spark, sf_dir):
    """Customers that cite each other and live in nations, made ready for a polynomial: nations have no features and keep their place."""
    g = commerce(spark, sf_dir)
    lives, cites = g.meta.canonical("lives-in"), CEType("customer", "cites", "customer")
    g = replace(g, nodes=g.nodes.only(("customer", "nation")), edges=g.edges.only([lives]) | {cites: _ring(spark, sf_dir)}, inverse={})
    _, _, adjs = prepare.polynomial_inputs(g, {"customer": features.identity(g.nodes["customer"], "customer")}, binary=["cites"])
    return reduce(DataFrame.unionByName, [a.select(F.lit(c.etype).alias("etype"), "dst", "src", rounded("w").alias("w")) for c, a in adjs.items()])


def _stage_sql(k: int) -> str:
    """A stage's examples, counts of classes by nation, probabilities, guesses and score."""
    guessed = f" UNION SELECT p.nid, p.pred FROM g{k - 1} p JOIN customers c ON c.nid = p.nid WHERE c.split IN ('val', 'test') AND p.p > 0.5" if k else ""
    return f"""x{k} AS (SELECT nid, label FROM customers WHERE split = 'train'{guessed}),
    l{k} AS (SELECT n.nation, n.cls, count(x.nid)::DOUBLE AS logit FROM (SELECT n_nationkey AS nation, cls FROM nation, range(0, 5) AS t(cls)) n LEFT JOIN (SELECT c_nationkey, x{k}.nid, label FROM x{k} JOIN customer ON c_custkey = x{k}.nid) x ON x.c_nationkey = n.nation AND x.label = n.cls GROUP BY 1, 2),
    q{k} AS (SELECT nation, cls, exp(logit - max(logit) OVER w) / sum(exp(logit - 100)) OVER w * exp(max(logit) OVER w - 100) AS p FROM l{k} WINDOW w AS (PARTITION BY nation)),
    b{k} AS (SELECT nation, cls AS pred, p FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY p DESC, cls) AS r FROM q{k}) WHERE r = 1),
    g{k} AS (SELECT c_custkey AS nid, pred, p FROM customer JOIN b{k} ON nation = c_nationkey), s{k} AS (SELECT {k} AS stage, avg((pred = label)::INT) AS score FROM g{k} JOIN customers USING (nid) WHERE split = 'val')"""


@query(
    f"""WITH {_CUSTOMERS}, {", ".join(_stage_sql(k) for k in range(3))}, best AS (SELECT stage FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2) ORDER BY round(score, 9) DESC, stage LIMIT 1)
    SELECT stage, nid, pred FROM best JOIN (SELECT 0 AS stage, nid, pred FROM g0 UNION ALL SELECT 1, nid, pred FROM g1 UNION ALL SELECT 2, nid, pred FROM g2) USING (stage)"""
)
def self_training_stages(spark, sf_dir):
    """Three stages whose model counts a nation's examples by class; guesses of the best one."""
    nodes = commerce(spark, sf_dir).nodes["customer"]
    homes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("nid"), F.col("c_nationkey").alias("nation"))

    def learn(number: int, examples: DataFrame) -> DataFrame:
        per = examples.select("nid", "label").distinct().join(homes, "nid").groupBy("nation", F.col("label").alias("cls")).agg(F.count("*").cast("double").alias("logit"))
        cells = homes.withColumn("cls", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
        return cells.join(per, ["nation", "cls"], "left").select("nid", "cls", F.coalesce("logit", F.lit(0.0)).alias("logit"))

    best = stages.self_training(nodes, learn, 3, 0.5, batch=64, share=0.25)
    return evaluate.argmax_class(best.logits).select(F.lit(best.number).alias("stage"), "nid", "pred")


# ---- trees


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, x, label, split): a customer's balance, nation, orders and what they cost."""
    per = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_totalprice"), "o_custkey").groupBy(F.col("o_custkey").alias("nid")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("price"))
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("nid"), "c_acctbal", "c_nationkey")
    x = F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), F.coalesce("n", F.lit(0)).cast("double"), F.coalesce("price", F.lit(0.0)))
    return people.join(per, "nid", "left").join(commerce(spark, sf_dir).nodes["customer"], "nid").select("nid", x.alias("x"), "label", "split")


@query()
def tree_leaf_ids(spark, sf_dir):
    """Customers' leaves in boosted trees of each class, numbered from 0 over all trees."""
    rows = written(customer_rows(spark, sf_dir), "rows")
    return runs.reindexed(trees.leaves(trees.boosted(rows, 5, 3, 3), rows)).select("nid", "tree", "leaf", "id")
