"""One query for each operator over the relational tables, with its DuckDB twin.

Values that depend on the order of a sum are rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import vectors
from .operators import atomize, evaluate, features, layers, linalg, prepare, propagate, runs, sample
from .plans.selection import Selection, refined
from .sources.relational import SPLIT, commerce, table
from .types import CEType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# common parts of the twins
_CONTAINS = "contains_ AS (SELECT l_orderkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)"
_SUPPLIES = "supplies AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"
_CUSTOMERS = f"customers AS (SELECT c_custkey AS nid, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label, {SPLIT.replace('pmod(c_custkey * 7 + 3, 10)', '(c_custkey * 7 + 3) % 10')} AS split FROM customer)"
_BRANDS = "brands AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS nid FROM (SELECT DISTINCT p_brand FROM part))"
_IN_ORDER = "in_order AS (SELECT src AS dst, dst AS src, w / sum(w) OVER (PARTITION BY src) AS w FROM contains_)"
_PLACED_BY = "placed_by AS (SELECT o_custkey AS dst, o_orderkey AS src, 1.0 / count(*) OVER (PARTITION BY o_custkey) AS w FROM orders)"
_BUYS = "buys AS (SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_SCORED = "scored AS (SELECT src, dst, (src * 31 + dst * 17) % 1000 AS score, CASE WHEN (src * 7 + dst * 3) % 5 = 0 THEN 1 ELSE 0 END AS y FROM buys)"
_PREDICTED = "predicted AS (SELECT c_custkey AS nid, (c_custkey * 13 + 5) % 5 AS pred, label AS y FROM customer JOIN customers ON nid = c_custkey)"


def _adj(graph, etype: str) -> DataFrame:
    return linalg.row_normalized(linalg.adjacency(graph.edge(etype)))


def buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buys(spark, sf_dir)
    return b.select("src", "dst", F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(1000)).alias("score"), F.when(F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(5)) == 0, 1).otherwise(0).alias("y"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce(spark, sf_dir).nodes["customer"].select("nid", F.pmod(F.col("nid") * 13 + 5, F.lit(5)).alias("pred"), F.col("label").alias("y"))


# ---- networks and their structure

@query(
    """SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part
    UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region
    UNION ALL SELECT 'brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'ptype', count(DISTINCT p_type) FROM part UNION ALL SELECT 'size', count(DISTINCT p_size) FROM part"""
)
def hin_node_counts(spark, sf_dir):
    return commerce(spark, sf_dir).counts().where("kind = 'node'").select("name", "n")


@query(
    """WITH e AS (SELECT 'places' AS a, 'placed-by' AS b, count(*) AS n FROM orders UNION ALL SELECT 'contains', 'in-order', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    UNION ALL SELECT 'supplies', 'supplied-by', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'lives-in', 'home-of', count(*) FROM customer
    UNION ALL SELECT 'based-in', 'base-of', count(*) FROM supplier UNION ALL SELECT 'part-of', 'has-nation', count(*) FROM nation
    UNION ALL SELECT 'has-brand', 'brand-of', count(*) FROM part UNION ALL SELECT 'has-ptype', 'ptype-of', count(*) FROM part UNION ALL SELECT 'has-size', 'size-of', count(*) FROM part)
    SELECT a AS name, n FROM e UNION ALL SELECT b, n FROM e"""
)
def hin_edge_counts(spark, sf_dir):
    return commerce(spark, sf_dir).counts().where("kind = 'edge'").select("name", "n")


@query(f"WITH {_CONTAINS}, {_IN_ORDER} SELECT dst, src, round(w + 1e-9, 6) AS w FROM in_order")
def row_normalize(spark, sf_dir):
    return _adj(commerce(spark, sf_dir), "in-order").select("dst", "src", rounded("w").alias("w"))


@query(
    f"""WITH {_CONTAINS}, {_IN_ORDER}, {_PLACED_BY}, {_BRANDS},
    a AS (SELECT p_partkey AS dst, nid AS src, 1.0 AS w FROM part JOIN brands USING (p_brand)),
    b AS (SELECT in_order.dst, a.src, sum(in_order.w * a.w) AS w FROM in_order JOIN a ON in_order.src = a.dst GROUP BY 1, 2)
    SELECT placed_by.dst AS customer, b.src AS brand, round(sum(placed_by.w * b.w) + 1e-9, 6) AS w FROM placed_by JOIN b ON placed_by.src = b.dst GROUP BY 1, 2"""
)
def metapath_adj_brand_customer(spark, sf_dir):
    """For each customer the brand profile of what they buy: the flagship."""
    g = commerce(spark, sf_dir)
    path = tuple(g.meta.canonical(e) for e in ("brand-of", "in-order", "placed-by"))
    adjs = linalg.row_normalized_adjacencies(g.edges, set(path))
    return propagate.metapath_adjacency(adjs, path).select(F.col("dst").alias("customer"), F.col("src").alias("brand"), rounded("w").alias("w"))


@query("SELECT o_orderkey AS src, o_custkey AS dst FROM orders")
def inverse_edges(spark, sf_dir):
    g = commerce(spark, sf_dir)
    return g.edges[g.inverse[g.meta.canonical("places")]].select("src", "dst")


@query("SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT c_custkey, p_partkey FROM customer JOIN part ON c_custkey = p_partkey)")
def merge_etypes(spark, sf_dir):
    from dataclasses import replace

    g = commerce(spark, sf_dir)
    same = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src")).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst")), F.col("src") == F.col("dst"))
    a, b = CEType("customer", "buys", "part"), CEType("customer", "twin", "part")
    g = replace(g, nodes=g.nodes.only(("customer", "part")), edges={a: buys(spark, sf_dir), b: same}, inverse={})
    return g.merged("buys", "twin").edge("buys")


_NODE_COUNTS = """counted AS (SELECT 'customer' AS ntype, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part
    UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region
    UNION ALL SELECT 'brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'ptype', count(DISTINCT p_type) FROM part UNION ALL SELECT 'size', count(DISTINCT p_size) FROM part)"""


def _node_counts(graph) -> DataFrame:
    return graph.node_counts().select(F.col("name").alias("ntype"), "n")


@query(f"WITH {_NODE_COUNTS} SELECT ntype, n FROM counted WHERE ntype IN ('customer', 'order', 'part', 'brand', 'ptype', 'size')")
def remove_etypes(spark, sf_dir):
    """Nodes of the types that still reach the customer without the edges that tie suppliers and nations to it."""
    return _node_counts(commerce(spark, sf_dir).without_etypes(["home-of", "supplies"]))


@query(
    f"""WITH RECURSIVE e(src, dst) AS (VALUES ('customer', 'order'), ('order', 'customer'), ('order', 'part'), ('part', 'order'), ('supplier', 'part'), ('part', 'supplier'), ('customer', 'nation'),
    ('nation', 'customer'), ('supplier', 'nation'), ('nation', 'supplier'), ('nation', 'region'), ('region', 'nation'), ('part', 'brand'), ('brand', 'part'), ('part', 'ptype'), ('ptype', 'part'), ('part', 'size'), ('size', 'part')),
    r AS (SELECT 'customer' AS ntype UNION SELECT e.src FROM e JOIN r ON e.dst = r.ntype), {_NODE_COUNTS} SELECT ntype, n FROM counted JOIN r USING (ntype)"""
)
def reachable_types(spark, sf_dir):
    """Nodes of the types from which edges lead to the customer."""
    g = commerce(spark, sf_dir)
    return _node_counts(g.of_meta(g.meta.pruned("customer")))


@query("SELECT n_nationkey::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation")
def self_loops(spark, sf_dir):
    return commerce(spark, sf_dir).with_self_loops(["nation"]).edge("nation-self")


@query(
    """WITH c AS (SELECT max(c_custkey) + 1 AS n FROM customer), o AS (SELECT max(o_orderkey) + 1 AS n FROM orders)
    SELECT o_custkey AS src, o_orderkey + c.n AS dst, 0 AS etype FROM orders, c UNION ALL SELECT l_orderkey + c.n, l_partkey + c.n + o.n, 1 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c, o"""
)
def homogenize(spark, sf_dir):
    from dataclasses import replace

    g = commerce(spark, sf_dir)
    g = replace(g, nodes=g.nodes.only(("customer", "order", "part")), edges=g.edges.only(g.meta.canonical(e) for e in ("places", "contains")), inverse={})
    return g.homogeneous()[1].select("src", "dst", "etype")


# ---- features and atomization

@query("SELECT p_partkey AS src, dense_rank() OVER (ORDER BY p_brand) - 1 AS dst FROM part")
def atomize_onehot(spark, sf_dir):
    return atomize.categories(table(spark, sf_dir, "part"), "p_partkey", "p_brand")[1]


@query(
    r"""WITH w AS (SELECT doc_id AS row, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')) AS word FROM documents), n AS (SELECT row, word, count(*)::DOUBLE AS n FROM w WHERE word <> '' GROUP BY 1, 2)
    SELECT row, word, round(n * count(*) OVER (PARTITION BY row) / greatest(sum(n) OVER (PARTITION BY row), 1e-6) + 1e-9, 6) AS per_row,
    round(n * count(*) OVER (PARTITION BY word) / greatest(sum(n) OVER (PARTITION BY word), 1e-6) + 1e-9, 6) AS per_word FROM n"""
)
def atomize_bow_docs(spark, sf_dir):
    both = atomize.bag_of_words_both(table(spark, sf_dir, "documents"), "doc_id", "text")
    return both.select("row", "word", rounded("per_row").alias("per_row"), rounded("per_word").alias("per_word"))


@query(
    """WITH l AS (SELECT p_partkey AS row, 'p_size' AS col, p_size::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part), z AS (SELECT * FROM l WHERE x <> 0)
    SELECT row, col, round(x * 2 / sum(abs(x)) OVER (PARTITION BY row) + 1e-9, 6) AS per_row, round(x * (SELECT count(*) FROM part) / sum(abs(x)) OVER (PARTITION BY col) + 1e-9, 6) AS per_col FROM z"""
)
def atomize_numeric(spark, sf_dir):
    a, b = atomize.numeric_columns(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return a.join(b.withColumnRenamed("weight", "x"), ["row", "col"]).select("row", "col", rounded("weight").alias("per_row"), rounded("x").alias("per_col"))


@query(
    """WITH m AS (SELECT avg(abs(p_retailprice)) AS m FROM part) SELECT p_partkey AS row, 0 AS col, round(p_retailprice + 1e-7 + 1e-9, 6) AS weight FROM part
    UNION ALL SELECT p_partkey, 1, round(m + 1e-7 + 1e-9, 6) FROM part, m"""
)
def atomize_mean_column(spark, sf_dir):
    return atomize.with_mean_column(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice").select("row", "col", rounded("weight").alias("weight"))


@query(
    """WITH y AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, o_orderkey % 3 = 0 AS t FROM orders), b AS (SELECT min(y) AS lo, max(y) AS hi FROM y WHERE t)
    SELECT k AS src, y - lo AS dst FROM y, b WHERE y BETWEEN lo AND hi"""
)
def onehot_train_only(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return atomize.train_range(years, "o_orderkey", "y", F.when(F.col("o_orderkey") % 3 == 0, "train"))


@query("SELECT vec_id AS row, i - 1 AS col, round(embedding[i]::DOUBLE + 1e-9, 6) AS weight FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] <> 0")
def atomize_dense(spark, sf_dir):
    return atomize.dense_columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("row", F.col("col").cast("long").alias("col"), rounded("weight").alias("weight"))


@query("SELECT s_suppkey AS nid, 'supplier' AS slot, s_suppkey AS col, 1.0::DOUBLE AS val FROM supplier")
def identity_features(spark, sf_dir):
    return features.identity(commerce(spark, sf_dir).nodes["supplier"], "supplier").withColumn("col", F.col("col").cast("long"))


@query("SELECT c_custkey AS nid, 'customer' AS slot, 3::BIGINT AS col, 1.0::DOUBLE AS val FROM customer")
def type_features(spark, sf_dir):
    return features.type_one_hot(commerce(spark, sf_dir).nodes["customer"], "customer", 3).withColumn("col", F.col("col").cast("long"))


@query("SELECT s_suppkey AS nid, c AS col, round(-1 + 2 * (('0x' || substr(md5(s_suppkey || '-' || c || '-42'), 1, 8))::BIGINT / 4294967296.0) + 1e-9, 6) AS val FROM supplier, range(0, 4) AS t(c)")
def uniform_features(spark, sf_dir):
    kind = features.Kind.parse("u(4, -1, 1, 42)")
    f = features.of_kind(kind, commerce(spark, sf_dir).nodes["supplier"], "supplier", 0)
    return f.select("nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))


@query(
    """WITH s AS (SELECT p_size AS c, count(*) AS n FROM part GROUP BY 1) SELECT c::BIGINT AS col FROM s WHERE n > 40"""
)
def popular_columns(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.col("p_size").alias("col"), F.lit(1.0).alias("val"))
    return features.popular(cells, threshold=40).select(F.col("col").cast("long").alias("col"))


# ---- propagation

_BRAND_FEATS = f"{_BRANDS}, x AS (SELECT nid, nid AS col, 1.0 AS val FROM brands)"


@query(
    f"""WITH {_CONTAINS}, {_BRANDS}, p AS (SELECT p_partkey AS nid, nid AS col FROM part JOIN brands USING (p_brand)), d AS (SELECT src, count(*) AS d FROM contains_ GROUP BY 1)
    SELECT c.src AS nid, p.col, round(sum(c.w) / any_value(d.d) + 1e-9, 6) AS val FROM contains_ c JOIN p ON c.dst = p.nid JOIN d ON d.src = c.src GROUP BY 1, 2"""
)
def prop_mean(spark, sf_dir):
    g = commerce(spark, sf_dir)
    parts = propagate.along(g, features.identity(g.nodes["brand"], "brand"), ["brand-of"], "mean")
    return propagate.along(g, parts, ["in-order"], "mean").select("nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))


@query(
    """WITH v AS (SELECT c_nationkey AS nid, c_acctbal AS x, c_custkey AS k FROM customer WHERE c_acctbal <> 0)
    SELECT nid::BIGINT AS nid, round(x + 1e-9, 6) AS val FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY abs(x) DESC, k) AS r FROM v) WHERE r = 1"""
)
def prop_absmax(spark, sf_dir):
    g = commerce(spark, sf_dir)
    feats = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), F.lit("bal").alias("slot"), F.lit(0).alias("col"), F.col("c_acctbal").alias("val"))
    edges = g.edge("lives-in").withColumn("eid", F.col("src"))
    return linalg.reduce_absmax(linalg.messages(edges, feats)).select("nid", rounded("val").alias("val"))


@query(f"WITH {_CONTAINS}, {_BRANDS} SELECT o_custkey AS nid, nid AS col, round(sum(w) + 1e-9, 6) AS val FROM orders JOIN contains_ ON o_orderkey = src JOIN part ON dst = p_partkey JOIN brands USING (p_brand) GROUP BY 1, 2")
def prop_sum_metapath(spark, sf_dir):
    g = commerce(spark, sf_dir)
    out = propagate.along(g, features.identity(g.nodes["brand"], "brand"), ["brand-of", "in-order", "placed-by"], "sum")
    return out.select("nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))


@query(
    """WITH n AS (SELECT n_nationkey AS nid, n_regionkey AS col FROM nation)
    SELECT 'region' AS ntype, r_regionkey::BIGINT AS nid, r_regionkey::BIGINT AS col, 1.0::DOUBLE AS val FROM region UNION ALL SELECT 'nation', nid, col, 1.0 FROM n
    UNION ALL SELECT 'customer', c_custkey, col, 1.0 FROM customer JOIN n ON c_nationkey = nid UNION ALL SELECT 'supplier', s_suppkey, col, 1.0 FROM supplier JOIN n ON s_nationkey = nid"""
)
def slot_propagate_all(spark, sf_dir):
    g = commerce(spark, sf_dir)
    g = g.of_meta(type(g.meta)(("region", "nation", "customer", "supplier"), tuple(g.meta.canonical(e) for e in ("has-nation", "home-of", "base-of"))))
    out = None
    for n, f in propagate.slots(g, {"region": features.identity(g.nodes["region"], "region")}).items():
        part = f.select(F.lit(n).alias("ntype"), "nid", F.col("col").cast("long").alias("col"), "val")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_BRANDS}, t AS (SELECT p_partkey AS nid, nid AS col, 1.0::DOUBLE AS val FROM part JOIN brands USING (p_brand) UNION ALL SELECT p_partkey, (SELECT count(*) FROM brands) + p_size, 1.0 FROM part) SELECT nid, col, val FROM t"""
)
def tabular_export(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    g = commerce(spark, sf_dir)
    brand = propagate.along(g, features.identity(g.nodes["brand"], "brand"), ["brand-of"])
    size = parts.select(F.col("p_partkey").alias("nid"), F.lit("size").alias("slot"), F.col("p_size").alias("col"), F.lit(1.0).alias("val"))
    return features.concatenated(brand.unionByName(size), ["brand", "size"]).withColumn("col", F.col("col").cast("long"))


# ---- metapaths

_STEPS = """pb AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders), pl AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders),
    co AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), io AS (SELECT dst AS src, src AS dst FROM co)"""


def _walks(spark: SparkSession, sf_dir: str, walks) -> DataFrame:
    """(path, n): instances of each walk among customers, orders and parts; walks share their prefixes."""
    g = commerce(spark, sf_dir)
    g = g.of_meta(type(g.meta)(("customer", "order", "part"), tuple(g.meta.canonical(e) for e in ("places", "placed-by", "contains", "in-order"))))
    out = None
    for path, n in propagate.walk_counts(g, walks(g.meta)).items():
        part = n.select(F.lit(">".join(c.etype for c in path)).alias("path"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {_STEPS} SELECT 'customer-self' AS path, count(*) AS n FROM customer UNION ALL SELECT 'order-self>placed-by', count(*) FROM pb
    UNION ALL SELECT 'customer-self>places>placed-by', count(*) FROM pl a JOIN pb b ON a.dst = b.src UNION ALL SELECT 'part-self>in-order>placed-by', count(*) FROM io a JOIN pb b ON a.dst = b.src
    UNION ALL SELECT 'order-self>placed-by>places>placed-by', count(*) FROM pb a JOIN pl b ON a.dst = b.src JOIN pb c ON b.dst = c.src
    UNION ALL SELECT 'order-self>contains>in-order>placed-by', count(*) FROM co a JOIN io b ON a.dst = b.src JOIN pb c ON b.dst = c.src"""
)
def enumerate_metapaths(spark, sf_dir):
    """Every metapath of at most three hops to the customer, with the number of its instances."""
    return _walks(spark, sf_dir, lambda meta: meta.metapaths(3, "customer"))


@query(
    f"""WITH {_STEPS} SELECT 'places>placed-by' AS path, count(*) AS n FROM pl a JOIN pb b ON a.dst = b.src
    UNION ALL SELECT 'places>contains>in-order>placed-by', count(*) FROM pl a JOIN co b ON a.dst = b.src JOIN io c ON b.dst = c.src JOIN pb d ON c.dst = d.src"""
)
def simple_metapaths(spark, sf_dir):
    """Closed metapaths from the customer that use an edge type once at most, with the number of their instances."""
    return _walks(spark, sf_dir, lambda meta: meta.simple_metapaths("customer", 4))


@query(
    f"""WITH {_CONTAINS}, {_IN_ORDER}, {_PLACED_BY}, {_BRANDS},
    n1 AS (SELECT in_order.dst, nid AS col, sum(w) AS val FROM in_order JOIN part ON src = p_partkey JOIN brands USING (p_brand) GROUP BY 1, 2)
    SELECT 'customer' AS ntype, placed_by.dst AS nid, col, round(sum(w * val) + 1e-9, 6) AS val FROM placed_by JOIN n1 ON src = n1.dst GROUP BY 2, 3
    UNION ALL SELECT 'order', dst, col, round(val + 1e-9, 6) FROM n1"""
)
def metapath_features(spark, sf_dir):
    """Two metapaths from the brand that share their prefix."""
    g = commerce(spark, sf_dir)
    a, b, c = (g.meta.canonical(e) for e in ("brand-of", "in-order", "placed-by"))
    f = propagate.MetapathFeatures(linalg.row_normalized_adjacencies(g.edges, {a, b, c}), {"brand": features.identity(g.nodes["brand"], "brand")})
    made = f.build([(a, b, c), (a, b)])
    out = None
    for path, df in made.items():
        part = df.select(F.lit(path[-1].dst).alias("ntype"), "nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))
        out = part if out is None else out.unionByName(part)
    return out


_NATION_LOOP = "home AS (SELECT c_nationkey AS dst, c_custkey AS src, 1.0 / count(*) OVER (PARTITION BY c_nationkey) AS w FROM customer), loop AS (SELECT c.c_custkey AS dst, h.src, h.w FROM customer c JOIN home h ON c.c_nationkey = h.dst)"


@query(
    f"""WITH {_CUSTOMERS}, {_NATION_LOOP} SELECT loop.dst AS nid, label AS col, round(sum(w) + 1e-9, 6) AS val FROM loop JOIN customers ON loop.src = nid WHERE split = 'train' AND loop.dst <> loop.src GROUP BY 1, 2"""
)
def label_propagate_no_leak(spark, sf_dir):
    g = commerce(spark, sf_dir)
    path = tuple(g.meta.canonical(e) for e in ("lives-in", "home-of"))
    out = propagate.label_features(linalg.row_normalized_adjacencies(g.edges, set(path)), (path[0], path[1]), propagate.training_labels(g.nodes["customer"]))
    return out.select("nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))


@query(f"WITH {_CONTAINS}, {_IN_ORDER}, back AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM contains_) SELECT a.dst AS nid, round(sum(a.w * b.w) + 1e-9, 6) AS w FROM in_order a JOIN back b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def metapath_diag(spark, sf_dir):
    g = commerce(spark, sf_dir)
    path = tuple(g.meta.canonical(e) for e in ("contains", "in-order"))
    return propagate.metapath_diagonal(linalg.row_normalized_adjacencies(g.edges, set(path)), path).select("nid", rounded("w").alias("w"))


@query("SELECT DISTINCT b.s_suppkey AS dst, a.s_suppkey AS src FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def metapath_pattern_graph(spark, sf_dir):
    return propagate.metapath_pattern(commerce(spark, sf_dir), [["based-in", "base-of"]])


@query(
    """WITH e AS (SELECT 'order-' || l_orderkey AS src, 'part-' || l_partkey AS dst FROM lineitem UNION SELECT 'part-' || p_partkey, 'brand-' || p_brand FROM part
    UNION SELECT 'order-' || o_orderkey, 'customer-' || o_custkey FROM orders UNION SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
    UNION SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation) SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst"""
)
def nhop_pairs_all(spark, sf_dir):
    """Over whole tables and ids as they are; two hops end at brands, nations and regions, so pairs grow with the lines."""
    steps = (
        ("lineitem", "order", "l_orderkey", "part", "l_partkey"),
        ("part", "part", "p_partkey", "brand", "p_brand"),
        ("orders", "order", "o_orderkey", "customer", "o_custkey"),
        ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
        ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
    )
    out = None
    for name, a, src, b, dst in steps:
        part = table(spark, sf_dir, name).select(F.concat(F.lit(f"{a}-"), F.col(src)).alias("src"), F.concat(F.lit(f"{b}-"), F.col(dst)).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return linalg.within_hops(out, 2)


@query("SELECT r_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b, s_suppkey AS c FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def path_instances(spark, sf_dir):
    g = commerce(spark, sf_dir)
    p = linalg.path_instances([g.edge("has-nation"), g.edge("base-of")])
    return p.select(*(F.get("path", i).alias(c) for i, c in enumerate("abc")))


# ---- splits, negatives, neighbours

@query("WITH n AS (SELECT count(*) // 5 AS k FROM orders), l AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders) SELECT o_orderkey, CASE WHEN line_no < k THEN 'val' ELSE 'train' END AS split FROM l, n")
def split_first_lines(spark, sf_dir):
    o = atomize.dense_ids(table(spark, sf_dir, "orders"), "o_orderkey").withColumnRenamed("nid", "line_no")
    return sample.split_first_lines(o).select("o_orderkey", "split")


@query(
    f"""WITH {_BUYS} SELECT src, dst, CASE WHEN dst = min(dst) OVER (PARTITION BY src) OR ('0x' || substr(md5(src || '-' || dst || '-7'), 1, 8))::BIGINT / 4294967296.0 < 0.9 THEN 'train' ELSE 'val' END AS split FROM buys"""
)
def split_links(spark, sf_dir):
    return sample.split_links(buys(spark, sf_dir), 0.9, 7).select("src", "dst", "split")


_REGION_LINKS = "l AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation UNION SELECT 1000 + s_suppkey, s_nationkey FROM supplier)"


@query(
    f"""WITH {_REGION_LINKS}, b AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM l UNION SELECT dst, src FROM l)
    SELECT DISTINCT x.src, y.dst FROM b x JOIN b y ON x.dst = y.src WHERE x.src >= 1000 AND x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM b z WHERE z.src = x.src AND z.dst = y.dst)"""
)
def two_hop_negative_candidates(spark, sf_dir):
    g = commerce(spark, sf_dir)
    links = g.edge("part-of").select("src", (F.col("dst") + 100).alias("dst")).union(g.edge("based-in").select((F.col("src") + 1000).alias("src"), "dst"))
    return sample.two_hop_candidates(links, links.where("src >= 1000"))


@query(
    """WITH s AS (SELECT s_suppkey AS src, s_nationkey AS n FROM supplier), two AS (SELECT DISTINCT a.src, b.src AS dst FROM s a JOIN s b USING (n)), direct AS (SELECT src, src AS dst FROM s)
    SELECT src, dst FROM two EXCEPT SELECT src, dst FROM direct"""
)
def nhop_negative_candidates(spark, sf_dir):
    g = commerce(spark, sf_dir)
    supplier = g.nodes["supplier"].select(F.col("nid").alias("src"), F.col("nid").alias("dst"))
    return sample.n_hop_candidates([supplier, [g.edge("based-in"), g.edge("base-of")]], supplier)


@query(
    f"""WITH {_CUSTOMERS} SELECT nid, (row_number() OVER (PARTITION BY label ORDER BY md5(nid || '-3'), nid) - 1) % 5 AS fold FROM customers WHERE split IN ('train', 'val')"""
)
def kfold_assign(spark, sf_dir):
    rows = commerce(spark, sf_dir).nodes["customer"].where("split in ('train', 'val')")
    return sample.k_folds(rows, 5, F.col("label"), "nid", 3).select("nid", "fold")


@query(
    """SELECT src, dst FROM (SELECT c_custkey AS src, c_nationkey::BIGINT AS dst, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '-' || c_nationkey || '-5'), c_custkey) AS r FROM customer) WHERE r <= 4"""
)
def neighbor_sample_all(spark, sf_dir):
    g = commerce(spark, sf_dir)
    return sample.neighbours(g.edge("lives-in"), g.nodes["nation"], 4, 5).select("src", "dst")


@query(
    """SELECT 'placed-by' AS etype, o_orderkey AS src, o_custkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT DISTINCT 'in-order', l_partkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""
)
def full_neighbor_blocks_all(spark, sf_dir):
    """Seeded with all customers."""
    g = commerce(spark, sf_dir)
    keep = tuple(g.meta.canonical(e) for e in ("placed-by", "in-order"))
    g = g.of_meta(type(g.meta)(("customer", "order", "part"), keep))
    blocks, _ = sample.layers(g, {"customer": g.nodes["customer"]}, [-1, -1])
    out = None
    for c, e in blocks[0].items():
        part = e.select(F.lit(c.etype).alias("etype"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH b AS (SELECT DISTINCT o_orderkey // 64 AS b FROM orders), o AS (SELECT b, row_number() OVER (ORDER BY md5(b || '-9'), b) - 1 AS o FROM b)
    SELECT o_orderkey, ((o * 64 + o_orderkey % 64) // 256)::BIGINT AS batch FROM orders JOIN o ON o_orderkey // 64 = b"""
)
def block_shuffle(spark, sf_dir):
    return sample.block_shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64, 256, 9)


# ---- evaluation

@query(
    f"""WITH {_BUYS}, {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
    SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)) + 1e-9, 6) AS auc FROM r"""
)
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scored(spark, sf_dir)).select(rounded("auc").alias("auc"))


@query(
    f"""WITH {_BUYS}, {_SCORED}, r AS (SELECT src, y, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM scored),
    h AS (SELECT src, sum(y) AS n, min(r) FILTER (y = 1) AS first, sum(y / r) AS rr, sum(y / log2(1 + r)) AS dcg FROM r GROUP BY src HAVING sum(y) > 0),
    i AS (SELECT src, sum(1.0 / k) AS ir, sum(1.0 / log2(1 + k)) AS idcg FROM (SELECT src, unnest(range(1, n::BIGINT + 1)) AS k FROM h) GROUP BY src)
    SELECT round(avg(1.0 / first) + 1e-9, 6) AS mrr, round(avg(rr / n) + 1e-9, 6) AS amrr, round(avg(rr / ir) + 1e-9, 6) AS nmrr, round(avg(dcg / idcg) + 1e-9, 6) AS ndcg FROM h JOIN i USING (src)"""
)
def ranking_metrics(spark, sf_dir):
    return evaluate.ranking(scored(spark, sf_dir), ["src"]).select(*(rounded(c).alias(c) for c in ("mrr", "amrr", "nmrr", "ndcg")))


@query(
    f"""WITH {_CUSTOMERS}, {_PREDICTED}, c AS (SELECT DISTINCT pred AS cls FROM predicted UNION SELECT y FROM predicted),
    k AS (SELECT cls, count(*) FILTER (pred = cls AND y = cls) AS tp, count(*) FILTER (pred = cls AND y <> cls) AS fp, count(*) FILTER (pred <> cls AND y = cls) AS fn FROM c, predicted GROUP BY cls)
    SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) + 1e-9, 6) AS micro_f1, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) + 1e-9, 6) AS macro_f1 FROM k"""
)
def f1_single_label(spark, sf_dir):
    return evaluate.f1_single(predicted(spark, sf_dir)).select(rounded("micro_f1").alias("micro_f1"), rounded("macro_f1").alias("macro_f1"))


_LOGITS = "g AS (SELECT vec_id AS nid, cls, (vec_id * 37 + cls * 101) % 17 / 4.0 - 2 AS logit, label FROM embeddings, range(0, 10) AS t(cls))"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nid, cls, logit, label) with logits that are multiples of a quarter."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("nid"), "label", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cls"))
    return e.select("nid", F.col("cls").cast("long").alias("cls"), (F.pmod(F.col("nid") * 37 + F.col("cls") * 101, F.lit(17)) / 4.0 - 2).alias("logit"), F.col("label").cast("long").alias("label"))


@query(
    f"""WITH {_LOGITS}, k AS (SELECT cls, count(*) FILTER (logit > 0 AND (label = cls OR label = cls + 1)) AS tp, count(*) FILTER (logit > 0 AND NOT (label = cls OR label = cls + 1)) AS fp,
    count(*) FILTER (logit <= 0 AND (label = cls OR label = cls + 1)) AS fn FROM g GROUP BY cls)
    SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) + 1e-9, 6) AS micro_f1, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) + 1e-9, 6) AS macro_f1 FROM k"""
)
def f1_multi_label(spark, sf_dir):
    y = F.when((F.col("label") == F.col("cls")) | (F.col("label") == F.col("cls") + 1), 1).otherwise(0)
    return evaluate.f1_multi(logits(spark, sf_dir).withColumn("y", y)).select(rounded("micro_f1").alias("micro_f1"), rounded("macro_f1").alias("macro_f1"))


@query(
    f"""WITH {_BUYS}, {_SCORED}, t AS (SELECT k, k * 50.0 AS threshold FROM range(0, 21) AS x(k)),
    c AS (SELECT k, threshold, count(*) FILTER (score > threshold AND y = 1) AS tp, count(*) FILTER (score > threshold AND y = 0) AS fp, count(*) FILTER (score <= threshold AND y = 1) AS fn FROM t, scored GROUP BY 1, 2)
    SELECT k, threshold::DOUBLE AS threshold, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) + 1e-9, 6) AS f1 FROM c"""
)
def threshold_grid(spark, sf_dir):
    return evaluate.threshold_grid(scored(spark, sf_dir), 20, 0.0, 1000.0).select("k", "threshold", rounded("f1").alias("f1"))


@query(f"WITH {_CUSTOMERS}, {_PREDICTED} SELECT round(avg((pred = y)::INT) + 1e-9, 6) AS accuracy FROM predicted")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(predicted(spark, sf_dir)).select(rounded("accuracy").alias("accuracy"))


@query(f"WITH {_LOGITS} SELECT nid, cls AS pred FROM (SELECT nid, cls, row_number() OVER (PARTITION BY nid ORDER BY logit DESC, cls) AS r FROM g) WHERE r = 1")
def argmax_class(spark, sf_dir):
    return evaluate.argmax_class(logits(spark, sf_dir))


@query(f"WITH {_LOGITS}, p AS (SELECT nid, cls, exp(logit) / sum(exp(logit)) OVER (PARTITION BY nid) AS p FROM g) SELECT nid, pred, round(p + 1e-9, 6) AS p FROM (SELECT nid, cls AS pred, p, row_number() OVER (PARTITION BY nid ORDER BY p DESC, cls) AS r FROM p) WHERE r = 1 AND p > 0.3")
def pseudo_labels(spark, sf_dir):
    return evaluate.pseudo_labels(logits(spark, sf_dir), 0.3).select("nid", "pred", rounded("p").alias("p"))


@query(f"WITH {_LOGITS}, p AS (SELECT nid, cls, exp(logit) / sum(exp(logit)) OVER (PARTITION BY nid) AS p FROM g) SELECT nid, cls::BIGINT AS col, round(p + 1e-9, 6) AS val FROM p WHERE p >= 0.2")
def refreshed_labels(spark, sf_dir):
    return evaluate.refreshed_labels(logits(spark, sf_dir), 0.2).select("nid", F.col("col").cast("long").alias("col"), rounded("val").alias("val"))


_PART_ROW = "[p_size::DOUBLE, p_retailprice / 100, length(p_name)::DOUBLE, length(p_type)::DOUBLE]"


@query(f"SELECT p_partkey AS nid, i - 1 AS col, round(coalesce((r[i] - list_avg(r)) / nullif(list_stddev_samp(r), 0), 0) + 1e-9, 6) AS z FROM (SELECT p_partkey, {_PART_ROW} AS r, unnest(range(1, 5)) AS i FROM part)")
def row_z_score(spark, sf_dir):
    row = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.length("p_name").cast("double"), F.length("p_type").cast("double"))
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.posexplode(vectors.z_scored(row)).alias("col", "z"))
    return cells.select("nid", F.col("col").cast("long").alias("col"), rounded("z").alias("z"))


@query("SELECT c_custkey AS nid, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE c_acctbal * 0.01 * (1 + c_nationkey) END + 1e-9, 6) AS x FROM customer")
def prelu_by_nation(spark, sf_dir):
    slope = (F.col("c_nationkey") + 1) * 0.01
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), rounded(vectors.prelu(F.col("c_acctbal"), slope)).alias("x"))


@query(f"WITH {_LOGITS} SELECT round(avg(l) + 1e-9, 6) AS loss FROM (SELECT nid, ln(sum(exp(logit))) - max(logit) FILTER (cls = label) AS l FROM g GROUP BY nid)")
def cross_entropy_loss(spark, sf_dir):
    return evaluate.cross_entropy(logits(spark, sf_dir).withColumnRenamed("label", "y")).select(rounded("loss").alias("loss"))


_ALL_CO_NATION = "pairs AS (SELECT a.c_custkey AS dst, b.c_custkey AS src FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey WHERE a.c_custkey <> b.c_custkey)"


def _all_co_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce(spark, sf_dir)
    return evaluate.co_member_homophily(g.edge("lives-in").select(F.col("src").alias("nid"), F.col("dst").alias("mid")), g.nodes["customer"])


@query(f"WITH {_CUSTOMERS}, {_ALL_CO_NATION} SELECT round(avg(h) + 1e-9, 6) AS homophily FROM (SELECT dst, avg((a.label = b.label)::INT) AS h FROM pairs JOIN customers a ON dst = a.nid JOIN customers b ON src = b.nid GROUP BY dst)")
def node_homophily_all(spark, sf_dir):
    return _all_co_nation(spark, sf_dir).select(rounded("node").alias("homophily"))


@query(f"WITH {_CUSTOMERS}, {_ALL_CO_NATION} SELECT round(avg((a.label = b.label)::INT) + 1e-9, 6) AS homophily FROM pairs JOIN customers a ON dst = a.nid JOIN customers b ON src = b.nid")
def edge_homophily_all(spark, sf_dir):
    return _all_co_nation(spark, sf_dir).select(rounded("edge").alias("homophily"))


# ---- runs

_RUNS = "r AS (SELECT p_brand AS profile, p_partkey AS run, p_retailprice AS value FROM part)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("profile"), F.col("p_partkey").alias("run"), F.col("p_retailprice").alias("value"))


@query(f"WITH {_RUNS} SELECT profile, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, round(stddev_samp(value) + 1e-9, 6) AS std FROM r GROUP BY 1")
def runs_mean_std(spark, sf_dir):
    return runs.mean_std(_runs(spark, sf_dir), ["profile"], "value").select("profile", "n", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(f"WITH {_RUNS} SELECT profile, run, round(avg(value) OVER w + 1e-9, 4) AS mean, round(stddev_pop(value) OVER w + 1e-9, 4) AS std FROM r WINDOW w AS (PARTITION BY profile ORDER BY run ROWS UNBOUNDED PRECEDING)")
def running_mean_std(spark, sf_dir):
    out = runs.running_mean_std(_runs(spark, sf_dir), ["profile"], "run", "value")
    return out.select("profile", "run", F.round(F.col("mean") + 1e-9, 4).alias("mean"), F.round(F.col("std") + 1e-9, 4).alias("std"))


@query(f"WITH {_RUNS} SELECT run, value FROM r ORDER BY value DESC, run LIMIT 10")
def topk_trials(spark, sf_dir):
    return runs.top(_runs(spark, sf_dir), "value", 10, "run").select("run", "value")


@query(f"WITH {_RUNS} SELECT profile, run FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY run) AS k FROM r) WHERE k <= 5")
def first_n_per_profile(spark, sf_dir):
    return runs.first_rows(_runs(spark, sf_dir), ["profile"], "run", 5).select("profile", "run")


_HISTORY = "h AS (SELECT p_brand AS run, p_partkey AS epoch, p_size::DOUBLE AS value FROM part)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("epoch"), F.col("p_size").cast("double").alias("value"))


@query(
    f"""WITH {_HISTORY}, a AS (SELECT *, row_number() OVER w AS i, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
    c AS (SELECT *, least(value, coalesce(b, value)) AS best, i - max(CASE WHEN b IS NULL OR value < b THEN i END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM a)
    SELECT run, epoch, best, waited, coalesce(i = min(CASE WHEN waited >= 10 THEN i END) OVER (PARTITION BY run), false) AS stop FROM c"""
)
def early_stopping(spark, sf_dir):
    return runs.early_stopping(_history(spark, sf_dir), ["run"], 10).select("run", "epoch", "best", "waited", "stop")


@query(
    """WITH h AS (SELECT p_brand AS run, p_partkey AS epoch, p_size::DOUBLE AS a, p_retailprice AS b FROM part), m AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY a, epoch) AS r FROM h)
    SELECT run, epoch, 'a' AS tag, a AS value FROM m WHERE r = 1 UNION ALL SELECT run, epoch, 'b', b FROM m WHERE r = 1"""
)
def best_scalars(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    h = p.select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("epoch"), F.expr("stack(2, 'a', cast(p_size as double), 'b', p_retailprice) as (tag, value)"))
    return runs.best_scalars(h, ["run"], "a")


@query("SELECT p_partkey AS nid, dense_rank() OVER (ORDER BY p_brand, p_size) - 1 AS id FROM part")
def dense_reindex(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), F.col("p_brand").alias("tree"), F.col("p_size").alias("leaf"))
    return runs.reindexed(p).select("nid", "id")


@query(
    f"""WITH {_CUSTOMERS} SELECT 'customer' AS ntype, label, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM customers GROUP BY label"""
)
def graph_info(spark, sf_dir):
    c = commerce(spark, sf_dir).nodes["customer"]
    return c.groupBy("label").agg(F.count("*").alias("n"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test"))).select(F.lit("customer").alias("ntype"), "label", "n", "train", "val", "test")


@query("SELECT 'supplies' AS etype, round(count(*) / (SELECT count(*) FROM supplier)::DOUBLE + 1e-9, 6) AS mean_out, round(count(*) / (SELECT count(*) FROM part)::DOUBLE + 1e-9, 6) AS mean_in FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def mean_degrees(spark, sf_dir):
    g = commerce(spark, sf_dir)
    n = g.edge("supplies").agg(F.count("*").alias("n"))
    a, b = (g.nodes[t].agg(F.count("*").alias(k)) for t, k in (("supplier", "a"), ("part", "b")))
    one = n.crossJoin(a).crossJoin(b)  # one row each
    return one.select(F.lit("supplies").alias("etype"), rounded(F.col("n") / F.col("a")).alias("mean_out"), rounded(F.col("n") / F.col("b")).alias("mean_in"))


# ---- layers

@query(f"WITH {_SUPPLIES} SELECT dst, src, round(exp(w - max(w) OVER p) / sum(exp(w - 20)) OVER p * exp(max(w) OVER p - 20) + 1e-9, 6) AS a FROM supplies WINDOW p AS (PARTITION BY dst)")
def edge_softmax(spark, sf_dir):
    e = commerce(spark, sf_dir).edge("supplies")
    return evaluate.softmax(e, ["dst"], "weight", "a").select("dst", "src", rounded("a").alias("a"))


@query("SELECT vec_id, i - 1 AS i, round(embedding[i] / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) + 1e-9, 6) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalized(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), rounded("x").alias("x"))


_EMB_PAIRS = "p AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings))"


def _pairs(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("nid"), F.col("embedding").alias("h"))
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    return e, e.crossJoin(n).select(F.col("nid").alias("src"), F.pmod(F.col("nid") * 7 + 1, F.col("n")).alias("dst"))  # one row


@query(f"WITH {_EMB_PAIRS} SELECT src, dst, round(list_sum(list_transform(range(1, 65), lambda i: x[i]::DOUBLE * y[i]::DOUBLE)) + 1e-9, 5) AS score FROM p")
def dot_decoder(spark, sf_dir):
    e, p = _pairs(spark, sf_dir)
    return layers.pair_scores(p, e, e).select("src", "dst", F.round(F.col("score") + 1e-9, 5).alias("score"))


@query(f"WITH {_EMB_PAIRS} SELECT src, dst, round(list_sum(list_transform(range(1, 65), lambda i: x[i]::DOUBLE * y[i]::DOUBLE * (i % 3 - 1))) + 1e-9, 5) AS score FROM p")
def bilinear_decoder(spark, sf_dir):
    """A relation's diagonal bilinear form."""
    e, p = _pairs(spark, sf_dir)
    w = [[float((i + 1) % 3 - 1) if i == j else 0.0 for j in range(64)] for i in range(64)]
    return layers.pair_scores(p, e, e, lambda a, b: vectors.bilinear(a, w, b)).select("src", "dst", F.round(F.col("score") + 1e-9, 5).alias("score"))


_VEC = "v AS (SELECT c_custkey AS nid, [c_acctbal / 1000, (c_custkey % 7)::DOUBLE] AS h FROM customer)"


def _customer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), F.array(F.col("c_acctbal") / 1000, (F.col("c_custkey") % 7).cast("double")).alias("h"))


@query(
    """WITH c AS (SELECT c_nationkey::BIGINT AS nid, avg(c_acctbal / 1000) AS x FROM customer GROUP BY 1), s AS (SELECT s_nationkey::BIGINT AS nid, avg(s_acctbal / 1000) AS y FROM supplier GROUP BY 1)
    SELECT nid, round(coalesce(x * exp(1) / (exp(1) + exp(2)), 0) + coalesce(y * exp(2) / (exp(1) + exp(2)), 0) + 1e-9, 6) AS x FROM c FULL JOIN s USING (nid)"""
)
def srgcn_layer(spark, sf_dir):
    g = commerce(spark, sf_dir)
    a, b = g.meta.canonical("lives-in"), g.meta.canonical("based-in")
    nodes = {"customer": _customer_vectors(spark, sf_dir).select("nid", F.slice("h", 1, 1).alias("h")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("nid"), F.array(F.col("s_acctbal") / 1000).alias("h"))}
    return layers.srgcn_conv({a: g.edges[a], b: g.edges[b]}, nodes, {a: 1.0, b: 2.0}, "nation").select("nid", rounded(F.get("h", 0)).alias("x"))


_RING = "e AS (SELECT c_custkey AS src, (c_custkey * 3 + 1) % n AS dst FROM customer, (SELECT count(*) AS n FROM customer) UNION ALL SELECT c_custkey, (c_custkey * 5 + 2) % n FROM customer, (SELECT count(*) AS n FROM customer)), f AS (SELECT e.* FROM e JOIN customer ON dst = c_custkey)"


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    both = c.crossJoin(n).select("src", F.explode(F.array(F.pmod(F.col("src") * 3 + 1, F.col("n")), F.pmod(F.col("src") * 5 + 2, F.col("n")))).alias("dst"))  # one row
    return both.join(c.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


@query(
    f"""WITH {_RING}, {_VEC}, s AS (SELECT f.src, f.dst, 0.5 * a.h[1] - 0.25 * a.h[2] + 0.125 * b.h[1] + 0.5 * b.h[2] AS z, a.h FROM f JOIN v a ON f.src = a.nid JOIN v b ON f.dst = b.nid),
    x AS (SELECT *, CASE WHEN z >= 0 THEN z ELSE 0.2 * z END AS l FROM s), w AS (SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY dst) AS a FROM x)
    SELECT dst AS nid, round(sum(a * h[1]) + 1e-9, 6) AS x, round(sum(a * h[2]) + 1e-9, 6) AS y FROM w GROUP BY 1"""
)
def gat_layer(spark, sf_dir):
    return layers.gat_conv(_ring(spark, sf_dir), _customer_vectors(spark, sf_dir), [0.5, -0.25], [0.125, 0.5]).select("nid", rounded(F.get("h", 0)).alias("x"), rounded(F.get("h", 1)).alias("y"))


@query(
    f"""WITH {_RING}, {_VEC}, w AS (SELECT src, dst, CASE WHEN (src + dst) % 2 = 0 THEN 1.5 ELSE 0.5 END AS w FROM f), a AS (SELECT src, greatest(sum(w), 1) AS d FROM w GROUP BY 1), b AS (SELECT dst, greatest(sum(w), 1) AS d FROM w GROUP BY 1)
    SELECT w.dst AS nid, round(sum(w.w * h[1] / sqrt(a.d) / sqrt(b.d)) + 1e-9, 6) AS x, round(sum(w.w * h[2] / sqrt(a.d) / sqrt(b.d)) + 1e-9, 6) AS y
    FROM w JOIN a ON a.src = w.src JOIN b ON b.dst = w.dst JOIN v ON v.nid = w.src GROUP BY 1"""
)
def regcn_layer(spark, sf_dir):
    e = _ring(spark, sf_dir).withColumn("etype", F.pmod(F.col("src") + F.col("dst"), F.lit(2)).cast("int"))
    return layers.regcn_conv(e, _customer_vectors(spark, sf_dir), {0: 1.5, 1: 0.5}).select("nid", rounded(F.get("h", 0)).alias("x"), rounded(F.get("h", 1)).alias("y"))


@query(
    f"""WITH {_VEC}, p AS (SELECT 'a' AS mp, nid, h[1] AS x, h[2] AS y FROM v UNION ALL SELECT 'b', nid, h[2], h[1] FROM v), s AS (SELECT mp, avg(tanh(0.1 * x) - 0.5 * tanh(0.2 * y)) AS s FROM p GROUP BY 1),
    b AS (SELECT mp, exp(s) / (SELECT sum(exp(s)) FROM s) AS b FROM s) SELECT nid, round(sum(b * x) + 1e-9, 6) AS x, round(sum(b * y) + 1e-9, 6) AS y FROM p JOIN b USING (mp) GROUP BY 1"""
)
def semantic_attention(spark, sf_dir):
    v = _customer_vectors(spark, sf_dir)
    paths = v.withColumn("mp", F.lit("a")).unionByName(v.select("nid", F.reverse("h").alias("h"), F.lit("b").alias("mp")))
    return layers.semantic_attention(paths, [[0.1, 0.0], [0.0, 0.2]], [1.0, -0.5]).select("nid", rounded(F.get("h", 0)).alias("x"), rounded(F.get("h", 1)).alias("y"))


# ---- refinement and sources

@query("SELECT c_custkey AS nid, 'nation' AS slot, c_nationkey::BIGINT AS col, 1.0::DOUBLE AS val FROM customer")
def schema_refinement(spark, sf_dir):
    """Nations as features of customers; then the edges between customers and nations go, features stay."""
    g = commerce(spark, sf_dir)
    g = g.of_meta(type(g.meta)(("customer", "nation", "order"), tuple(g.meta.canonical(e) for e in ("home-of", "lives-in", "placed-by", "places")), {k: v for k, v in g.inverse.items() if k.etype in ("home-of", "lives-in", "placed-by", "places")}))
    left, feats = refined(g, Selection.of(g, {"nation": True, "home-of": False}))
    assert "nation" not in left.nodes
    return feats["customer"].withColumn("col", F.col("col").cast("long"))


@query("SELECT l_orderkey AS src, l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def stored_rows_all(spark, sf_dir):
    """A stored edge type read back whole."""
    import uuid

    from .scratch import scratch_dir

    g = commerce(spark, sf_dir)
    from dataclasses import replace

    path = f"{scratch_dir(spark)}/hin-{uuid.uuid4().hex}"
    c = CEType("part", "in-order", "order")
    replace(g, nodes=g.nodes.only(("part", "order")), edges={c: g.edges[c]}, inverse={}, target=None).save(path)
    back = type(g).load(spark, path).edge("in-order")
    return back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


# ---- draws of negatives

_DRAW = lambda key, n: f"floor(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0 * {n})::BIGINT"


@query(
    f"""WITH {_BUYS}, n AS (SELECT max(p_partkey) + 1 AS n FROM part), d AS (SELECT src, dst, t, {_DRAW("src || '-' || dst || '-' || t || '-3'", "n")} AS neg FROM buys, n, range(0, 8) AS r(t))
    SELECT src, dst, min_by(neg, t) AS neg FROM d WHERE NOT EXISTS (SELECT 1 FROM buys b WHERE b.src = d.src AND b.dst = d.neg) GROUP BY 1, 2"""
)
def unlinked_negatives(spark, sf_dir):
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    return sample.unlinked_tails(buys(spark, sf_dir), n, 3)


@query(
    f"""WITH {_BUYS}, n AS (SELECT (SELECT max(c_custkey) + 1 FROM customer) AS h, (SELECT max(p_partkey) + 1 FROM part) AS n),
    d AS (SELECT src AS a, dst AS b, t, {_DRAW("src || '-' || dst || '-1-' || t || '-0-3'", "h")} AS src, {_DRAW("src || '-' || dst || '-1-' || t || '-1-3'", "n")} AS dst FROM buys, n, range(0, 8) AS r(t)),
    f AS (SELECT a, b, min_by({{'src': src, 'dst': dst}}, t) AS p FROM d WHERE NOT EXISTS (SELECT 1 FROM buys b WHERE b.src = d.src AND b.dst = d.dst) GROUP BY 1, 2) SELECT p.src AS src, p.dst AS dst FROM f"""
)
def random_negative_pairs(spark, sf_dir):
    h = table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    return sample.random_pairs(buys(spark, sf_dir), h, n, 3)


# ---- networks made ready for models

_ALL_TYPES = """n AS (SELECT 0 AS i, 'customer' AS name, c_custkey::BIGINT AS nid FROM customer UNION ALL SELECT 1, 'nation', n_nationkey FROM nation UNION ALL SELECT 2, 'supplier', s_suppkey FROM supplier),
    w AS (SELECT i, max(nid) + 1 AS width FROM n GROUP BY 1), o AS (SELECT i, coalesce(sum(width) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM w)"""


def _homes(spark: SparkSession, sf_dir: str):
    """Customers, suppliers and nations, and the edges between them."""
    from dataclasses import replace

    g = commerce(spark, sf_dir)
    names = ("customer", "nation", "supplier")
    edges = g.edges.only(c for c in g.edges if c.src in names and c.dst in names)
    return replace(g, nodes=g.nodes.only(names), edges=edges, inverse={a: b for a, b in g.inverse.items() if a in edges})


@query(
    f"""WITH {_ALL_TYPES}, e AS (SELECT 'lives-in' AS t, 0 AS a, c_custkey::BIGINT AS src, 1 AS b, c_nationkey::BIGINT AS dst FROM customer UNION ALL SELECT 'based-in', 2, s_suppkey, 1, s_nationkey FROM supplier
    UNION ALL SELECT 'home-of', 1, c_nationkey, 0, c_custkey FROM customer UNION ALL SELECT 'base-of', 1, s_nationkey, 2, s_suppkey FROM supplier UNION ALL SELECT name || '-self', i, nid, i, nid FROM n)
    SELECT x.first + src AS src, y.first + dst AS dst, 1.0::DOUBLE AS weight, count(*) AS n FROM e JOIN o x ON x.i = a JOIN o y ON y.i = b GROUP BY 1, 2"""
)
def prepared_homogeneous(spark, sf_dir):
    g = _homes(spark, sf_dir)
    _, edges = prepare.homogeneous_for(g, featured=["customer", "nation", "supplier"])
    return edges.groupBy("src", "dst", "weight").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::BIGINT AS dst, s_nationkey::BIGINT AS src, 'base-of' AS etype FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 'based-in' FROM supplier")
def without_featureless_types(spark, sf_dir):
    from dataclasses import replace

    g = prepare.without_featureless(replace(_homes(spark, sf_dir), target="supplier"), ["supplier", "nation"], strict=False)
    parts = [e.select("dst", "src", F.lit(c.etype).alias("etype")) for c, e in g.edges.items()]
    return parts[0].unionByName(parts[1])


_HELD = "(src * 7 + dst * 3) % 10"


@query(
    f"""WITH c AS (SELECT c_custkey::BIGINT AS src, c_nationkey::BIGINT AS dst FROM customer), s AS (SELECT s_suppkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM supplier)
    SELECT 'train' AS part, 'lives-in' AS etype, src, dst FROM c WHERE {_HELD} <> 0 UNION ALL SELECT 'val', 'lives-in', src, dst FROM c WHERE {_HELD} = 0 UNION ALL SELECT 'train', 'based-in', src, dst FROM s"""
)
def val_edges_to_train(spark, sf_dir):
    g = _homes(spark, sf_dir)
    from dataclasses import replace

    forward = g.edges.only(c for c in g.edges if c.etype in ("lives-in", "based-in"))
    held = F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(10)) == 0
    side = lambda keep: replace(g, edges={c: e.where(keep) for c, e in forward.items()}, inverse={})
    train, val = prepare.others_to_train(side(~held), side(held), ["lives-in"])
    parts = [e.select(F.lit(name).alias("part"), F.lit(c.etype).alias("etype"), "src", "dst") for name, graph in (("train", train), ("val", val)) for c, e in graph.edges.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- more losses, homophily, layers and tests of runs

@query(
    f"""WITH {_LOGITS}, y AS (SELECT *, (nid + cls) % 3 = 0 AS y, logit - ln(sum(exp(logit)) OVER (PARTITION BY nid)) AS lp FROM g), p AS (SELECT nid, -sum(y::INT * lp) / nullif(sum(y::INT), 0) AS l FROM y GROUP BY nid)
    SELECT round((SELECT avg(l) FROM p) - 0.1 * (avg(lp) + ln(10)) + 1e-9, 6) AS loss FROM y"""
)
def soft_label_loss(spark, sf_dir):
    cells = logits(spark, sf_dir).withColumn("y", (F.pmod(F.col("nid") + F.col("cls"), F.lit(3)) == 0).cast("int"))
    return evaluate.soft_label_cross_entropy(cells, 0.1).select(rounded("loss").alias("loss"))


@query(
    f"""WITH {_LOGITS}, p AS (SELECT (nid + cls) % 3 = 0 AS y, 1 / (1 + exp(-logit)) AS p FROM g) SELECT round(avg(-CASE WHEN y THEN ln(p) ELSE ln(1 - p) END) - 0.1 * (avg(ln(p) + ln(1 - p)) + ln(4)) + 1e-9, 6) AS loss FROM p"""
)
def binary_loss(spark, sf_dir):
    cells = logits(spark, sf_dir).withColumn("y", (F.pmod(F.col("nid") + F.col("cls"), F.lit(3)) == 0).cast("int"))
    return evaluate.binary_cross_entropy(cells, 0.1).select(rounded("loss").alias("loss"))


@query(
    f"""WITH {_RING}, l AS (SELECT c_custkey AS nid, cls, CASE WHEN cls = 0 THEN c_custkey % 2 ELSE (c_custkey % 3 = 0)::INT END AS y FROM customer, range(0, 2) AS t(cls)), u AS (SELECT DISTINCT src, dst FROM f WHERE src <> dst),
    i AS (SELECT src AS nid FROM u UNION SELECT dst FROM u), s AS (SELECT u.dst AS nid, a.cls, avg((a.y = b.y)::INT) AS h FROM u JOIN l a ON a.nid = u.dst JOIN l b ON b.nid = u.src AND b.cls = a.cls GROUP BY 1, 2)
    SELECT m.mode, l.cls::INT AS cls, round(avg(coalesce(h, 0)) + 1e-9, 6) AS homophily FROM (VALUES ('pos', 1, 1), ('neg', 0, 0), ('both', 0, 1)) AS m(mode, lo, hi) JOIN l ON l.y BETWEEN lo AND hi JOIN i USING (nid) LEFT JOIN s ON s.nid = l.nid AND s.cls = l.cls GROUP BY 1, 2"""
)
def multi_label_homophily(spark, sf_dir):
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nid"), F.array(F.col("c_custkey") % 2, (F.col("c_custkey") % 3 == 0).cast("long")).alias("label"))
    pairs, out = _ring(spark, sf_dir).select("dst", "src").distinct(), None
    for mode in ("pos", "neg", "both"):
        part = evaluate.multi_label_node_homophily(pairs, labels, mode).select(F.lit(mode).alias("mode"), "cls", rounded("homophily").alias("homophily"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH e AS (SELECT c_nationkey::BIGINT AS dst, c_custkey::BIGINT AS src, 0 AS etype, c_acctbal / 1000 AS x, 0.5 AS r, 1.0 AS p, n_nationkey % 3 AS q FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT s_nationkey, s_suppkey, 1, s_acctbal / 1000, -0.25, 2.0, n_nationkey % 3 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    z AS (SELECT dst, src, etype, h AS head, exp(CASE h WHEN 0 THEN q * x * r * p ELSE 0.5 * q * x * 0.1 * p END) AS z FROM e, (VALUES (0), (1)) AS t(h))
    SELECT dst, src, etype, head, round(z / sum(z) OVER (PARTITION BY dst, head) + 1e-9, 6) AS a FROM z"""
)
def typed_attention(spark, sf_dir):
    edges, nodes, p = _typed(spark, sf_dir)
    return layers.typed_attention(edges, nodes, "nation", *p[:2], p[3], p[5]).select("dst", "src", "etype", "head", rounded("a").alias("a"))


def _typed(spark: SparkSession, sf_dir: str):
    """Edges into nations, vectors of one number, and parameters of two heads of one number each."""
    g = commerce(spark, sf_dir)
    a, b = g.meta.canonical("lives-in"), g.meta.canonical("based-in")
    vectors_ = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("nid"), F.array(F.col("c_acctbal") / 1000).alias("h")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("nid"), F.array(F.col("s_acctbal") / 1000).alias("h")),
        "nation": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nid"), F.array((F.col("n_nationkey") % 3).cast("double")).alias("h")),
    }
    same = [[1.0], [1.0]]
    both = {"customer": same, "supplier": same}
    relation = {a: [[[0.5]], [[0.1]]], b: [[[-0.25]], [[0.1]]]}
    message = {a: [[[1.0]], [[0.5]]], b: [[[2.0]], [[-1.0]]]}
    return {a: g.edges[a], b: g.edges[b]}, vectors_, ([[1.0], [0.5]], both, both, relation, message, {a: [1.0, 1.0], b: [2.0, 2.0]}, [[0.3, -0.2]], 0.4)


@query(
    """WITH e AS (SELECT c_nationkey::BIGINT AS dst, c_acctbal / 1000 AS x, 0.5 AS r, 1.0 AS p, 1.0 AS m0, 0.5 AS m1, n_nationkey % 3 AS q FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT s_nationkey, s_acctbal / 1000, -0.25, 2.0, 2.0, -1.0, n_nationkey % 3 FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    z AS (SELECT *, exp(q * x * r * p) AS z0, exp(0.5 * q * x * 0.1 * p) AS z1 FROM e), s AS (SELECT dst, 0.3 * sum(z0 * x * m0) / sum(z0) - 0.2 * sum(z1 * x * m1) / sum(z1) AS o FROM z GROUP BY 1),
    n AS (SELECT n_nationkey::BIGINT AS nid, coalesce(o, 0) AS o, n_nationkey % 3 AS h, 1 / (1 + exp(-0.4)) AS g FROM nation LEFT JOIN s ON dst = n_nationkey)
    SELECT nid, round(g * 0.5 * o * (1 + tanh(sqrt(2 / pi()) * (o + 0.044715 * o * o * o))) + (1 - g) * h + 1e-9, 5) AS x FROM n"""
)
def hgt_layer(spark, sf_dir):
    edges, nodes, p = _typed(spark, sf_dir)
    return layers.hgt_conv(edges, nodes, "nation", *p).select("nid", F.round(F.get("h", 0) + 1e-9, 5).alias("x"))


@query(
    f"""WITH {_VEC}, p AS (SELECT 'a' AS mp, nid, h[1] AS x, h[2] AS y FROM v UNION ALL SELECT 'b', nid, h[2], h[1] FROM v), s AS (SELECT p.nid, p.mp, p.x, p.y, k.x AS kx, k.y AS ky, exp(0.1 * p.x * k.x - 0.05 * p.y * k.y) AS e FROM p JOIN p k USING (nid))
    SELECT nid, mp, round(x + 0.5 * sum(e * kx) / sum(e) + 1e-9, 6) AS x, round(y + 0.5 * sum(e * (kx + ky)) / sum(e) + 1e-9, 6) AS y FROM s GROUP BY nid, mp, s.x, s.y"""
)
def metapath_attention(spark, sf_dir):
    v = _customer_vectors(spark, sf_dir)
    paths = v.withColumn("mp", F.lit("a")).unionByName(v.select("nid", F.reverse("h").alias("h"), F.lit("b").alias("mp")))
    out = layers.metapath_attention(paths, [[0.1, 0.0], [0.0, -0.05]], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 1.0]], 0.5)
    return out.select("nid", "mp", rounded(F.get("h", 0)).alias("x"), rounded(F.get("h", 1)).alias("y"))


@query("SELECT c_custkey AS nid, 'nation' AS slot, c_nationkey::BIGINT AS col, round(0.25 + 1e-9, 6) AS val FROM customer UNION ALL SELECT c_custkey, 'region', n_regionkey, round(0.5 + 1e-9, 6) FROM customer JOIN nation ON n_nationkey = c_nationkey")
def weighted_metapath_features(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    near = c.select(F.lit("CN").alias("mp"), F.col("c_custkey").alias("nid"), F.lit("nation").alias("slot"), F.col("c_nationkey").cast("long").alias("col"), F.lit(1.0).alias("val"))
    far = c.join(n, c.c_nationkey == n.n_nationkey).select(F.lit("CNR").alias("mp"), F.col("c_custkey").alias("nid"), F.lit("region").alias("slot"), F.col("n_regionkey").cast("long").alias("col"), F.lit(1.0).alias("val"))
    steps = spark.createDataFrame([("lives-in", 0, 1), ("part-of", 1, 2)], "etype string, mp int, to int")
    relation = spark.createDataFrame([("lives-in", 0.25), ("part-of", 2.0)], "etype string, w double")
    names = spark.createDataFrame([(0, "C"), (1, "CN"), (2, "CNR")], "mp int, name string")
    w = layers.metapath_weights(steps, [relation, relation], spark.createDataFrame([(0, 1.0)], "mp int, weight double"))
    w = w.join(F.broadcast(names), "mp").select(F.col("name").alias("mp"), "weight")  # three rows
    return layers.weighted_metapaths(near.unionByName(far), w).select("nid", "slot", "col", rounded("val").alias("val"))


@query(
    """WITH r AS (SELECT n_regionkey AS profile, n_nationkey AS x FROM nation), g AS (SELECT profile, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM r GROUP BY 1),
    t AS (SELECT g.profile::BIGINT AS profile, (b.m - g.m) / sqrt(((b.n - 1) * b.s ** 2 + (g.n - 1) * g.s ** 2) / (b.n + g.n - 2) * (1 / b.n + 1 / g.n)) AS t, b.n + g.n - 2 AS df FROM g, (SELECT * FROM g WHERE profile = 4) b WHERE g.profile <> 4),
    a AS (SELECT *, atan(t / sqrt(df)) AS w FROM t) SELECT profile, round(t + 1e-9, 6) AS t, df, round((1 - sin(w) * (1 + cos(w) ** 2 / 2 + 3 * cos(w) ** 4 / 8 + 15 * cos(w) ** 6 / 48)) / 2 + 1e-9, 6) AS p FROM a"""
)
def profile_p_values(spark, sf_dir):
    means = runs.mean_std(table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("profile"), F.col("n_nationkey").cast("double").alias("x")), ["profile"], "x")
    return runs.p_values(means, 4).select("profile", rounded("t").alias("t"), "df", rounded("p").alias("p"))
