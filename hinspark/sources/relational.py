"""Relational tables as networks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..graph import HinGraph, Tables, reversed_edges
from ..operators import atomize, linalg
from ..types import CEType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT = """CASE WHEN pmod(c_custkey * 7 + 3, 10) <= 4 THEN 'train' WHEN pmod(c_custkey * 7 + 3, 10) <= 6 THEN 'val'
           WHEN pmod(c_custkey * 7 + 3, 10) <= 8 THEN 'test' END"""


#: Rows that a task groups.
TASK_ROWS = linalg.TASK_ROWS


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by their keys in tasks of bounded size, where the session's number of partitions would make larger ones.

    Groups of these keys, and sums over the same ones or more afterwards, are made in those tasks.
    """
    return linalg.in_tasks(rows, rows.count(), *keys, limit=TASK_ROWS)


def commerce(spark: SparkSession, sf_dir: str) -> HinGraph:
    """Customers, orders, parts, suppliers, nations, regions, and the parts' attributes as node types.

    The target is the customer; its class is its market segment, which is no node type.
    Tables are read, and ids of attributes written, when a query first asks for them.
    """
    t = functools.cache(lambda name: table(spark, sf_dir, name))

    def customers() -> DataFrame:
        segments = t("customer").select("c_mktsegment").distinct().select("c_mktsegment", (F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1).cast("long").alias("label"))
        return t("customer").join(F.broadcast(segments), "c_mktsegment").select(F.col("c_custkey").alias("nid"), "label", F.expr(SPLIT).alias("split"))  # a row for each segment

    def ids(name: str, key: str):
        return lambda: t(name).select(F.col(key).cast("long").alias("nid"))

    def pair(name: str, a: str, b: str):
        return lambda: spread(t(name).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")), "src")

    def per_line(a: str, weight):
        return lambda: spread(t("lineitem"), a).groupBy(F.col(a).alias("src"), F.col("l_partkey").alias("dst")).agg(weight().alias("weight"))

    nodes = {
        "customer": customers,
        "order": ids("orders", "o_orderkey"),
        "part": ids("part", "p_partkey"),
        "supplier": ids("supplier", "s_suppkey"),
        "nation": ids("nation", "n_nationkey"),
        "region": ids("region", "r_regionkey"),
    }
    edges = {
        CEType("customer", "places", "order"): pair("orders", "o_custkey", "o_orderkey"),
        CEType("order", "contains", "part"): per_line("l_orderkey", lambda: F.sum("l_quantity")),
        CEType("supplier", "supplies", "part"): per_line("l_suppkey", lambda: F.count("*").cast("double")),
        CEType("customer", "lives-in", "nation"): pair("customer", "c_custkey", "c_nationkey"),
        CEType("supplier", "based-in", "nation"): pair("supplier", "s_suppkey", "s_nationkey"),
        CEType("nation", "part-of", "region"): pair("nation", "n_nationkey", "n_regionkey"),
    }
    back = {"places": "placed-by", "contains": "in-order", "supplies": "supplied-by", "lives-in": "home-of", "based-in": "base-of", "part-of": "has-nation"}
    for ntype, column in (("brand", "p_brand"), ("ptype", "p_type"), ("size", "p_size")):
        both = functools.cache(functools.partial(lambda column: atomize.categories(t("part"), "p_partkey", column), column))
        nodes[ntype] = functools.partial(lambda both: both()[0], both)
        edges[CEType("part", f"has-{ntype}", ntype)] = functools.partial(lambda both: both()[1], both)
        back[f"has-{ntype}"] = f"{ntype}-of"
    edges = Tables(edges)
    others = {c: CEType(c.dst, back[c.etype], c.src) for c in edges}
    turned = {other: functools.partial(lambda c: reversed_edges(edges[c]), c) for c, other in others.items()}
    return HinGraph(nodes, edges | turned, others | {b: a for a, b in others.items()}, "customer")
