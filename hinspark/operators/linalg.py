"""Sparse linear algebra as joins and grouped sums.

An adjacency is ``dst, src, w``: rows are destinations.  A feature matrix is the long
form ``nid, slot, col, val``; what isn't there is 0.  Every product aggregates right
after its join, so a chain of products never fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import dropped, written
from ..types import CEType


#: Rows that a task groups.
TASK_ROWS = 500_000


def in_tasks(rows: DataFrame, n: int, *keys: str, limit: int | None = None) -> DataFrame:
    """The n rows by their keys in tasks of bounded size, where the session's number of partitions would make larger ones."""
    tasks = -(-n // (limit or TASK_ROWS))
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def source_rows(df: DataFrame) -> int:
    """Rows of the Parquet files that a table is made of, by their footers: at least as many as its own, where it filters, groups or adds columns."""
    files = [f for f in df.inputFiles() if f.endswith(".parquet")]
    return df.sparkSession.read.parquet(*files).count() if files else 0


def weight_of(edges: DataFrame) -> Column:
    return F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges as an adjacency; parallel edges add up."""
    return edges.select("dst", "src", weight_of(edges).alias("w")).groupBy("dst", "src").agg(F.sum("w").alias("w"))


def row_normalized(adj: DataFrame) -> DataFrame:
    """w / sum of |w| over the row; a row of zeros stays 0.

    A grouped sum joined back, not a window: a hub's row is then split over tasks.
    """
    total = adj.groupBy("dst").agg(F.sum(F.abs("w")).alias("total"))
    return adj.join(total, "dst").select("dst", "src", F.coalesce(F.col("w") / F.nullif("total", F.lit(0.0)), F.lit(0.0)).alias("w"))


def row_normalized_adjacencies(edges: dict[CEType, DataFrame], wanted: set[CEType] | None = None) -> dict[CEType, DataFrame]:
    """Normalised adjacency of each wanted edge type."""
    return {c: row_normalized(adjacency(edges[c])) for c in edges if wanted is None or c in wanted}


def compose(second: DataFrame, first: DataFrame) -> DataFrame:
    """second · first, both adjacencies."""
    mid = first.select(F.col("dst").alias("mid"), F.col("src"), F.col("w").alias("w1"))
    joined = second.select("dst", F.col("src").alias("mid"), F.col("w").alias("w2")).join(mid, "mid")
    return joined.groupBy("dst", "src").agg(F.sum(F.col("w2") * F.col("w1")).alias("w"))


def diagonal_of_product(second: DataFrame, first: DataFrame) -> DataFrame:
    """(nid, w) of the diagonal of second · first: both ends join, so the product itself is never made."""
    right = first.select(F.col("dst").alias("mid"), F.col("src").alias("dst"), F.col("w").alias("w1"))
    joined = second.select("dst", F.col("src").alias("mid"), F.col("w").alias("w2")).join(right, ["dst", "mid"])
    return joined.groupBy(F.col("dst").alias("nid")).agg(F.sum(F.col("w2") * F.col("w1")).alias("w"))


def apply(adj: DataFrame, feats: DataFrame) -> DataFrame:
    """adj · feats."""
    joined = adj.join(feats, adj["src"] == feats["nid"])
    return joined.groupBy(F.col("dst").alias("nid"), "slot", "col").agg(F.sum(F.col("w") * F.col("val")).alias("val"))


def by_source(adj: DataFrame, feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of :func:`apply` by the sources in tasks of bounded size: until its sums are shuffled, a task holds those of its own edges.

    Not for features of few rows, which a broadcast brings to the edges where they are:
    few sources may have all edges.
    """
    edges, cells = source_rows(adj), source_rows(feats)
    if min(edges, cells) <= TASK_ROWS:
        return adj, feats
    return in_tasks(adj, max(edges, cells), "src"), in_tasks(feats, max(edges, cells), "nid")


def messages(edges: DataFrame, feats: DataFrame, message=None) -> DataFrame:
    """(dst, slot, col, val, eid) along each edge: the source's value times the weight, or what ``message(val, weight)`` makes of them."""
    make = message or (lambda val, weight: val * weight)
    eid = F.col("eid") if "eid" in edges.columns else F.xxhash64("src", "dst")
    sent = edges.select("src", "dst", weight_of(edges).alias("weight"), eid.alias("eid")).join(feats, F.col("src") == F.col("nid"))
    return sent.select("dst", "slot", "col", make(F.col("val"), F.col("weight")).alias("val"), "eid")


def reduce_sum(sent: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return sent.groupBy(F.col("dst").alias("nid"), "slot", "col").agg(F.sum("val").alias("val"))


def reduce_mean(sent: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum over in-degree: messages of 0 count too, though the long form has no rows of them."""
    degree = edges.groupBy(F.col("dst").alias("nid")).agg(F.count("*").alias("degree"))
    return reduce_sum(sent).join(degree, "nid").select("nid", "slot", "col", (F.col("val") / F.col("degree")).alias("val"))


def reduce_absmax(sent: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The value of the largest magnitude with its sign; the smallest edge id wins ties."""
    best = F.max_by("val", F.struct(F.abs("val"), -F.col("eid")))
    return sent.where("val <> 0").groupBy(F.col("dst").alias("nid"), "slot", "col").agg(best.alias("val"))


def reduce_max(sent: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return sent.groupBy(F.col("dst").alias("nid"), "slot", "col").agg(F.max("val").alias("val"))


REDUCERS = {"sum": reduce_sum, "mean": reduce_mean, "absmax": reduce_absmax, "max": reduce_max}


def normalized_bow(cells: DataFrame, row: str = "nid", val: str = "val") -> DataFrame:
    """x · (non-zeros of the row) / (sum of the row, at least 1e-6)."""
    stats = cells.groupBy(row).agg(F.count_if(F.col(val) > 0).alias("__n"), F.greatest(F.sum(val), F.lit(1e-6)).alias("__s"))
    return cells.join(stats, row).withColumn(val, F.col(val) * F.col("__n") / F.col("__s")).select(*cells.columns)


def normalized_numeric(cells: DataFrame, width: int | Column, row: str = "nid", val: str = "val") -> DataFrame:
    """x · width / sum of |x| over the row; null where the row has only zeros."""
    width = F.lit(width) if isinstance(width, int) else width
    stats = cells.groupBy(row).agg(F.sum(F.abs(val)).alias("__s"))
    return cells.join(stats, row).withColumn(val, F.col(val) * width / F.nullif("__s", F.lit(0.0))).select(*cells.columns)


def pattern(adj: DataFrame) -> DataFrame:
    return adj.select("dst", "src").distinct()


#: Pairs left out that a node may carry with it; a node with more meets them in a join.
LEFT_OUT = 16
#: Nodes of one list, and pairs of one task, where lists are paired.
LIST_NODES, TASK_PAIRS = 512, 20_000_000


def joined_pairs(first: DataFrame, second: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) that some middle node joins, of distinct (src, mid) and distinct (mid, dst); pairs of ``without`` (src, dst) are left out.

    Nodes with one middle node can't meet an end twice, so their pairs are neither
    shuffled nor compared: lists of them and of the ends are paired, and both lists
    unfolded, in tasks of bounded numbers of pairs, however large a middle node is.
    The pairs of all other nodes are grouped together with those left out.
    """
    kind = first.schema["src"].dataType
    ends = F.count("*").alias("n"), F.min("mid").alias("mid")
    out = first.groupBy("src").agg(*ends)
    if without is None:
        out = out.withColumn("skip", F.array().cast(T.ArrayType(kind)))
    else:
        without = without.select("src", "dst").distinct()
        few = without.join(without.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") <= LEFT_OUT), "src").groupBy("src").agg(F.max("k").alias("k"), F.collect_list("dst").alias("skip"))
        many = without.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") > LEFT_OUT).select("src", "k", F.lit(None).cast(T.ArrayType(without.schema["dst"].dataType)).alias("skip"))
        out = out.join(few.unionByName(many), "src", "left").withColumn("skip", F.when(F.col("k").isNull(), F.array().cast(T.ArrayType(without.schema["dst"].dataType))).otherwise(F.col("skip")))
    out = written(out.select("src", "n", "mid", "skip"), "middles")
    lone = (F.col("n") == 1) & F.col("skip").isNotNull()
    others = first.join(out.where(~lone).select("src"), "src", "left_semi")
    met = others.join(second, "mid").select("src", "dst", F.lit(False).alias("out"))
    if without is not None:
        met = met.unionByName(without.join(out.where(~lone).select("src"), "src", "left_semi").select("src", "dst", F.lit(True).alias("out")))
    met = met.groupBy("src", "dst").agg(F.bool_or("out").alias("out")).where("not out").select("src", "dst")
    heads = out.where(lone).select("mid", "src", "skip")
    return met if heads.isEmpty() else _paired_lists(heads, second).unionByName(met)


def _paired_lists(heads: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst) of heads (mid, src, skip) and all ends of their middle node but those that they skip."""
    tails = second.join(heads.select("mid").distinct(), "mid", "left_semi")
    sizes = written(heads.groupBy("mid").agg(F.count("*").alias("a")).join(tails.groupBy("mid").agg(F.count("*").alias("b")), "mid"), "sizes")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]

    def lists(rows: DataFrame, node: str, size: str, item: Column) -> DataFrame:
        place = F.pmod(F.xxhash64(node), F.floor(F.col(size) / LIST_NODES) + 1)
        return rows.join(sizes.select("mid", size), "mid").groupBy("mid", place.alias(f"{size}_place")).agg(F.collect_list(item).alias(f"{size}_list"))

    paired = lists(heads, "src", "a", F.struct("src", "skip")).join(lists(tails, "dst", "b", F.col("dst")), "mid")
    spread = paired.repartition(int(pairs // TASK_PAIRS) + 1, "mid", "a_place", "b_place")
    unfolded = spread.select(F.explode("a_list").alias("a"), "b_list").select("a.src", "a.skip", F.explode("b_list").alias("dst"))
    return unfolded.where(~F.array_contains("skip", F.col("dst"))).select("src", "dst")


def within_hops(edges: DataFrame, hops: int) -> DataFrame:
    """Distinct (src, dst), src <> dst, joined by exactly ``hops`` edges of one node type."""
    step = edges.select("src", "dst").distinct()
    now = step
    for _ in range(hops - 1):
        now = now.alias("a").join(step.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst")).distinct()
    return now.where("src <> dst")


def path_instances(steps: list[DataFrame]) -> DataFrame:
    """Every walk along consecutive edge tables, as an array of node ids; no aggregation, so as many rows as walks."""
    now = steps[0].select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    for e in steps[1:]:
        now = now.join(e.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
    return now.select("path")


def squared_powers(edges: DataFrame, nodes: DataFrame, order: int) -> list[DataFrame]:
    """The patterns (src, dst) of A, A², A⁴ and so on, ``order`` of them at most; A has a loop at every node and no other.

    Each is the one before squared, and written, so no plan holds more than one
    product.  With loops a pattern only grows; one that doesn't is a fixed point, and
    the list ends before it.
    """
    loops = nodes.select(F.col("nid").alias("src"), F.col("nid").alias("dst"))
    now = written(edges.where("src <> dst").select("src", "dst").union(loops).distinct(), "power")
    out, size = [now], now.count()
    while len(out) < order:
        ahead = now.select(F.col("src").alias("mid"), "dst")
        squared = written(now.select("src", F.col("dst").alias("mid")).join(ahead, "mid").select("src", "dst").distinct(), "power")
        before, size = size, squared.count()
        if size == before:
            dropped(squared)
            break
        out.append(squared)
        now = squared
    return out
