"""Node features: kinds, the one-line language that names them, and changes to their columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import hash_uniform

LONG = "nid long, slot string, col int, val double"


def _long(nodes: DataFrame, slot: str, col, val) -> DataFrame:
    return nodes.select("nid", F.lit(slot).alias("slot"), col.cast("int").alias("col"), val.cast("double").alias("val"))


def identity(nodes: DataFrame, slot: str) -> DataFrame:
    """A column for each node."""
    return _long(nodes, slot, F.col("nid"), F.lit(1.0))


def type_one_hot(nodes: DataFrame, slot: str, type_id: int) -> DataFrame:
    return _long(nodes, slot, F.lit(type_id), F.lit(1.0))


def zero(nodes: DataFrame, slot: str) -> DataFrame:
    """One column, all 0: no rows in the long form."""
    return identity(nodes, slot).where("false")


def uniform(nodes: DataFrame, slot: str, width: int, low: float, high: float, seed: int = 0) -> DataFrame:
    """width columns of hashed uniform numbers, the same on every run."""
    cells = nodes.select("nid", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c"))
    return _long(cells, slot, F.col("c"), low + (high - low) * hash_uniform(F.col("nid"), F.col("c"), seed=seed))


@dataclass(frozen=True)
class Kind:
    """original, none, ntype, nid (or id), zero, each perhaps with _id, _emb or _coo; or u(width, low, high[, seed])."""

    name: str
    form: str = "dense"
    args: tuple[float, ...] = ()

    @staticmethod
    def parse(text: str) -> Kind:
        if m := re.fullmatch(r"u\(\s*(\d+)\s*,\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)\s*(?:,\s*(\d+|0x[0-9a-fA-F]+)\s*)?\)", text):
            return Kind("uniform", args=(int(m[1]), float(m[2]), float(m[3]), int(m[4], 0) if m[4] else 0))
        name, _, form = text.partition("_")
        name = {"id": "nid"}.get(name, name)
        if name not in ("original", "none", "ntype", "nid", "zero") or form not in ("", "id", "emb", "coo"):
            raise ValueError(f"no feature kind {text!r}")
        return Kind(name, form or "dense")


def of_kind(kind: Kind, nodes: DataFrame, slot: str, type_id: int, original: DataFrame | None = None) -> DataFrame | None:
    """The features of a kind; None is no features."""
    if kind.name == "original":
        return original
    if kind.name == "none":
        return None
    if kind.name == "uniform":
        return uniform(nodes, slot, *kind.args)
    return {"nid": lambda: identity(nodes, slot), "ntype": lambda: type_one_hot(nodes, slot, type_id), "zero": lambda: zero(nodes, slot)}[kind.name]()


def widths(feats: DataFrame) -> DataFrame:
    """(slot, width): largest column and one."""
    return feats.groupBy("slot").agg((F.max("col") + 1).cast("long").alias("width"))


def concatenated(feats: DataFrame, order: list[str]) -> DataFrame:
    """Slots side by side as one block: each column moves by the widths of the slots before it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("slot"))
    shift = widths(feats).withColumn("offset", F.coalesce(F.sum("width").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return feats.join(F.broadcast(shift.select("slot", "offset")), "slot").select("nid", (F.col("col") + F.col("offset")).cast("int").alias("col"), "val")  # a row for each slot


def sliced(feats: DataFrame, low: int, high: int, slot: str | None = None) -> DataFrame:
    """Columns low to high, renumbered from 0."""
    part = feats.where((F.col("col") >= low) & (F.col("col") < high)).withColumn("col", F.col("col") - low)
    return part.withColumn("slot", F.lit(slot)) if slot else part


def dense(feats: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(nid, feat) as arrays with explicit zeros, for export."""
    cells = feats.groupBy("nid").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return nodes.select("nid").join(cells, "nid", "left").select("nid", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(at).alias("feat"))


def support(feats: DataFrame) -> DataFrame:
    """(col, support): rows with a value other than 0."""
    return feats.where("val <> 0").groupBy("col").agg(F.countDistinct("nid").alias("support"))


def popular(feats: DataFrame, threshold: int | None = None, target: int | None = None, start: int = 1) -> DataFrame:
    """Columns with support above the threshold; or above the smallest one from ``start`` on that leaves at most ``target`` columns."""
    counts = support(feats)
    if threshold is not None:
        return counts.where(F.col("support") > threshold).select("col")
    # columns left above t, for each support t that occurs and for the start
    histogram = counts.groupBy("support").agg(F.count("*").alias("n"))
    above = histogram.select("support", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("support")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("left"))
    at_start = counts.agg(F.count_if(F.col("support") > start).alias("left")).select(F.lit(start).cast("long").alias("support"), "left")
    chosen = above.where(F.col("support") >= start).unionByName(at_start).where(F.col("left") <= target).agg(F.min("support").alias("t"))
    return counts.join(F.broadcast(chosen), F.col("support") > F.col("t")).select("col")  # one row
