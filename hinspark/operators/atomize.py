"""Attributes as node types: each value, word or numeric column becomes a node with weighted edges both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written
from .linalg import normalized_bow, normalized_numeric


def dense_ids(values: DataFrame, key: str) -> DataFrame:
    """(key, nid): ids from 0 in the order of the keys.

    Two passes: counts of range partitions, then places inside them, so no
    single task numbers everything.  Written between the passes: bounds of ranges
    are sampled, so ranges made twice may differ.
    """
    sorted_ = values.select(key).distinct().where(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key)
    tagged = written(sorted_.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "ids")
    parts = tagged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    starts = parts.select("__p", "first", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return tagged.join(F.broadcast(starts), "__p").select(key, (F.col("start") + F.col("__i") - F.col("first")).alias("nid"))  # a row for each partition


def categories(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Values of a column as nodes, and an edge from each row to its value; null is no value."""
    nodes = dense_ids(rows.select(F.col(value).alias("value")), "value")
    edges = rows.select(F.col(key).alias("src"), F.col(value).alias("value")).join(nodes, "value").select("src", F.col("nid").alias("dst")).distinct()
    return nodes, edges


def one_hot_block(cells: DataFrame) -> DataFrame:
    """(nid, col) edges of a block of 0 and 1; any other value is an error."""
    value = F.when(F.col("val") == 1, F.col("nid")).otherwise(F.raise_error("a one-hot block has values other than 1"))
    return cells.where("val <> 0").select(value.alias("src"), F.col("col").cast("long").alias("dst"))


def words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row, word, n) of lower-cased words between white space."""
    split = rows.select(F.col(key).alias("row"), F.explode(F.split(F.lower(text), "\\s+")).alias("word")).where("word <> ''")
    return split.groupBy("row", "word").agg(F.count("*").alias("n"))


def bag_of_words(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights of word→row edges, normalised over each row, and of row→word edges, normalised over each word."""
    cells = counts.select("row", "word", F.col("n").cast("double").alias("weight"))
    return normalized_bow(cells, "row", "weight"), normalized_bow(cells, "word", "weight")


def bag_of_words_both(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row, word, per_row, per_word): both weights of :func:`bag_of_words` beside each other.

    Texts are shuffled by their rows, so that a row's words are counted and added up
    where they are, and written; only the word's sums need another shuffle.
    """
    counts = words(rows.select(F.col(key).alias("row"), F.col(text).alias("text")).repartition("row"), "row", "text")
    whole = Window.partitionBy("row")
    n = F.col("n").cast("double")
    cells = written(counts.select("row", "word", n.alias("n"), (n * F.count("*").over(whole) / F.greatest(F.sum(n).over(whole), F.lit(1e-6))).alias("per_row")), "cells")
    of_word = cells.groupBy("word").agg(F.count("*").alias("__n"), F.greatest(F.sum("n"), F.lit(1e-6)).alias("__s"))
    return cells.join(of_word, "word").select("row", "word", "per_row", (F.col("n") * F.col("__n") / F.col("__s")).alias("per_word"))


def numeric_columns(rows: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numeric columns as nodes: (row, col, weight) normalised per row, and per column over all rows."""
    long = rows.select(F.col(key).alias("row"), F.expr(f"stack({len(columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, cast({c} as double)' for c in columns)}) as (col, weight)"))
    n = rows.agg(F.count("*").alias("__rows"))
    per_row = normalized_numeric(long.where("weight <> 0"), len(columns), "row", "weight")
    per_col = normalized_numeric(long.where("weight <> 0").crossJoin(F.broadcast(n)), F.col("__rows"), "col", "weight").select("row", "col", "weight")  # one row
    return per_row, per_col


def dense_columns(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, col, weight) of each element of an array column that isn't 0."""
    return rows.select(F.col(key).alias("row"), F.posexplode(vector).alias("col", "v")).where("v <> 0").select("row", "col", F.col("v").cast("double").alias("weight"))


def with_mean_column(rows: DataFrame, key: str, value: str, eps: float = 1e-7) -> DataFrame:
    """(row, col, weight): the value in column 0 and the mean magnitude of all in column 1, both plus eps."""
    mean = rows.agg(F.avg(F.abs(value)).alias("m"))
    both = rows.select(F.col(key).alias("row"), F.col(value).cast("double").alias("v")).crossJoin(F.broadcast(mean))  # one row
    return both.select("row", F.posexplode(F.array("v", "m")).alias("col", "w")).select("row", "col", (F.col("w") + eps).alias("weight"))


def train_range(rows: DataFrame, key: str, value: str, split: Column) -> DataFrame:
    """(src, dst) one-hot edges of an integer column over the range of its training rows; values outside have none."""
    bounds = rows.where(split == "train").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    inside = rows.crossJoin(F.broadcast(bounds)).where(F.col(value).between(F.col("low"), F.col("high")))  # one row
    return inside.select(F.col(key).alias("src"), (F.col(value) - F.col("low")).cast("long").alias("dst"))
