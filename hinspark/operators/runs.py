"""Results of runs: means, best epochs, early stopping, ranks of profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .atomize import dense_ids


def read_csvs(spark: SparkSession, root: str, schema: str, matching: str = ".*") -> DataFrame:
    """All CSV files below a folder whose name doesn't start with _ and whose path matches; ``profile`` is the path below the folder without .csv."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    rows = rows.withColumn("__path", F.col("_metadata.file_path"))
    name = F.element_at(F.split("__path", "/"), -1)
    below = F.regexp_replace(F.regexp_extract("__path", ".*" + root.rstrip("/").rsplit("/", 1)[-1] + "/(.*)$", 1), "\\.csv$", "")
    return rows.where(~name.startswith("_") & F.col("__path").rlike(matching)).withColumn("profile", below).drop("__path")


def append_row(spark: SparkSession, row: dict, path: str) -> None:
    spark.createDataFrame([row]).coalesce(1).write.mode("append").option("header", True).csv(path)


def mean_std(runs: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean and sample deviation of each group."""
    return runs.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def running_mean_std(runs: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Mean and population deviation of a group's runs so far."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w)})


def weighted_mean(batches: DataFrame, value: str, n: str) -> DataFrame:
    return batches.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"))


def top(rows: DataFrame, value: str, n: int, tie: str, descending: bool = True) -> DataFrame:
    """The n best rows: a bounded report."""
    return rows.orderBy(F.desc(value) if descending else F.asc(value), tie).limit(n)


def first_rows(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def early_stopping(history: DataFrame, group: list[str], patience: int, minimise: bool = True) -> DataFrame:
    """History with best (so far), waited (rows since it last improved strictly) and stop (the first row at which waited reaches patience)."""
    w = Window.partitionBy(*group).orderBy("epoch")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    best = F.min if minimise else F.max
    better = F.col("value") < F.col("__b") if minimise else F.col("value") > F.col("__b")
    h = history.withColumns({"best": best("value").over(so_far), "__b": best("value").over(before), "__i": F.row_number().over(w)})
    h = h.withColumn("__last", F.max(F.when(F.col("__b").isNull() | better, F.col("__i"))).over(so_far))
    h = h.withColumn("waited", (F.col("__i") - F.col("__last")).cast("long"))
    h = h.withColumn("__at", F.min(F.when(F.col("waited") >= patience, F.col("__i"))).over(Window.partitionBy(*group)))
    return h.withColumn("stop", F.coalesce(F.col("__at") == F.col("__i"), F.lit(False))).drop("__b", "__i", "__last", "__at")


def missed_checkpoints(history: DataFrame, checkpoints: DataFrame, group: list[str], minimise: bool = True) -> DataFrame:
    """(group, epoch): the first epoch at which a run is worse than the (epoch, bound) asked of it there; runs that miss none aren't in it."""
    asked = history.join(F.broadcast(checkpoints.select("epoch", "bound")), "epoch")  # a short list, a row for each epoch asked about
    worse = F.col("value") > F.col("bound") if minimise else F.col("value") < F.col("bound")
    return asked.where(worse).groupBy(*group).agg(F.min("epoch").alias("epoch"))


def best_scalars(history: DataFrame, group: list[str], metric: str, minimise: bool = True) -> DataFrame:
    """(group, tag, value) of all scalars at the epoch where a metric is best, the first on ties."""
    of = history.where(F.col("tag") == metric)
    key = F.struct(-F.col("value") if minimise else F.col("value"), -F.col("epoch"))
    best = of.groupBy(*group).agg(F.max_by("epoch", key).alias("epoch"))
    return history.join(best, [*group, "epoch"]).select(*group, "epoch", "tag", "value")


def stale_checkpoints(checkpoints: DataFrame, group: list[str], keep: int) -> DataFrame:
    """All but the last ``keep`` epochs of each run."""
    w = Window.partitionBy(*group).orderBy(F.desc("epoch"))
    return checkpoints.withColumn("__r", F.row_number().over(w)).where(F.col("__r") > keep).drop("__r")


def t_statistic(means: DataFrame, best: str, group: str = "profile") -> DataFrame:
    """Pooled two-sample t and its degrees of freedom of the best profile against each other one, from (mean, std, n)."""
    b = means.where(F.col(group) == best).select(F.col("mean").alias("m1"), F.col("std").alias("s1"), F.col("n").alias("n1"))
    o = means.where(F.col(group) != best).crossJoin(F.broadcast(b))  # one row
    df = F.col("n1") + F.col("n") - 2
    pooled = ((F.col("n1") - 1) * F.col("s1") ** 2 + (F.col("n") - 1) * F.col("std") ** 2) / df
    return o.select(group, ((F.col("m1") - F.col("mean")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n")))).alias("t"), df.cast("long").alias("df"))


def student_tail(t: Column, df: Column) -> Column:
    """P(T > t) of Student's distribution of a whole number of degrees of freedom, by its finite series in cos(atan(t / sqrt(df)))."""
    angle = F.atan(t / F.sqrt(df.cast("double")))
    odd, square = F.pmod(df, F.lit(2)) == 1, F.cos(angle) * F.cos(angle)
    steps = F.when(df >= 4, F.sequence(F.lit(1).cast("long"), F.floor((df - F.when(odd, 3).otherwise(2)) / 2))).otherwise(F.array().cast("array<long>"))
    steps = F.when(odd & (df < 5), F.array().cast("array<long>")).otherwise(steps)
    grown = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * square * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))).alias("term"),
            (s["sum"] + s["term"] * square * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    sine = F.sin(angle)
    two_sided = F.when(df == 1, 2 * angle / math.pi).when(odd, 2 / math.pi * (angle + sine * F.cos(angle) * grown)).otherwise(sine * grown)
    return (1 - two_sided) / 2


def p_values(means: DataFrame, best: str, group: str = "profile") -> DataFrame:
    """(group, t, df, p): one-sided, that the best profile's mean isn't larger than the other's."""
    return t_statistic(means, best, group).withColumn("p", student_tail(F.col("t"), F.col("df")))


def reindexed(leaves: DataFrame) -> DataFrame:
    """(nid, tree, leaf) with ``id``: leaves numbered from 0 by tree, then leaf, in ranges of them."""
    ids = dense_ids(leaves.select(F.struct("tree", "leaf").alias("key")), "key")
    return leaves.join(ids.select("key.tree", "key.leaf", F.col("nid").alias("id")), ["tree", "leaf"])


def formatted(means: DataFrame) -> DataFrame:
    return means.withColumn("text", F.format_string("%.4f±%.4f", "mean", "std"))
