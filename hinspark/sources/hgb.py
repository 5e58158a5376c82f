"""Text files of typed nodes, links and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def find(spark: SparkSession, folder: str, name: str) -> str:
    """The one of name.dat and name.csv that exists, on any file system Spark reads; both or none is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for ending in ("dat", "csv"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{ending}")
        if path.getFileSystem(conf).exists(path):
            there.append(str(path))
    if len(there) != 1:
        raise FileNotFoundError(f"{folder} has {len(there)} files {name}.dat or {name}.csv")
    return there[0]


def _floats(text: Column, separator: str) -> Column:
    """An array of numbers; a single number, or none, is no attribute."""
    parts = F.split(F.trim(text), separator)
    return F.when(F.size(parts) > 1, F.transform(parts, lambda x: x.cast("double")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines numbered from 0 across the file's splits, which Spark reads in order.

    Two passes: lines are counted per partition, then numbered inside it.
    """
    lines = spark.read.text(path).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    parts = lines.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    starts = parts.select("__p", "first", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return lines.join(F.broadcast(starts), "__p").select((F.col("start") + F.col("__i") - F.col("first")).alias("line_no"), "value")  # a row for each partition


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, type, attr) of a node file."""
    if path.endswith(".csv"):
        rows = spark.read.schema("node_id long, node_type int, attr string").option("header", True).csv(path)
        return rows.select(F.col("node_id").alias("id"), F.lit(None).cast("string").alias("name"), F.col("node_type").alias("type"), _floats(F.col("attr"), " +").alias("attr"))
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(F.when(F.size(parts).isin(3, 4), parts).otherwise(F.raise_error(F.concat(F.lit("a node line has 3 or 4 fields: "), "value"))).alias("f"))
    return rows.select(F.get("f", 0).cast("long").alias("id"), F.get("f", 1).alias("name"), F.get("f", 2).cast("int").alias("type"), _floats(F.get("f", 3), ",").alias("attr"))


def node_stats(nodes: DataFrame) -> DataFrame:
    """(type, n, shift): ids of a type are shift to shift + n - 1."""
    per = nodes.groupBy("type").agg(F.count("*").alias("n"))
    return per.withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def links(spark: SparkSession, path: str) -> DataFrame:
    """(head, tail, rel, weight)."""
    reader = spark.read.schema("head long, tail long, rel int, weight double")
    return reader.option("header", True).csv(path) if path.endswith(".csv") else reader.option("sep", "\t").csv(path)


def link_stats(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel, n, head_type, tail_type): the types of each relation's smallest link."""
    types = lambda end, to: nodes.select(F.col("id").alias(end), F.col("type").alias(to))
    least = links.groupBy("rel").agg(F.count("*").alias("n"), F.min(F.struct("head", "tail")).alias("x")).select("rel", "n", "x.*")
    return least.join(types("head", "head_type"), "head").join(types("tail", "tail_type"), "tail").select("rel", "n", "head_type", "tail_type")


def relation_matrix(links: DataFrame) -> DataFrame:
    """(rel, head, tail, weight): repeated links of a relation add up."""
    return links.groupBy("rel", "head", "tail").agg(F.sum("weight").alias("weight"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id, labels) of a label file; lines of .dat are id, name, type, comma-separated classes."""
    if path.endswith(".csv"):
        rows = spark.read.schema("node_id long, node_type int, labels string").option("header", True).csv(path)
        return rows.select(F.lit(None).cast("long").alias("line_no"), F.col("node_id").alias("id"), F.transform(F.split("labels", " +"), lambda x: x.cast("int")).alias("labels"))
    parts = F.split("value", "\t")
    return numbered_lines(spark, path).where("value <> ''").select("line_no", parts[0].cast("long").alias("id"), F.transform(F.split(parts[3], ","), lambda x: x.cast("int")).alias("labels"))


def split_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(id, labels, split) of data_train, data_val and data_test."""
    out = None
    for split in ("train", "val", "test"):
        part = labels(spark, find(spark, folder, f"data_{split}")).select("id", "labels", F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def hgb_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(id, labels, split): the first fifth of label.dat is val, the rest train, label.dat.test is test."""
    from ..operators.sample import split_first_lines

    first = split_first_lines(labels(spark, f"{folder}/label.dat")).select("id", "labels", "split")
    return first.unionByName(labels(spark, f"{folder}/label.dat.test").select("id", "labels", F.lit("test").alias("split")))


def n_classes(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode("labels").alias("c")).agg((F.max("c") + 1).alias("n_classes"))


def multi_hot(labels: DataFrame, width: int) -> DataFrame:
    """(id, y, split) with arrays of 0 and 1."""
    at = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains("labels", i).cast("int"))
    return labels.select("id", at.alias("y"), "split")


@dataclass(frozen=True)
class Raw:
    """A parsed folder; all tables are lazy."""

    nodes: DataFrame
    node_stats: DataFrame
    links: DataFrame
    link_stats: DataFrame
    labels: DataFrame | None


def raw(spark: SparkSession, folder: str, labelled: bool = True) -> Raw:
    """Nodes, links and labels of a folder."""
    n = nodes(spark, find(spark, folder, "node"))
    e = links(spark, find(spark, folder, "link"))
    return Raw(n, node_stats(n), e, link_stats(e, n), hgb_labels(spark, folder) if labelled else None)


def link_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """(head, tail, rel, weight, split) of link.dat (train) and link.dat.test (test)."""
    train, test = (links(spark, f"{folder}/{f}").withColumn("split", F.lit(s)) for f, s in (("link.dat", "train"), ("link.dat.test", "test")))
    return train.unionByName(test)


def local_edges(links: DataFrame, stats: DataFrame, rel: int, nodes: DataFrame) -> DataFrame:
    """Edges of a relation with ids local to their types, without zeros."""
    where = F.broadcast(stats.select("type", "shift"))  # a row for each type
    typed = lambda end: nodes.select(F.col("id").alias(end), "type").join(where, "type").select(end, (F.col(end) - F.col("shift")).alias(f"{end}_id"))
    part = relation_matrix(links.where(F.col("rel") == rel)).where("weight <> 0")
    return part.join(typed("head"), "head").join(typed("tail"), "tail").select(F.col("head_id").alias("src"), F.col("tail_id").alias("dst"), "weight")


def write_scored(scored: DataFrame, path: str, append: bool = False) -> None:
    """(src, dst, score, ...) as tab-separated text."""
    scored.write.mode("append" if append else "overwrite").option("sep", "\t").csv(path)
