"""Boosted trees over target features, and their leaves as features: one-vs-rest ensembles, trained on executors."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..scratch import written
from .layers import vector_sum


def _vectors(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("nid", *columns, array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("features"))


def boosted(rows: DataFrame, n_classes: int, trees: int, depth: int, step: float = 0.3, seed: int = 0) -> list[GBTClassificationModel]:
    """An ensemble for each class against all others, of (nid, x, label, split): trained on the labelled training rows only.

    The rows are put in the order of their ids in ranges, so a fit doesn't depend on
    how the table is partitioned beyond the sums' last digits.  They are written, as
    every fit reads them several times.
    """
    train = written(_vectors(rows.where("split = 'train' and label is not null").repartitionByRange("nid").sortWithinPartitions("nid"), "label"), "train")
    made = []
    for c in range(n_classes):
        learner = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=1.0, leafCol="leaf")
        made.append(learner.fit(train.withColumn("y", (F.col("label") == c).cast("double"))))
    return made


def leaves(models: list[GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """(nid, tree, leaf) of every row: the leaf it falls into in each tree, leaves counted from the left; trees of all classes in one count.

    One pass over the rows: all models' leaves are put beside each other, then unfolded.
    """
    placed = _vectors(rows)
    for c, model in enumerate(models):
        placed = model.copy({model.leafCol: f"leaf{c}"}).transform(placed).drop("rawPrediction", "probability", "prediction")
    beside = F.concat(*(vector_to_array(f"leaf{c}") for c in range(len(models))))
    return placed.select("nid", F.posexplode(beside).alias("tree", "leaf")).select("nid", "tree", F.col("leaf").cast("int").alias("leaf"))


def margins(models: list[GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """(nid, cls, logit): each class's margin, in one pass over the rows."""
    scored = _vectors(rows)
    for c, model in enumerate(models):
        scored = model.copy({model.rawPredictionCol: f"raw{c}", model.leafCol: ""}).transform(scored).drop("probability", "prediction")
    beside = F.array(*(F.get(vector_to_array(f"raw{c}"), 1) for c in range(len(models))))
    return scored.select("nid", F.posexplode(beside).alias("cls", "logit")).select("nid", F.col("cls").cast("long").alias("cls"), "logit")


def leaf_embeddings(ids: DataFrame, table: DataFrame) -> DataFrame:
    """(nid, h): the sum of the vectors (id, h) of a node's leaves (nid, id), looked up by a join."""
    return vector_sum(ids.select("nid", "id").join(table, "id").select("nid", "h"), "nid", "h")
