"""Self-training in stages: each learns from true labels and from its predecessor's confident guesses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import hash_order
from ..operators import evaluate
from ..operators.atomize import dense_ids
from ..scratch import dropped, written

#: Columns of what a stage learns from.
COLUMNS = ("nid", "label", "p", "kind")


@dataclass(frozen=True)
class Stage:
    """A stage's written rows and scores."""

    number: int
    score: float
    examples: DataFrame
    logits: DataFrame


def mixed(true: DataFrame, pseudo: DataFrame, batch: int, share: float, seed: int = 0) -> DataFrame:
    """The rows of both tables with their ``batch``: each has round(share · batch) pseudo rows and true ones for the rest.

    Both are put in a seeded order by ranges and numbered; the scarcer side, measured
    in batches, is gone through again, as ``copy`` counts, until the other one ends.
    A side that is empty leaves the other alone.
    """
    n_pseudo = round(share * batch)
    sizes = {"true": batch - n_pseudo, "pseudo": n_pseudo}
    tables = {"true": true.withColumn("kind", F.lit("true")), "pseudo": pseudo.withColumn("kind", F.lit("pseudo"))}
    counts = {k: t.count() for k, t in tables.items()}
    used = [k for k in tables if sizes[k] and counts[k]]
    if len(used) == 1:
        sizes[used[0]] = batch
    batches = max((-(-counts[k] // sizes[k]) for k in used), default=0)
    parts = []
    for k in used:
        keyed = tables[k].withColumn("__k", F.concat(hash_order(F.col("nid"), seed=seed), F.lit("-"), F.col("nid")))
        placed = keyed.join(dense_ids(keyed, "__k").withColumnRenamed("nid", "__i"), "__k")
        copies = -(-batches * sizes[k] // counts[k])
        again = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        place = F.col("copy") * counts[k] + F.col("__i")
        parts.append(again.withColumn("batch", F.floor(place / sizes[k])).where(F.col("batch") < batches).select(*COLUMNS, "copy", "batch"))
    if not parts:
        return tables["true"].select(*COLUMNS, F.lit(0).alias("copy"), F.lit(0).cast("long").alias("batch")).where("false")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def self_training(nodes: DataFrame, learn: Callable[[int, DataFrame], DataFrame], stages: int, threshold: float, batch: int, share: float, seed: int = 0) -> Stage:
    """The best stage by accuracy on the validation nodes, the first of equals.

    ``nodes`` are (nid, label, split).  A stage mixes batches of the training labels and
    of the last stage's guesses for other labelled nodes whose probability passes the
    threshold, has ``learn`` make logits (nid, cls, logit) of them, and writes both, so
    no stage rests on the plans of those before it, and a lost executor costs a stage
    at most.  Tables of stages that are neither the best so far nor the last are deleted.
    """
    true = nodes.where("split = 'train'").select("nid", "label", F.lit(1.0).alias("p"))
    held, truth = nodes.where("split in ('val', 'test')").select("nid"), nodes.where("split = 'val'").select("nid", F.col("label").alias("y"))
    best = last = None
    for number in range(stages):
        pseudo = true.where("false")
        if last is not None:
            guessed = evaluate.pseudo_labels(last.logits.join(held, "nid", "left_semi"), threshold)
            pseudo = guessed.select("nid", F.col("pred").alias("label"), "p")
        examples = written(mixed(true, pseudo, batch, share if last is not None else 0.0, seed + number), f"examples-{number}")
        logits = written(learn(number, examples).select("nid", "cls", "logit"), f"logits-{number}")
        found = evaluate.accuracy(evaluate.argmax_class(logits.join(truth, "nid", "left_semi")).join(truth, "nid")).first()[0]
        before, last = last, Stage(number, found or 0.0, examples, logits)
        over = [s for s in (before, best) if s is not None]
        if best is None or last.score > best.score:
            best = last
        for s in {x.number: x for x in over if x is not best}.values():
            dropped(s.examples, s.logits)
    return best
