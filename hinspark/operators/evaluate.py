"""Scores of predictions and rankings, thresholds, homophily; each a few grouped sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import bce_with_logits, sigmoid
from ..scratch import written


def roc_auc(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row ``auc``, by the rank formula with mean ranks of ties.

    Rows are counted per score first; the running count is over distinct scores in
    range partitions, with the partitions' totals added, so nothing is sorted in one task.
    """
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    below = with_running_sum(per, "s", "n", "below")
    rank_sum = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    p = F.sum("pos")
    return below.agg(rank_sum.alias("r"), p.cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q")).select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def with_running_sum(rows: DataFrame, order: str, value: str, to: str) -> DataFrame:
    """Sum of ``value`` over all rows before each one in a total order; see :func:`with_running_sums`."""
    return with_running_sums(rows, order, {value: to})


def with_running_sums(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Sums of columns, each to a column, over all rows before each one in a total order, in two passes over range partitions.

    Written between the passes: bounds of ranges are sampled, so ranges made twice may differ.
    """
    parts = written(rows.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    total = parts.groupBy("__p").agg(*(F.sum(v).alias(f"__t{i}") for i, v in enumerate(sums)))
    before = total.select("__p", *(F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))))
    run = parts.withColumns({to: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, to in sums.items()})
    run = run.join(F.broadcast(before), "__p").withColumns({to: F.col(to) + F.col(f"__b{i}") for i, to in enumerate(sums.values())})  # a row for each partition
    return run.drop("__p", *(f"__b{i}" for i in range(len(sums))))


def ranking(scored: DataFrame, head: list[str], score: str = "score", tie: str = "dst", y: str = "y") -> DataFrame:
    """One row mrr, amrr, nmrr, ndcg: means over the heads that have a positive."""
    w = Window.partitionBy(*head).orderBy(F.desc(score), tie)
    ranked = scored.withColumn("r", F.row_number().over(w))
    per = ranked.groupBy(*head).agg(
        F.sum(F.col(y).cast("long")).alias("n"),
        F.min(F.when(F.col(y) == 1, F.col("r"))).alias("first"),
        F.sum(F.col(y) / F.col("r")).alias("rr"),
        F.sum(F.col(y) / F.log2(F.col("r") + 1)).alias("dcg"),
    )
    per = per.where("n > 0")
    steps = F.sequence(F.lit(1).cast("long"), F.col("n"))
    ideal = lambda f: F.aggregate(F.transform(steps, f), F.lit(0.0), lambda s, x: s + x)
    return per.select(
        (1 / F.col("first")).alias("mrr"),
        (F.col("rr") / F.col("n")).alias("amrr"),
        (F.col("rr") / ideal(lambda i: 1.0 / i)).alias("nmrr"),
        (F.col("dcg") / ideal(lambda i: 1.0 / F.log2(i + 1))).alias("ndcg"),
    ).agg(*(F.avg(c).alias(c) for c in ("mrr", "amrr", "nmrr", "ndcg")))


def link_metrics(scored: DataFrame, head: list[str], score: str = "score", tie: str = "dst", y: str = "y") -> DataFrame:
    """One row mrr, amrr, nmrr, ndcg, auc of scored links: ranked for each head, and over all pairs."""
    return ranking(scored, head, score, tie, y).crossJoin(F.broadcast(roc_auc(scored, score, y)))  # one row each


def argmax_class(logits: DataFrame, key: str = "nid") -> DataFrame:
    """(key, pred) of (key, cls, logit): the largest logit, the smallest class on ties."""
    return logits.groupBy(key).agg(F.max_by("cls", F.struct("logit", -F.col("cls"))).alias("pred"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def _micro_macro(per_class: DataFrame) -> DataFrame:
    """One row micro_f1, macro_f1 of (cls, tp, fp, fn)."""
    return per_class.agg(_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def f1_single(predicted: DataFrame, pred: str = "pred", y: str = "y") -> DataFrame:
    """Over the classes that occur as truth or prediction."""
    cells = predicted.groupBy(F.col(pred).alias("p"), F.col(y).alias("t")).agg(F.count("*").alias("n"))
    either = cells.select(F.explode(F.when(F.col("p") == F.col("t"), F.array(F.struct(F.col("p").alias("cls"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(F.array(F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")), F.struct(F.col("t").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn"))))).alias("x")).select("x.*")
    return _micro_macro(either.groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def f1_multi(scored: DataFrame, thresholds: DataFrame | float = 0.5) -> DataFrame:
    """Of (nid, cls, logit, y): a class is predicted where the sigmoid passes its threshold, (cls, threshold) or one for all."""
    if isinstance(thresholds, DataFrame):
        scored = scored.join(F.broadcast(thresholds), "cls")  # a row for each class
        limit = F.col("threshold")
    else:
        limit = F.lit(thresholds)
    hit, true = sigmoid(F.col("logit")) > limit, F.col("y") == 1
    return _micro_macro(scored.groupBy("cls").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")))


def best_thresholds(scored: DataFrame, objective: Callable[[Column, Column, Column], Column] = _f1) -> DataFrame:
    """(cls, threshold, f1): for each class the least probability that, as an exclusive bound just below it, gives the best F1.

    An exact scan of all distinct probabilities, by running counts from above over
    ranges of (class, probability), so no class is one task's.  ``objective`` of true
    positives, false positives and false negatives may stand for F1; what it gives is
    under ``f1`` all the same.
    """
    per = scored.groupBy("cls", sigmoid(F.col("logit")).alias("p")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    run = with_running_sums(per.withColumn("at", F.struct("cls", (-F.col("p")).alias("down"))), "at", {"pos": "tp", "n": "k"})
    first = run.groupBy("cls").agg(F.min("tp").alias("tp0"), F.min("k").alias("k0"), F.sum("pos").alias("total"))
    tp, k = F.col("tp") + F.col("pos") - F.col("tp0"), F.col("k") + F.col("n") - F.col("k0")
    counted = run.join(F.broadcast(first), "cls").select("cls", "p", objective(tp, k - tp, F.col("total") - tp).alias("f1"))  # a row for each class
    best = counted.groupBy("cls").agg(F.max_by(F.struct("p", "f1"), F.struct("f1", -F.col("p"))).alias("b")).select("cls", "b.p", "b.f1")
    lower = per.select("cls", F.col("p").alias("q")).join(F.broadcast(best), "cls").groupBy("cls", "p", "f1").agg(F.max(F.when(F.col("q") < F.col("p"), F.col("q"))).alias("q"))
    return lower.select("cls", F.coalesce((F.col("p") + F.col("q")) / 2, F.col("p") / 2).alias("threshold"), "f1")


def searched_f1(scored: DataFrame, split: str = "split", learn: str = "train", objective: Callable[[Column, Column, Column], Column] = _f1) -> DataFrame:
    """(split, micro_f1, macro_f1) of (nid, cls, logit, y, split): thresholds are searched on one split and used on all; a class it doesn't have keeps 0.5."""
    limits = best_thresholds(scored.where(F.col(split) == learn), objective).select("cls", "threshold")
    at = scored.where(F.col(split).isNotNull()).join(F.broadcast(limits), "cls", "left")  # a row for each class
    hit, true = sigmoid(F.col("logit")) > F.coalesce("threshold", F.lit(0.5)), F.col("y") == 1
    per = at.groupBy(split, "cls").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    return per.groupBy(split).agg(_f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"))


def threshold_grid(scored: DataFrame, steps: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(k, threshold, f1) of binary scores at evenly spaced thresholds.

    A score is counted once, in the cell of the grid it falls in; thresholds then
    add up cells from above.
    """
    width = (high - low) / steps
    cell = F.greatest(F.lit(-1), F.least(F.ceil((F.col("score") - low) / width) - 1, F.lit(steps))).cast("long")
    cells = scored.groupBy(cell.alias("c")).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    spark = scored.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").alias("k"))
    above = grid.join(F.broadcast(cells), F.col("c") >= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("m"))  # steps + 2 rows at most
    total = scored.agg(F.sum(F.col("y").cast("long")).alias("total"))
    return above.crossJoin(F.broadcast(total)).select("k", (F.lit(low) + F.col("k") * width).alias("threshold"), _f1(F.col("tp"), F.col("m") - F.col("tp"), F.col("total") - F.col("tp")).alias("f1"))


def accuracy(predicted: DataFrame, pred: str = "pred", y: str = "y") -> DataFrame:
    return predicted.agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy"))


def softmax(rows: DataFrame, group: list[str], x: str, to: str, normalize: bool = False) -> DataFrame:
    """Softmax of x in each group, the largest subtracted first; with normalize, x is z-scored before (population deviation, 1e-10 at least)."""
    if normalize:
        stats = rows.groupBy(*group).agg(F.avg(x).alias("__a"), F.greatest(F.stddev_pop(x), F.lit(1e-10)).alias("__d"))
        rows = rows.join(stats, group).withColumn(x, (F.col(x) - F.col("__a")) / F.col("__d")).drop("__a", "__d")
    top = rows.groupBy(*group).agg(F.max(x).alias("__m"))
    shifted = rows.join(top, group).withColumn(to, F.exp(F.col(x) - F.col("__m"))).drop("__m")
    mass = shifted.groupBy(*group).agg(F.sum(to).alias("__s"))
    return shifted.join(mass, group).withColumn(to, F.col(to) / F.col("__s")).drop("__s")


def pseudo_labels(logits: DataFrame, threshold: float) -> DataFrame:
    """(nid, pred, p) of nodes whose largest class probability passes the threshold."""
    p = softmax(logits, ["nid"], "logit", "p")
    best = p.groupBy("nid").agg(F.max_by(F.struct("cls", "p"), F.struct("p", -F.col("cls"))).alias("b"))
    return best.select("nid", F.col("b.cls").alias("pred"), F.col("b.p").alias("p")).where(F.col("p") > threshold)


def refreshed_labels(logits: DataFrame, threshold: float) -> DataFrame:
    """Class probabilities as label features (nid, slot, col, val): those below the threshold count 0 and are left out."""
    p = softmax(logits, ["nid"], "logit", "p").where(F.col("p") >= threshold)
    return p.select("nid", F.lit("label").alias("slot"), F.col("cls").cast("int").alias("col"), F.col("p").alias("val"))


def cross_entropy(logits: DataFrame) -> DataFrame:
    """One row ``loss``: mean over nodes of log-sum-exp minus the true class's logit; of (nid, cls, logit, y)."""
    top = logits.groupBy("nid").agg(F.max("logit").alias("m"))
    per = logits.join(top, "nid").groupBy("nid").agg((F.first("m") + F.log(F.sum(F.exp(F.col("logit") - F.col("m")))) - F.max(F.when(F.col("cls") == F.col("y"), F.col("logit")))).alias("loss"))
    return per.agg(F.avg("loss").alias("loss"))


def soft_label_cross_entropy(logits: DataFrame, confidence: float = 0.0) -> DataFrame:
    """One row ``loss`` of (nid, cls, logit, y): mean cross-entropy against y over its sum, of nodes with any label.

    ``confidence`` times the mean log-softmax of all cells plus ln(classes) is taken off:
    the penalty of being too sure.
    """
    per = _log_mass(logits)
    y = F.nullif(F.col("mass"), F.lit(0.0))
    return _penalised(per.withColumn("loss", F.col("lse") - F.col("hit") / y), confidence)


def _log_mass(logits: DataFrame) -> DataFrame:
    """(nid, lse, hit, mass, cells, total): log-sum-exp, sums of y * logit, of y, of cells and of logits."""
    top = logits.groupBy("nid").agg(F.max("logit").alias("m"))
    y = F.col("y").cast("double")
    return logits.join(top, "nid").groupBy("nid").agg(
        (F.max("m") + F.log(F.sum(F.exp(F.col("logit") - F.col("m"))))).alias("lse"),
        F.sum(y * F.col("logit")).alias("hit"),
        F.sum(y).alias("mass"),
        F.count("*").alias("cells"),
        F.sum("logit").alias("total"),
    )


def _penalised(per: DataFrame, confidence: float) -> DataFrame:
    log_p = F.sum(F.col("total") - F.col("cells") * F.col("lse")) / F.sum("cells")
    return per.agg((F.avg("loss") - confidence * (log_p + F.log(F.max("cells").cast("double")))).alias("loss"))


def binary_cross_entropy(logits: DataFrame, confidence: float = 0.0) -> DataFrame:
    """One row ``loss`` of (logit, y): mean over cells, less ``confidence`` times the mean of ln p + ln(1 - p) plus ln 4."""
    sure = -(bce_with_logits(F.col("logit"), F.lit(0.0)) + bce_with_logits(F.col("logit"), F.lit(1.0)))
    loss = F.avg(bce_with_logits(F.col("logit"), F.col("y").cast("double")))
    return logits.agg((loss - confidence * (F.avg(sure) + F.log(F.lit(4.0)))).alias("loss"))


def node_homophily(pairs: DataFrame, labels: DataFrame, allow_self: bool = False) -> DataFrame:
    """One row: mean over destinations of the share of in-neighbours with the same label; pairs are (dst, src)."""
    pairs = pairs if allow_self else pairs.where("dst <> src")
    joined = _with_labels(pairs, labels)
    return joined.groupBy("dst").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("h")).agg(F.avg("h").alias("homophily"))


def edge_homophily(pairs: DataFrame, labels: DataFrame, allow_self: bool = False) -> DataFrame:
    """One row: share of pairs with the same label."""
    pairs = pairs if allow_self else pairs.where("dst <> src")
    return _with_labels(pairs, labels).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("homophily"))


def co_member_homophily(links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row node, edge: both homophilies over all pairs of nodes that share a middle node, no node with itself.

    ``links`` are (nid, mid), one middle node for each node, or else it's an error.  A
    node of a middle node with n labelled nodes, c of its own label, has n - 1
    neighbours and c - 1 alike: counts per (mid, label) do, and no pair is made.
    """
    one = F.when(F.count("*") == 1, F.min("mid")).otherwise(F.raise_error("a node has more than one middle node"))
    mids = links.select("nid", "mid").distinct().groupBy("nid").agg(one.alias("mid"))
    own = mids.join(labels.select("nid", "label"), "nid").where("label is not null").groupBy("mid", "label").agg(F.count("*").alias("c"))
    all_ = own.groupBy("mid").agg(F.sum("c").alias("n"))
    both = own.join(all_, "mid").where("n > 1").select("c", (F.col("c") - 1).alias("alike"), (F.col("n") - 1).alias("others"))
    node = F.sum(F.col("c") * F.col("alike") / F.col("others")) / F.sum("c")
    edge = F.sum(F.col("c") * F.col("alike")) / F.sum(F.col("c") * F.col("others"))
    return both.agg(node.alias("node"), edge.alias("edge"))


def _with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("nid").alias("dst"), F.col("label").alias("a"))
    b = labels.select(F.col("nid").alias("src"), F.col("label").alias("b"))
    return pairs.join(a, "dst").join(b, "src")


def multi_label_edge_homophily(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: over pairs and classes, both ends have it / either has it; labels are arrays of 0 and 1."""
    j = _with_labels(pairs.where("dst <> src"), labels)
    both = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with("a", "b", lambda x, y: F.greatest(x, y)), F.lit(0), lambda s, x: s + x)
    return j.agg((F.sum(both) / F.sum(either)).alias("homophily"))


def multi_label_node_homophily(pairs: DataFrame, labels: DataFrame, mode: str = "pos", allow_self: bool = False) -> DataFrame:
    """(cls, homophily): mean over nodes of the share of in-neighbours that agree with them on a class.

    ``pos``: of the nodes that have the class, ``neg``: of those that haven't, ``both``:
    of all.  Labels are arrays of 0 and 1; pairs are (dst, src).  Nodes of any pair
    count, those without in-neighbours with share 0; with allow_self all nodes do.
    Neighbours are counted per class and node, so no pair carries its own classes twice.
    """
    if mode not in ("pos", "neg", "both"):
        raise ValueError(mode)
    pairs = pairs.select("dst", "src") if allow_self else pairs.where("dst <> src").select("dst", "src")
    cells = labels.select("nid", F.posexplode("label").alias("cls", "y"))
    have = pairs.join(cells.where("y = 1").select(F.col("nid").alias("src"), "cls"), "src").groupBy("dst", "cls").agg(F.count("*").alias("have"))
    degree = pairs.join(labels.select(F.col("nid").alias("src")), "src", "left_semi").groupBy("dst").agg(F.count("*").alias("d"))
    if not allow_self:
        cells = cells.join(pairs.select(F.explode(F.array("dst", "src")).alias("nid")).distinct(), "nid", "left_semi")
    all_ = cells.join(degree.withColumnRenamed("dst", "nid"), "nid", "left").join(have.withColumnRenamed("dst", "nid"), ["nid", "cls"], "left")
    have_, d = F.coalesce("have", F.lit(0)), F.coalesce("d", F.lit(0))
    share = F.coalesce(F.try_divide(F.when(F.col("y") == 1, have_).otherwise(d - have_), d), F.lit(0.0))
    counted = {"pos": F.col("y") == 1, "neg": F.col("y") == 0, "both": F.lit(True)}[mode]
    return all_.where(counted).groupBy("cls").agg(F.avg(share).alias("homophily"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
