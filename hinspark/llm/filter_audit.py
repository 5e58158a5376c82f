"""How document filters interact: what each removes, in every order they could be applied.

Each filter is a condition under which a document fails.  All of them are judged on
every document at once and kept as one bit each of a failure mask.  The one filter
that depends on other documents, "the same text has a smaller doc_id", needs the
least doc_id of each text: a grouped minimum over digests of texts, combined before
the shuffle, which comes back to the documents by (digest, doc_id), a key that no
group of copies makes hot.

Documents with the same mask fare alike under any order, so each part is then 32
cells of counts, and every order of five filters is enumerated from the cells: what
a step does depends on the set of filters before it and its own filter only.

All steps are built-in functions.  Defined results: a null text is empty, a null part
is the empty string; a document without a doc_id is no copy of another and none is a
copy of it; repeated rows of one doc_id count each and are no copies of each other;
several labels of a document count as one, set where any is; texts are judged whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import written

#: Filters of the audit, by letter: each fails a document of these measures.
FILTERS = "ABCDE"
COPY = "E"

#: ASCII white space that parts words, and the symbols of filter D.
WHITE_SPACE = "\t\n\x0b\x0c\r"
SYMBOLS = "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions on a text itself: few words, few different words, many capitals, a symbol."""
    words = F.array_remove(F.split(F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE)), " "), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def failure_masks(docs: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of every row: bit i is set if the document fails the i-th filter."""
    whole = F.coalesce(text, F.lit(""))
    bits = [F.when(failed, 1 << FILTERS.index(name)).otherwise(0) for name, failed in text_failures(whole).items()]
    thin = written(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(whole, 256).alias("h"), sum(bits[1:], bits[0]).alias("own")), "masks")
    least = thin.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index(COPY)).otherwise(0)
    return thin.join(least, ["h", "doc_id"], "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and those labelled good or toxic."""
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = masks.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _situations(names: str) -> Column:
    """One struct for each filter and set of filters before it, with the orders in which that happens."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    orders: dict[tuple[int, str, int], list[str]] = {}
    for order in permutations(names):
        for i, f in enumerate(order):
            orders.setdefault((sum(bit[x] for x in order[:i]), f, i + 1), []).append("".join(order))
    assert len(orders) == sum(comb(len(names) - 1, i) for i in range(len(names))) * len(names)
    return F.array(*(F.struct(F.lit(before).alias("before"), F.lit(bit[f]).alias("bit"), F.lit(step).alias("step"), F.array(*map(F.lit, found)).alias("orders")) for (before, f, step), found in orders.items()))


def interactions(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters.

    A part's cells are one array of at most two to the number of filters; no row of a
    document is touched again.  ``shapley`` is what the filter removes over all orders:
    of documents that fail k filters, each of the k is first in one k-th of them.
    """
    if len(names) > 6:
        raise ValueError("every order is listed: 6 filters at most")
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    x = per_part.select("part", "cells", F.explode(_situations(names)).alias("x")).select("part", "cells", "x.*")
    before, bit = F.col("before"), F.col("bit")

    def total(which, count=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + count(c))

    has = lambda c, b: c["mask"].bitwiseAND(b) != 0
    gone = lambda c: has(c, bit) & ~has(c, before)
    orders = F.lit(factorial(len(names))).cast("long")
    done = x.select(
        "part",
        F.explode("orders").alias("filter_order"),
        "step",
        total(lambda c: ~has(c, before.bitwiseOR(bit))).alias("kept"),
        total(gone).alias("removed"),
        total(lambda c: has(c, bit) & has(c, before)).alias("redundant"),
        total(lambda c: c["mask"] == bit).alias("unique_fails"),
        total(gone, lambda c: c["good"]).alias("good_lost"),
        total(gone, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: has(c, bit), lambda c: c["n"] * (orders / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )
    return done


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """The interactions of the five filters over all documents."""
    return interactions(cells(failure_masks(docs, text, part), labels))
