"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of characters other than ASCII white space, lines are what ``\\n``
separates.  Each rule names a measure and the least and greatest values that pass;
all rules become one boolean expression over one struct of measures, evaluated by
Spark without any Python.  Arrays that several measures share are bound as lambda
arguments, so each is made once for a text, and the struct holds the partition's
number: Spark neither inlines nor repeats an expression that holds it, so a filter
on a measure or a verdict runs after the projection.  (A filter on another column
stays above it too; put it before :func:`judge`.)

Defined results: null text counts as text without words: all counts are 0 and the
base rule rejects it.  Ratios of a text without words are 0.  Texts of any length
are measured whole; repeated words are told by the words themselves.  Equal rows give
equal results; an empty table gives an empty one; other columns are carried
through, where the measures and verdicts replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Rule(NamedTuple):
    """A measure passes from ``least`` to ``most``; None is no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Frequent function words of the languages the rules are for.
STOP_WORDS = tuple((
    "the of and to in that is was for it with as be on by at this are or from an a "
    "le la les de des du et en un une que qui dans pour est sur pas par au avec "
    "der die das und in den von zu mit sich ist im nicht ein eine dem auf für als "
    "el los las del y que un una se por con no su para es al lo como"
).split())

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: ASCII white space.
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: The production table.  A text must pass every row.
RULES = (
    Rule("mean_word_length", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("mean_line_words", 2.0, None),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*COUNTS, "mean_word_length", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "mean_line_words")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _neighbours(s: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The places, in order, of the elements of a sorted array that are the same as the one before or after."""
    beside = lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))
    return F.sort_array(F.transform(F.filter(s, beside), lambda x: x["i"]))


def _repeats(words: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """The places of the windows of three words that the text has twice or more, in order.

    Hashes tell most texts without any; else equal hashes are neighbours once
    sorted.  Should neighbours of one hash differ in a word, the windows are
    sorted again by hash and words.
    """
    places = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    window = lambda i: F.slice(words, i + 1, F.lit(3))
    of_words = F.transform(places, lambda w, i: F.struct(hashed(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), window(i).alias("w"), i.alias("i")))
    exactly = _let(F.sort_array(of_words), lambda s: _neighbours(s, lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])))
    collides = lambda s: F.size(F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i - 1)["h"]) & (window(x["i"]) != window(F.get(s, i - 1)["i"])), F.lit(False)))) > 0
    sorted_ = lambda hashes: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    told = lambda s: F.when(collides(s), exactly).otherwise(_neighbours(s, lambda a, b: a["h"] == b["h"]))
    hashes = F.transform(places, lambda w, i: hashed(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<int>")).otherwise(_let(sorted_(h), told)))


def _covered(places: Column) -> Column:
    """Words in the windows of three at these places: each adds those that the one before it doesn't reach."""
    return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(places, i - 1), F.lit(-3)))), F.lit(0), lambda a, x: a + x)


def _measured(text: Column, stop_words: tuple[str, ...]) -> Column:
    """One struct of all counts and ratios."""
    spaces = "[\\x20\\x09-\\x0D]+"
    split = lambda r: F.struct(
        r["t"].alias("t"),
        F.filter(F.split(r["t"], spaces), lambda w: w != "").alias("words"),
        F.filter(F.split(r["t"], "\n"), lambda line: _without(line, WHITE_SPACE) != "").alias("lines"),
        r["part"].alias("part"),
    )
    counted = lambda r: F.struct(
        F.size(r["words"]).cast("long").alias("n_words"),
        F.length(_without(r["t"], WHITE_SPACE)).cast("long").alias("word_chars"),
        (F.length(r["t"]) - F.length(_without(r["t"], SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(r["lines"]) - F.size(F.array_distinct(r["lines"]))).cast("long").alias("n_dup_lines"),
        _let(_let(r["words"], _repeats), _covered).cast("long").alias("n_repeat_words"),
        F.aggregate(r["words"], F.lit(0), lambda n, w: n + F.lower(w).isin(*stop_words).cast("int")).alias("stops"),
        F.size(r["lines"]).alias("n_lines"),
        r["part"].alias("part"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    with_ratios = lambda m: F.struct(
        *(m[c].alias(c) for c in COUNTS),
        share(m["word_chars"], m["n_words"]).alias("mean_word_length"),
        share(m["n_symbols"], m["n_words"]).alias("symbol_ratio"),
        share(m["stops"], m["n_words"]).alias("stop_word_ratio"),
        share(m["n_dup_lines"], m["n_lines"]).alias("dup_line_ratio"),
        share(m["n_words"], m["n_lines"]).alias("mean_line_words"),
        m["part"].alias("part"),
    )
    begun = F.struct(F.coalesce(text, F.lit("")).alias("t"), F.spark_partition_id().alias("part"))
    return _let(_let(_let(begun, split), counted), with_ratios)


def measure(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts and the ratios that rules can name.

    ``stop_words`` are those of the languages that the rules are for; a text in
    another language has few of them.
    """
    measured = docs.select(*(docs[c] for c in docs.columns if c not in MEASURES), _measured(docs[text], stop_words).alias("__measures"))
    return measured.select(*(c for c in measured.columns if c != "__measures"), *(F.col(f"__measures.{c}").alias(c) for c in MEASURES))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """All rules as one boolean expression over the measures."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.most)
    return verdict


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    measured = measure(docs, text, stop_words).withColumn("base_failed", base_failed())
    return measured.withColumn("kept", ~F.col("base_failed") & compiled(rules))
