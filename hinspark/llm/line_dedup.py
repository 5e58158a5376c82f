"""Line deduplication by a deletion-neighbourhood join.

A line (its outer ASCII spaces and tabs trimmed) is dropped when an earlier line,
by (doc_id, place in the document), is equal to it or, for lines of at least
``min_chars`` characters, within one edit.  All steps are built-in functions.

1. Equal lines are one, with its earliest place.
2. A filter without loss: two lines within one edit agree outside a stretch of
   one of them, so they share a key made of all but one half of the line, then of
   all but an eighth, and so on by quarters while a stretch is longer than
   ``MAX_HOLE`` characters.  Only lines that share such a key with another go on.
3. The deletion neighbourhood of those lines, inside the shared stretch: every
   variant with one character deleted, and the line itself, as hashed keys.
   Variants with the place of the deletion in the key join lines that differ by
   a substitution, those without it a line and the lines with one character more.
4. In each list of equal variants every line is paired with the earliest line
   it can match only, so a list of any length gives no more pairs than lines.
   The pairs are verified on the lines themselves: the edit's kind and place are
   known, and without it both must be equal.

Keys are counted by grouped minima and maxima, which are combined before the shuffle,
so a key that very many lines share is no task's burden.  A line is read whole for each
stretch that it shares at a step, and each step has stretches a quarter as long; the
pair of lines that share one share no other at that step, in runs of one character too.

With one edit allowed at any length, short lines match often: "2." goes after "1.", and
"Page 2" after "Page 1".  ``min_chars`` sets a least length for that.

Defined results: a line without a visible character is always kept and matches
nothing; null text stays null; rows without a doc_id are left as they are and are
compared with nothing; repeated rows of one id tie, and both keep what is theirs;
lines of any length are compared whole; an empty table gives an empty one; other
columns are carried through, where the two counts replace columns of their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import dropped, written

#: Lines' places are broadcast to fetch their texts while there are at most this many; beyond, a shuffled join does.
MAX_BROADCAST_LINES = 500_000

#: Keys that lines share are broadcast while there are at most this many (16 MB); beyond, a shuffled join does.
MAX_BROADCAST_KEYS = 1_000_000

#: Characters of the stretch in which variants are made.
MAX_HOLE = 64


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _key(line: Column, n: Column, m: Column, a: Column, b: Column) -> Column:
    """Hash of a line of n characters outside [a, b) of its m-character form: the first a and the last m - b characters."""
    return F.xxhash64(m, a, F.substring(line, F.lit(1), a), F.substring(line, n - (m - b) + 1, m - b))


def _without(line: Column, n: Column, i: Column) -> Column:
    """A line of n characters without the one at place i."""
    return F.concat(F.substring(line, F.lit(1), i), F.substring(line, i + 2, n))


def _begins_run(line: Column, a: Column, z: Column) -> Column:
    """Whether a run of equal characters begins at one of the places a to z of a line."""
    inside = F.substring(line, a, z - a + 2)
    return (a == 0) | (F.replace(inside, F.substring(inside, 1, 1), F.lit("")) != "")


def _lines(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    return rows.select("doc_id", "pos", _trimmed(F.col("raw")).alias("line")).where("line <> ''")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key another line has too."""
    dup = written(keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"), "keys")
    if dup.count() <= MAX_BROADCAST_KEYS:
        dup = F.broadcast(dup)
    return keys.join(dup, "key", "left_semi")


def _first_lines(docs: DataFrame, text: str) -> DataFrame:
    """(h1, h2, n, doc_id, pos, k0..k3) of each different line, at its earliest place."""
    line, n = F.col("line"), F.col("n")
    lines = _lines(docs, text).withColumn("n", F.length("line"))
    half = lambda m, b: _key(line, n, m, F.when(F.lit(b == 0), F.lit(0)).otherwise((m / 2).cast("int")), F.when(F.lit(b == 0), (m / 2).cast("int")).otherwise(m))
    keys = {f"k{2 * d + b}": half(n - d, b) for d in (0, 1) for b in (0, 1)}
    keys["k3"] = F.when(_begins_run(line, ((n - 1) / 2).cast("int"), n - 1), keys["k3"])
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "n", F.struct("doc_id", "pos").alias("at"), *(v.alias(k) for k, v in keys.items()))
    firsts = hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("n", *keys)))
    return firsts.select("h1", "h2", "n", "at.doc_id", "at.pos", *keys)


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """The lines at the wanted (doc_id, pos, h1), with their texts."""
    if wanted.count() <= MAX_BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    lines = _lines(docs, text).withColumn("h1", F.xxhash64("line"))
    return lines.join(wanted, ["doc_id", "pos", "h1"])


def _near(docs: DataFrame, firsts: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h1, h2) of the different lines that have an earlier one at one edit."""
    line, n, m = F.col("line"), F.col("n"), F.col("m")
    # halves: hole b of class m, where m is the length of the shorter line of a pair
    holes = F.explode(F.array(*(F.struct(F.col(f"k{2 * d + b}").alias("key"), F.lit(d).alias("d"), F.lit(b).alias("b")) for d in (0, 1) for b in (0, 1))))
    halves = firsts.where(F.col("n") >= min_chars).select("h1", "h2", "n", "doc_id", "pos", holes.alias("x")).select("h1", "h2", "n", "doc_id", "pos", "x.*")
    halves = _shared(halves.where("key is not null"))
    wanted = written(halves.groupBy("h1", "h2", "n", "doc_id", "pos").agg(F.collect_set(F.struct("d", "b")).alias("holes")), "halves")
    lines = written(_texts(docs, wanted, text).select("h1", "h2", "n", "doc_id", "pos", "line", "holes"), "lines")
    # the shared stretch [a, z) of class m, in four again while it is long
    start = F.when(F.col("x.b") == 0, F.lit(0)).otherwise((m / 2).cast("int"))
    end = F.when(F.col("x.b") == 0, (m / 2).cast("int")).otherwise(m)
    stretches = lines.select("h1", "h2", "n", F.explode("holes").alias("x")).withColumn("m", F.col("n") - F.col("x.d")).withColumns({"a": start, "z": end}).drop("x")
    texts, short = lines.select("h1", "h2", "line"), []
    while True:
        cut = lambda q: (F.col("a") + (F.col("z") - F.col("a")).cast("long") * q / 4).cast("int")
        parts = stretches.join(texts, ["h1", "h2"]).withColumn("q", F.explode(F.array(*map(F.lit, range(4)))))
        parts = parts.select("h1", "h2", "n", "m", "line", cut(F.col("q")).alias("a"), cut(F.col("q") + 1).alias("z"))
        parts = parts.where((n == m) | _begins_run(line, F.col("a"), F.col("z")))
        keyed = written(parts.select("h1", "h2", "n", "m", "a", "z", _key(line, n, m, F.col("a"), F.col("z")).alias("key")), "keyed")
        parts = written(_shared(keyed), "stretches")
        dropped(keyed)
        short.append(parts.where(F.col("z") - F.col("a") <= MAX_HOLE))
        stretches = parts.where(F.col("z") - F.col("a") > MAX_HOLE).drop("key")
        if stretches.isEmpty():
            break
    holes = functools.reduce(DataFrame.unionByName, short).select("h1", "h2", "m", "a", "z", "key")
    # the neighbourhood inside the stretch, which for the longer line of a pair has one character more
    inside = lines.select("h1", "h2", "n", "doc_id", "pos", "line").join(holes, ["h1", "h2"])
    inside = inside.withColumn("before", F.substring(line, F.col("a"), 1)).withColumn("line", F.substring(line, F.col("a") + 1, F.col("z") - F.col("a") + n - m))
    size, last = F.length("line"), F.length("line") - 1
    hashed = lambda *of: F.xxhash64("key", "a", "z", *of)
    variant = lambda key, role, i: F.struct(key.alias("key"), F.lit(role).alias("role"), i.alias("i"))
    every = F.sequence(F.lit(0), last)
    substituted = F.transform(every, lambda i: variant(hashed(F.lit(2), i, _without(line, size, i)), 2, F.col("a") + i))
    itself = F.array(variant(hashed(F.lit(1), line), 0, F.lit(-1)))
    begins = lambda i: F.when(i == 0, (F.col("a") == 0) | (F.col("before") != F.substring(line, 1, 1))).otherwise(F.substring(line, i, F.lit(1)) != F.substring(line, i + 1, F.lit(1)))
    shorter = F.transform(F.filter(every, begins), lambda i: variant(hashed(F.lit(1), _without(line, size, i)), 1, F.col("a") + i))
    of_class = F.when(n > m, shorter).when(size > 0, F.concat(itself, substituted)).otherwise(itself)
    variants = inside.select("h1", "h2", "doc_id", "pos", F.explode(of_class).alias("x")).groupBy("h1", "h2", "doc_id", "pos", "x.key", "x.role").agg(F.min("x.i").alias("i"))
    variants = written(variants.select("key", "role", "i", F.struct("doc_id", "pos", "h1", "h2", "i").alias("at")), "variants")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("at")))
    firsts_of = variants.groupBy("key").agg(least(2).alias("with_sub"), least(0).alias("with_self"), least(1).alias("with_longer"))
    partner = F.when(F.col("role") == 2, F.col("with_sub")).when(F.col("role") == 1, F.col("with_self")).otherwise(F.col("with_longer"))
    pairs = variants.join(firsts_of, "key").withColumn("partner", partner).where("partner is not null and (partner.doc_id, partner.pos) < (at.doc_id, at.pos)")
    pairs = pairs.select("at.h1", "at.h2", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2"), "role", "i", F.col("partner.i").alias("pi")).distinct()
    # the edit is known by its kind and place: equal without it
    other, earlier = lines.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("line").alias("earlier")), F.col("earlier")
    mine = F.when(F.col("role") == 0, line).otherwise(_without(line, F.length("line"), F.col("i")))
    theirs = F.when(F.col("role") == 1, earlier).otherwise(_without(earlier, F.length("earlier"), F.col("pi")))
    verified = pairs.join(lines.select("h1", "h2", "line"), ["h1", "h2"]).join(other, ["p1", "p2"]).where(mine == theirs)
    near = written(verified.select("h1", "h2").distinct(), "near")
    dropped(wanted, lines, variants)
    return near


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = 0, max_edits: int = 1, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with n_lines, n_dropped (in place of columns of these names), and their text without the lines that an earlier line matches.

    ``max_edits`` is 0 (equal lines only) or 1.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    firsts = written(_first_lines(docs, text), "firsts")
    stay = firsts
    if max_edits:
        stay = firsts.join(_near(docs, firsts, text, min_chars), ["h1", "h2"], "left_anti")
    kept = stay.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("pos", "h1"))).alias("__kept"))
    joined = docs.join(kept, F.col("doc_id") == F.col("__id"), "left")
    joined = joined.withColumn("__lines", F.split(F.col(text), "\n"))
    lines = F.col("__lines")
    own = F.filter(F.coalesce("__kept", F.array().cast("array<struct<pos:int,h1:bigint>>")), lambda k: F.xxhash64(_trimmed(F.get(lines, k["pos"]))) == k["h1"])
    blank = F.filter(F.transform(lines, lambda line, i: F.when(_trimmed(line) == "", i)), lambda i: i.isNotNull())
    places = F.array_sort(F.concat(F.transform(own, lambda k: k["pos"]), blank))
    joined = joined.withColumn("__places", F.when(F.col("doc_id").isNotNull(), places))
    changed = F.col("__places").isNotNull() & (F.size("__places") < F.size("__lines"))
    joined = joined.withColumns(
        {
            n_lines: F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long"),
            n_dropped: F.when(changed, F.size("__lines") - F.size("__places")).otherwise(0).cast("long"),
            text: F.when(changed, F.array_join(F.transform("__places", lambda p: F.get(lines, p)), "\n")).otherwise(F.col(text)),
        }
    )
    return joined.select(*docs.columns, *(c for c in (n_lines, n_dropped) if c not in docs.columns))


def without_repeated_lines(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents with their remaining lines; one that loses its last line with a visible character goes."""
    done = dedup_lines(docs, text, n_lines="__n_lines", n_dropped="__n_dropped", **kw)
    visible = F.length(F.translate(F.col(text), " \t\r\n\x0b\x0c", "")) > 0
    # a partition id in the condition keeps the filter above the projection: pushed below, it would split a text again for each line
    done = done.withColumn("__part", F.spark_partition_id())
    return done.where(((F.col("__n_dropped") == 0) | visible) & (F.col("__part") >= 0)).select(*docs.columns)
