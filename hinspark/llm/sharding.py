"""Shards that each hold the same mixture of sources, by proportional stratified interleaving.

1. Rows are sorted by (source, seeded hash of the key) in ranges, so a source of any
   size is spread over tasks.  A row's rank within its source is its place less the
   place where the source begins; both come from counts of ranges, not of rows.
2. Its fractional rank, (rank + phase) / rows of its source, spreads every source
   evenly over 0 to 1.  Phases are even steps from 0 to 1, dealt to the sources by a
   seeded hash, so many small sources don't lie at the same points.  Rows are sorted
   by it, again in ranges, and numbered.
3. The line is cut into shards whose numbers of rows differ by one at most.  Up to
   any point of the line a source has its share of rows to within one, so each
   shard's mixture is that of the whole, but for one row or so of each source.

Only one row for each range, and for each range and source in it, is summed; no
window runs over a source or over all rows.  Equal texts are rows like any others:
a group of copies is spread as its sources are.

Defined results: a null source is a source of its own; a null text has no bytes; rows
with a null key, or the same key, are ordered by what else they hold, and rows equal
in everything may change places with each other; an empty table gives an empty one;
all columns are carried through, but for columns of the names of the results, which
are replaced.  Texts are only read for their size and checksum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import hash_order
from ..scratch import written

#: Rows of the table of sources that are broadcast at most; beyond, a shuffled join fetches them.
MAX_BROADCAST_SOURCES = 100_000


def _numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows sorted by ranges, with __range and __at; (__range, __first, __start)): a row's place is __start + __at - __first.

    Written, as bounds of ranges are sampled and must not be drawn twice.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = written(ranges.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)
    parts = tagged.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    return tagged, parts.select("__range", "__first", F.coalesce(before, F.lit(0)).alias("__start"))


def with_places(rows: DataFrame, order: list[Column], to: str, name: str = "places") -> DataFrame:
    """``rows`` with their number, from 0 without gaps, in an order."""
    tagged, starts = _numbered(rows, order, name)
    placed = tagged.join(F.broadcast(starts), "__range")  # a row for each range
    return placed.withColumn(to, F.col("__start") + F.col("__at") - F.col("__first")).drop("__range", "__at", "__first", "__start")


def interleaved(rows: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with the shard, 0 to n_shards - 1, and the slot in it, from 0 without gaps."""
    if n_shards < 1:
        raise ValueError("there must be a shard")
    rows = rows.drop(shard, slot)
    more = [F.col(c) for c, kind in rows.dtypes if c not in (stratum, key) and not kind.startswith(("map", "variant"))]
    tie = [F.col(key), F.xxhash64(*more)] if more else [F.col(key)]
    shuffled = hash_order(F.col(key), seed=seed)
    placed = with_places(rows, [F.col(stratum), shuffled, *tie], "__rank", "by-source")
    # a source's rows follow each other: its first place and its number of rows
    sources = placed.groupBy(F.col(stratum).alias("__s")).agg(F.min("__rank").alias("__from"), F.count("*").alias("__n"))
    sources = with_places(sources, [hash_order(F.col("__s"), seed=seed), F.col("__s")], "__i", "sources")
    n_sources = sources.count()
    if n_sources <= MAX_BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    ranked = placed.join(sources, F.col(stratum).eqNullSafe(F.col("__s")))
    ranked = ranked.withColumn("__f", (F.col("__rank") - F.col("__from") + (F.col("__i") + 0.5) / max(n_sources, 1)) / F.col("__n")).drop("__s", "__i", "__from", "__n", "__rank")
    line = with_places(ranked, [F.col("__f"), F.col(stratum), shuffled, *tie], "__place", "interleaved")
    n = F.broadcast(line.agg(F.count("*").alias("__n")))  # one row
    cut = F.expr(f"__place * {n_shards} div __n")
    first = F.expr(f"(__cut * __n + {n_shards - 1}) div {n_shards}")
    done = line.crossJoin(n).withColumn("__cut", cut).withColumns({shard: F.col("__cut").cast("int"), slot: (F.col("__place") - first).cast("long")})
    return done.drop("__f", "__place", "__n", "__cut")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the UTF-8 bytes of the text and one more, and ``text_crc32``."""
    whole = F.coalesce(text, F.lit(""))
    return docs.withColumns({"size": (F.octet_length(whole) + 1).cast("long"), "text_crc32": F.crc32(whole.cast("binary"))})


def write_shards(docs: DataFrame, path: str, n_shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 0) -> None:
    """A folder for each shard, ``shard=0`` and so on, with Parquet files whose rows are in the order of their slots, which they hold.

    Files are ranges of slots, so a shard of any size is written by several tasks.
    """
    line = interleaved(docs, n_shards, stratum, key, seed)
    line.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assignment(docs: DataFrame, n_shards: int = 8, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards hold equal numbers of rows, to within one."""
    thin = sized(docs).select("doc_id", "source", "size", "text_crc32")
    line = interleaved(thin, n_shards, seed=seed)
    return line.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
