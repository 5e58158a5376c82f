"""N-gram Jaccard self-join of documents by grouped prefixes, and the groups it links.

A document's set holds its distinct ``n``-word shingles (words: runs of
characters other than ASCII white space, A-Z lower-cased; a text of fewer words
is one shingle).  Two documents link when 100 * |intersection| is at least
``percent`` * |union|.  Every link between different texts is found, either as a
verified pair or through verified pairs that join the same component.

1. A fixed-size table of counts over all shingles orders them, rare ones first
   (any order gives the same links; this one keeps shared passages out of the
   prefixes).
2. Each document gets its set's size, its prefix (with fewer shared prefix
   shingles no link is possible), a parity bitmap and checksums of both.
   Documents of one set are one class; classes of one size and prefix are one
   group.
3. Groups that share a prefix shingle are first compared with one leader of that
   shingle's list only, the one that has it earliest in its prefix, and classes
   with the first of their group.  Verified pairs give components.
4. Lists that still hold several components are joined in full, between
   components, under the size, position and bitmap filters; groups are expanded
   to their classes and the rest is verified.  A list of near copies is one
   component by then, so its pairs are never all made.  A long list is cut into
   blocks by component, and each pair of blocks is a join key of its own, so no
   task meets more than two blocks, whatever list they are of.

Sets are compared by 64-bit shingle hashes, classes by 128-bit checksums.

Defined results: a text without words, or null, has an empty set and no links;
a null id has its component's smallest id, or null where no document has one;
rows that share an id are one document to other documents; empty tables give
empty results; texts of any length are read whole; other columns are not used.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays
from .components import components
from ..scratch import dropped, written

_U = np.uint64

#: Cells of the table of shingle counts, whatever the input: 4 MB.
SKETCH_BITS = 20
_SLICES = 64
#: Tables of counts that one task adds up at a time.
_FAN_IN = 256

#: Rows of a list that meet under one join key, from either side, about.
BLOCK_ROWS = 2048

#: Candidate ids are broadcast to fetch their texts while there are at most this many (16 MB); beyond, a shuffled join does.
MAX_BROADCAST_IDS = 1_000_000


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, offsets in arrays.chunks(column):
        starts, ends, first = arrays.word_ranges(data, offsets, arrays.NOT_SPACE)
        words = arrays.word_hashes(arrays.LOWER[data], starts, ends)
        shingles = arrays.window_hashes(words, n)
        for row in range(hi - lo):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= n:
                yield np.unique(shingles[a : b - n + 1])
            else:
                yield arrays.window_hashes(words[a:b], b - a) if b > a else np.zeros(0, dtype=_U)


def _shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles fall into each cell, over all documents; added up in a tree of tasks."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, dtype=np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [s >> _U(64 - SKETCH_BITS) for s in _sets(batch.column(0).slice(lo, 256), n)]
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=size).astype(np.uint64)
        cells = np.minimum(total, 2**32 - 1).astype(np.uint32).reshape(_SLICES, -1)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), type=pa.int32()), pa.array([task] * _SLICES, type=pa.int64()), pa.array([c.tobytes() for c in cells], type=pa.binary())], names=["slice", "task", "cells"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size // _SLICES, dtype=np.uint64)
        for cells in pdf["cells"]:
            total += np.frombuffer(cells, dtype=np.uint32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "task": pdf["task"].iloc[:1] // _FAN_IN, "cells": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    schema = "slice int, task long, cells binary"
    texts = docs.select("text")
    parts, tasks = arrays.batched(texts).mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("slice", F.floor(F.col("task") / _FAN_IN).alias("to")).applyInPandas(lambda key, pdf: add(pdf), schema)
        tasks = -(-tasks // _FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros((_SLICES, size // _SLICES), dtype=np.uint32)
    for row in parts.collect():  # 4 MB, whatever the input
        out[row["slice"]] = np.frombuffer(row["cells"], dtype=np.uint32)
    return out.reshape(-1)


def _checksum(values: np.ndarray, salt: int) -> int:
    return int(arrays.mix(values ^ _U(salt)).sum(dtype=_U).astype(np.int64))


def _signatures(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, p1, p2, prefix, bits) of each document."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    key = docs.select("doc_id")
    kind = key.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sums, prefixes, bitmaps = [], [], []
                for values in _sets(part.column(1), n):
                    size = len(values)
                    if not size:
                        sums.append((0, 0, 0, 0, 0))
                        prefixes.append(values.view(np.int64))
                        bitmaps.append(values.view(np.int64))
                        continue
                    order = np.lexsort((values, cells[(values >> _U(64 - SKETCH_BITS)).astype(np.int64)]))
                    prefix = values[order[: size - -(-percent * size // 100) + 1]]
                    width = max(64, 1 << int(size - 1).bit_length())
                    odd = np.bincount((values & _U(width - 1)).astype(np.int64), minlength=width) & 1
                    sums.append((size, _checksum(values, 0x51), _checksum(values, 0xA7C3), _checksum(prefix, 0x51), _checksum(prefix, 0xA7C3)))
                    prefixes.append(prefix.view(np.int64))
                    bitmaps.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
                columns = [pa.array([s[i] for s in sums], type=pa.int64()) for i in range(5)]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in values]))), type=pa.int32()), pa.array(np.concatenate(values), type=pa.int64())) for values in (prefixes, bitmaps)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *lists], names=["doc_id", "n", "s1", "s2", "p1", "p2", "prefix", "bits"])

    return arrays.batched(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, bits array<long>")


def _fold(bits: Column, to: Column) -> Column:
    """A parity bitmap of twice the width, at half its width: cells that meet are added modulo 2."""
    half = (F.size(bits) / 2).cast("int")
    folded = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > to, folded).otherwise(bits)


def _may_link(na: Column, nb: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """Whether bitmaps allow a link: sets differ in at least as many elements as parities do."""
    differ = F.aggregate(
        F.zip_with(_fold(bits_a, F.size(bits_b)), _fold(bits_b, F.size(bits_a)), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda s, x: s + x,
    )
    return F.lit(100 + percent) * differ <= F.lit(100 - percent) * (na + nb)


def _sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)


def _positions_fit(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether enough elements are left from the shared one on: (100 + p) * overlap >= p * (|a| + |b|)."""
    return F.lit(100 + percent) * F.least(na - pa_, nb - pb) >= F.lit(percent) * (na + nb)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets link; texts are fetched and cut into shingles for these classes only."""
    spark = docs.sparkSession
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ids")
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    known = docs.join(ids, F.col("doc_id") == F.col("cid"), "left_semi").unionByName(docs.where("doc_id is null"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = list(_sets(part.column(1), n))
                sums = [[_checksum(s, salt) for s in sets] for salt in (0x51, 0xA7C3)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, type=pa.int64()) for x in sums), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["s1", "s2", "elements"])

    sets = arrays.batched(known.select("doc_id", "text")).mapInArrow(cut, "s1 long, s2 long, elements binary").where("octet_length(elements) > 0")
    sets = written(sets.join(classes.select("s1", "s2", "cid"), ["s1", "s2"]).select("cid", "elements"), "sets")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("of_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("of_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    links = written(both.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long").distinct(), "links")
    dropped(sets)
    return links


def _between_components(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids of one list and different components that pass the filters.

    Rows have their list's number of ``blocks``.  A list of one block meets itself, and
    is shuffled once.  In a longer one a row goes into the block of its component's
    hash, on the left for every block to its right and the other way round, so that
    each pair of blocks meets under one key and each pair of rows once.
    """

    def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        filters = (
            (F.col("a.component") < F.col("b.component"))
            & _sizes_fit(F.col("a.n"), F.col("b.n"), percent)
            & _positions_fit(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent)
            & _may_link(F.col("a.n"), F.col("b.n"), F.col("a.bits"), F.col("b.bits"), percent)
        )
        same = functools.reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
        return a.alias("a").join(b.alias("b"), same & filters).select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))

    short, long = rest.where("blocks = 1").drop("blocks"), rest.where("blocks > 1")
    block = F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    cut = met(long.select("*", block.alias("i"), other.alias("j")), long.select("*", block.alias("j"), other.alias("i")), ["shingle", "i", "j"])
    return met(short, short, ["shingle"]).unionByName(cut).distinct()


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    counts = _shingle_counts(docs, n)
    sigs = written(_signatures(docs, n, percent, counts).withColumn("rid", F.coalesce("doc_id", "s1")), "signatures")
    some = sigs.where("n > 0")
    first = lambda *names: [F.first(c).alias(c) for c in names]
    classes = some.groupBy("s1", "s2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least_doc"), *first("n", "p1", "p2"))
    groups = some.groupBy("n", "p1", "p2").agg(F.min("rid").alias("gid"), F.first("prefix").alias("prefix"))
    classes = written(classes, "classes")

    # lists of the groups that share a prefix shingle; most shingles are in one document's prefix and go.  Counts are
    # added up before they are shuffled and joined back, so no task has to hold or sort a whole list
    shared = some.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("docs")).where("docs > 1").select("shingle")
    lists = groups.select("gid", "n", "p1", "p2", F.posexplode("prefix").alias("pos", "shingle")).join(shared, "shingle", "left_semi")
    lists = written(lists, "lists")

    # one leader for each list, the first class for each group
    place = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")
    leads = lists.groupBy("shingle").agg(F.min(place).alias("place"), F.min_by("gid", place).alias("lead"))
    leads = leads.select("shingle", "lead", F.shiftright("place", 32).alias("lead_pos"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).alias("lead_n"))
    star = lists.join(leads, "shingle").where("gid <> lead")
    star = star.where(_sizes_fit(F.col("n"), F.col("lead_n"), percent) & _positions_fit(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), percent))
    star = star.select(F.col("lead").alias("a"), F.col("gid").alias("b"))
    same = classes.join(classes.groupBy("n", "p1", "p2").agg(F.min("cid").alias("gid")), ["n", "p1", "p2"]).where("cid <> gid")
    pairs = star.unionByName(same.select(F.col("gid").alias("a"), F.col("cid").alias("b"))).distinct()
    bits = some.join(classes.select("s1", "s2", "cid"), ["s1", "s2"]).where("rid = cid").select("cid", "n", "bits")
    side = lambda c: bits.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent)).select("a", "b").distinct()
    links = _verified(written(pairs, "pairs"), classes, docs, n, percent)
    found = written(components(links), "components")

    # lists that still hold several components: all pairs between components that the filters let through
    placed = classes.join(found, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    placed = written(placed.select("cid", "n", "p1", "p2", "component"), "placed")
    spread = placed.groupBy("n", "p1", "p2").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).alias("blocks")
    listed = lists.join(spread, ["n", "p1", "p2"])
    open_ = listed.groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size")).where("low <> high").select("shingle", blocks)
    rest = lists.join(open_, "shingle").join(placed, ["n", "p1", "p2"]).select("shingle", "pos", "cid", "component", "n", "blocks")
    inner = placed.join(spread.where("low <> high").select("n", "p1", "p2", blocks), ["n", "p1", "p2"])
    rest = rest.unionByName(inner.select(F.xxhash64("n", "p1", "p2").alias("shingle"), F.lit(0).alias("pos"), "cid", "component", "n", "blocks"))
    rest = written(rest.join(bits.select("cid", "bits"), "cid"), "rest")
    more = _verified(written(_between_components(rest, percent), "pairs"), classes, docs, n, percent)
    found = components(links.unionByName(more))

    placed = classes.join(found, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = placed.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    by_set = placed.join(least, "component").select("s1", "s2", "component_id")
    linked = some.select("doc_id", "n", "s1", "s2").join(by_set, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sigs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, without those that link (directly or through others) to one of a smaller id; a null id stays only without links."""
    linked = link_documents(docs, n, percent)
    gone = written(linked.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
