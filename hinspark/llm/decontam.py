"""Benchmark decontamination: a broadcast set of hashed test n-grams, scanned over training text.

A window is ``size`` consecutive words of an item (lower-cased A-Z; words are
runs of ASCII letters and digits and of all characters beyond ASCII).  An item
of fewer words, but not none, is one window.  A word of a document that lies in
any occurrence of a window is hit.

Items are dealt by a hash into blocks of about ``block_bytes`` of text.  One block
goes through the driver and is broadcast at a time, as arrays: its texts, and for
each window a hash and a place.  One block is scanned in one pass without any
shuffle.  With more, the documents are written once with a row number, each block's
pass writes the hits of the rows that have any, and these small tables are
grouped by row and joined back.  What a machine holds doesn't grow with the benchmark.

Defined results: null text has no words and no hits; null benchmark text gives
no window; items that repeat an id count once; windows of an item without an id
hit words, but the item is in no list; repeated rows give equal results; empty
tables give empty results, or documents without hits; texts of any length are
scanned whole.  Other columns are carried through: the columns that
:func:`find_hits` and :func:`report` add replace columns of the same name, and
:func:`remove_documents` and :func:`remove_spans` change no column but the text.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import arrays
from ..scratch import written

#: Bytes that make up words once A-Z is lower-cased: digits, letters, everything beyond ASCII.
WORD = arrays.byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

#: About this many bytes of the benchmark's text make a block; a longer item is a block of its own.
BLOCK_BYTES = 16 << 20

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_bytes", T.ArrayType(T.LongType())),
    ]
)
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]


class Windows:
    """The windows of a block of items as arrays: by length a bit table, sorted hashes, and each window's place and item."""

    BITS = 20

    def __init__(self, items: list[str | None], texts: list[str], size: int):
        self.items = items
        whole = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in whole]))).astype(np.int64)
        self.data = arrays.LOWER[np.frombuffer(b"".join(whole), dtype=np.uint8)]
        self.starts, self.ends, first = arrays.word_ranges(self.data, offsets, WORD)
        words = arrays.word_hashes(self.data, self.starts, self.ends)
        counts, lengths = np.diff(first), {}
        for m in np.unique(np.minimum(counts, size)).tolist():
            if m:
                mine = np.flatnonzero(np.minimum(counts, size) == m)
                n = counts[mine] - m + 1
                item = np.repeat(mine, n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[item]
                hashes = arrays.window_hashes(words, m)[at]
                order = np.argsort(hashes, kind="stable")
                bits = np.zeros(1 << self.BITS, dtype=bool)
                bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
                lengths[m] = (bits, hashes[order], at[order].astype(np.int32), item[order].astype(np.int32))
        self.lengths = lengths

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_said"}

    def scan(self, hashes: np.ndarray, m: int) -> np.ndarray:
        """Positions whose window hash is one of an item's."""
        bits, known, _, _ = self.lengths[m]
        at = np.flatnonzero(bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        place = np.searchsorted(known, hashes[at])
        place[place == len(known)] = 0
        return at[known[place] == hashes[at]]

    def owners(self, h: np.uint64, m: int, said: bytes) -> frozenset[str] | None:
        """The items with a window of this hash and these words, or None."""
        if not hasattr(self, "_said"):
            self._said: dict[tuple[int, int], dict[bytes, frozenset[str]]] = {}
        known = self._said.get((m, int(h)))
        if known is None:
            _, hashes, at, item = self.lengths[m]
            lists: dict[bytes, set[str]] = defaultdict(set)
            for k in range(int(np.searchsorted(hashes, h)), int(np.searchsorted(hashes, h, side="right"))):
                words = _joined(self.data, self.starts, self.ends, int(at[k]), m)
                lists[words] |= set() if self.items[item[k]] is None else {self.items[item[k]]}
            known = self._said[m, int(h)] = {words: frozenset(owners) for words, owners in lists.items()}
        return known.get(said)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, m: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[i : i + m].tolist(), ends[i : i + m].tolist(), strict=True))


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of each run of consecutive places."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate(([0], cut + 1))].tolist(), (at[np.concatenate((cut, [len(at) - 1]))] + 1).tolist(), strict=True))


def _scan_batch(column: pa.Array, block: Windows | None, given: list[list[int]] | None = None) -> tuple[list, list, list, list, list]:
    """n_words, n_hit, items, hit byte ranges and hit word ranges of each text of a column; ``given`` word ranges are hit as well."""
    n_words, n_hit, items, spans, ranges = [], [], [], [], []
    for lo, hi, data, offsets in arrays.chunks(column):
        data = arrays.LOWER[data]
        starts, ends, first = arrays.word_ranges(data, offsets, WORD)
        words = arrays.word_hashes(data, starts, ends) if block else starts
        n_words += np.diff(first).tolist()
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        found: dict[int, set[str]] = defaultdict(set)
        for m in block.lengths if block else ():
            hashes = arrays.window_hashes(words, m)
            at = block.scan(hashes, m)
            row_of = np.searchsorted(first, at, side="right") - 1
            inside = at + m <= first[row_of + 1]
            for i, row in zip(at[inside].tolist(), row_of[inside].tolist(), strict=True):
                owners = block.owners(hashes[i], m, _joined(data, starts, ends, i, m))
                if owners is not None:
                    cover[i] += 1
                    cover[i + m] -= 1
                    found[row] |= owners
        for row in range(hi - lo) if given else ():
            known = np.array(given[lo + row] or [], dtype=np.int64) + first[row]
            np.add.at(cover, known[::2], 1)
            np.add.at(cover, known[1::2], -1)
        hit = np.cumsum(cover[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        per_row = total[first[1:]] - total[first[:-1]]
        n_hit += per_row.tolist()
        for row in range(hi - lo):
            a, b = first[row], first[row + 1]
            runs = _runs(np.flatnonzero(hit[a:b])) if per_row[row] else []
            items.append(sorted(found[row]) if row in found else [])
            ranges.append([x for r in runs for x in r])
            spans.append([int(x - offsets[row]) for p, q in runs for x in (starts[a + p], ends[a + q - 1])])
    return n_words, n_hit, items, spans, ranges


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _with_hits(docs: DataFrame, bench: DataFrame, text: str, bench_text: str, bench_item: str, size: int, block_bytes: int) -> tuple[DataFrame, str]:
    """``docs`` with a struct of HITS in a column of a name of its own, and that name."""
    spark, columns = docs.sparkSession, docs.columns
    to, rid, given = (_free(c, columns) for c in ("__hits", "__row", "__given"))
    named = bench.select(F.col(bench_item).cast("string").alias("item"), F.col(bench_text).alias("text")).where("text is not null").distinct()
    n = max(1, -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))

    def broadcast(k: int):
        part = (named if n == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).toArrow()
        return spark.sparkContext.broadcast(Windows(part["item"].to_pylist(), part["text"].to_pylist(), size))

    def finished(rows: DataFrame, held, before: str | None) -> DataFrame:
        """One pass that makes the struct, from the one block or from the ranges and items of all."""
        schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(to, HITS)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(len(columns)).to_pylist() if before else None
                out = list(_scan_batch(batch.column(columns.index(text)), held.value if held else None, [x and x["ranges"] for x in known] if known else None)[:4])
                if known:
                    out[2] = [sorted(x["items"]) if x else [] for x in known]
                hits = pa.StructArray.from_arrays([pa.array(v, type=k) for v, k in zip(out, _KINDS, strict=True)], names=HITS.names)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], hits], names=[*columns, to])

        return arrays.batched(rows).mapInArrow(run, schema)

    if n == 1:
        return finished(docs, broadcast(0), None), to
    docs_, tables = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered"), []
    for k in range(n):
        held = broadcast(k)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, n_hit, items, _, ranges = _scan_batch(batch.column(1), held.value)
                rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, type=pa.list_(pa.string())), pa.array(ranges, type=pa.list_(pa.int64()))], names=["row", "items", "ranges"])
                yield rows.filter(pa.array([x > 0 for x in n_hit]))

        tables.append(written(arrays.batched(docs_.select(rid, text)).mapInArrow(scan, "row long, items array<string>, ranges array<long>"), "hits"))
        held.destroy()
    hits = functools.reduce(DataFrame.unionByName, tables)
    one = F.struct(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("ranges")).alias("ranges"))
    hits = hits.groupBy(F.col("row").alias(rid)).agg(one.alias(given))
    return finished(docs_.join(hits, rid, "left").select(*columns, given), None, given), to


def find_hits(docs: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", bench_item: str = "item_id", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and hit_bytes (byte ranges, flat), in place of columns of these names."""
    keep = [c for c in docs.columns if c == text or c not in HITS.names]
    hits, to = _with_hits(docs.select(*keep), bench, text, bench_text, bench_item, size, block_bytes)
    return hits.select(*keep, *(F.col(f"{to}.{c}").alias(c) for c in HITS.names))


def report(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs.select("doc_id", "text"), bench, **kw)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", bench_item: str = "item_id", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit."""
    hits, to = _with_hits(docs, bench, text, bench_text, bench_item, size, block_bytes)
    return hits.where(F.col(f"{to}.n_hit") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", bench_item: str = "item_id", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents, with the hit stretches of each text cut out (and one space left between the parts)."""
    hits, to = _with_hits(docs, bench, text, bench_text, bench_item, size, block_bytes)
    raw, spans = F.col(text).cast("binary"), F.col(f"{to}.hit_bytes")
    ends = F.concat(F.array(F.lit(0).cast("long")), spans, F.array(F.octet_length(text).cast("long")))
    pieces = F.transform(
        F.sequence(F.lit(0), (F.size(spans) / 2).cast("int")),
        lambda i: F.trim(F.substring(raw, (ends[2 * i] + 1).cast("int"), (ends[2 * i + 1] - ends[2 * i]).cast("int")).cast("string")),
    )
    cut = F.array_join(F.filter(pieces, lambda p: p != ""), " ")
    return hits.withColumn(text, F.when(F.col(f"{to}.n_hit") > 0, cut).otherwise(F.col(text))).select(*docs.columns)
