"""Token counts of the documents in flat token files, which have no index.

A token file is unsigned little-endian 16- or 32-bit ids, each document followed by
an end-of-document id.  Files are cut into blocks of equal size; a task searches a
block for the separator with one vectorised comparison.  A document that runs across
blocks is stitched by a prefix scan over the blocks' summaries (separators, tokens
after the last one), which gives each block the number of documents before it and
the tokens that reach into it.

Defined results: an empty document counts 0; tokens after a file's last separator
are a last document with ``ended`` false; an empty file has no documents; null text
is written as an empty document; repeated rows are documents of their own; other
columns are not used; texts of any length are written whole; an empty table gives no
documents; a file whose size is no
multiple of the id's size is an error, as is an id of a text that is the separator or
doesn't fit the file's type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import arrays, files
from .bpe import encode_pieces
from ..scratch import new_path, written

#: Bytes of a block.
BLOCK_BYTES = 8 << 20

#: The separator of the 50,256-rank vocabularies, and the narrowest type that holds it.
END, KIND = 50256, "<u2"


def _fits(n: int, kind: str) -> bool:
    return 0 <= n <= np.iinfo(np.dtype(kind)).max


def write_tokens(docs: DataFrame, folder: str, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", end: int = END, kind: str = KIND) -> DataFrame:
    """Encode the texts into one flat file a task; returns (file, ordinal, key), the order in which they were written."""
    folder = files.qualified(docs.sparkSession, folder)
    if not _fits(end, kind):
        raise ValueError(f"the separator {end} doesn't fit {kind}")
    schema = f"file string, ordinal long, {key} {docs.select(key).dtypes[0][1]}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, keys = f"tokens-{TaskContext.get().partitionId():06d}.bin", []
        last = np.array([end], dtype=kind).tobytes()
        with files.committed(folder, name) as out:
            for batch in batches:
                for value in batch.column(1):
                    for ids in encode_pieces(value.as_py(), rank_file, pattern):
                        if len(ids) and not (_fits(int(ids.max()), kind) and (ids != end).all()):
                            raise ValueError(f"an id of this vocabulary is the separator {end}, or doesn't fit {kind}")
                        out.write(ids.astype(kind).tobytes())
                    out.write(last)
                keys.append(batch.column(0))
        n = 0
        for part in keys:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), type=pa.string()), pa.array(range(n, n + len(part)), type=pa.int64()), part], names=["file", "ordinal", key])
            n += len(part)

    return written(arrays.batched(docs.select(key, text)).mapInArrow(put, schema), "order")


def _sizes(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """(file, bytes) of each named file, looked up in tasks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files.opened(folder)
        for batch in batches:
            found = system.get_file_info([f"{path}/{n}" for n in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.size for x in found], type=pa.int64())], names=["file", "bytes"])

    return names.select("file").mapInArrow(look, "file string, bytes long")


def count_tokens(spark: SparkSession, folder: str, names: DataFrame, end: int = END, kind: str = KIND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of each document of the named files under ``folder``."""
    folder = files.qualified(spark, folder)
    width = np.dtype(kind).itemsize
    block_bytes -= block_bytes % width
    sizes = _sizes(spark, folder, names)
    blocks = sizes.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("bytes") - 1) / block_bytes).cast("long"))).alias("block"))
    blocks = written(blocks.repartition("file", "block"), "blocks")

    def ends(file: str, size: int, block: int) -> tuple[np.ndarray, int]:
        """Places of the separators of a block, and its number of ids."""
        if size % width:
            raise ValueError(f"{file} has {size} bytes, which is no multiple of {width}")
        system, path = files.opened(folder)
        with system.open_input_file(f"{path}/{file}") as stream:
            ids = np.frombuffer(stream.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), dtype=kind)
        return np.flatnonzero(ids == end), len(ids)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, size, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at, n = ends(file, size, block)
                rows.append({"file": file, "bytes": size, "block": block, "n_ends": len(at), "tail": n - int(at[-1]) - 1 if len(at) else n})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("block", pa.int64()), ("n_ends", pa.int64()), ("tail", pa.int64())]))

    # the prefix scan: documents before a block; tokens since the last separator before it
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    summaries = written(blocks.mapInArrow(summarise, "file string, bytes long, block long, n_ends long, tail long"), "summaries")
    scan = summaries.withColumns({"ordinal": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "run": F.sum((F.col("n_ends") > 0).cast("long")).over(in_order)})
    since = Window.partitionBy("file", "run").orderBy("block")
    scan = scan.withColumn("open", F.sum("tail").over(since))
    scan = scan.withColumns({"carried": F.coalesce(F.lag("open").over(in_order), F.lit(0)), "is_last": F.lead("block").over(in_order).isNull()})
    scan = scan.select("file", "bytes", "block", "ordinal", "carried", "is_last").repartition("file", "block")
    out = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("n_tokens", pa.int64()), ("ended", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block, ordinal, carried, is_last in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                at, n = ends(file, size, block)
                counts = np.diff(np.concatenate(([-1], at))) - 1
                if len(counts):
                    counts[0] += carried
                open_ = n - int(at[-1]) - 1 if len(at) else carried + n
                more = [open_] if is_last and open_ else []
                counts = np.concatenate([counts, np.array(more, dtype=np.int64)]).astype(np.int64)
                ended = np.ones(len(counts), dtype=bool)
                if more:
                    ended[-1] = False
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(counts), type=pa.string()), pa.array(np.arange(len(counts)) + ordinal, type=pa.int64()), pa.array(counts), pa.array(ended)], schema=out)

    return scan.mapInArrow(count, "file string, ordinal long, n_tokens long, ended boolean")


def counted(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(key, n_tokens) of each document, by way of flat token files in the shared folder."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    order = write_tokens(docs, folder, rank_file, pattern, key, text)
    counts = count_tokens(spark, folder, order.select("file").distinct(), **kw)
    # both sides grow with the documents, and Parquet's sizes say little of them: never broadcast one
    return order.hint("merge").join(counts.hint("merge"), ["file", "ordinal"]).select(key, "n_tokens")
