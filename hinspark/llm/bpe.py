"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding where a match of the split pattern always
ends: after a character that is no white space, before a space or line feed.
Every alternative of the pattern that takes the former stops before the latter,
and none looks back, so the pieces' ids joined are the whole text's ids.  That holds
for one pattern, which is known here; under another one a text is encoded whole.

Defined results: null text encodes as empty text: no ids; special tokens'
strings are ordinary text; repeated rows are encoded one by one; texts of any length are
encoded whole; an empty table gives an empty one; other columns are carried through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import arrays

#: Characters that are encoded at once; a longer text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)[ \n]")

#: Fixed value: the split pattern of which that holds; under any other one a text is encoded whole.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file that every executor has at this path."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in order, in pieces of about ``size`` characters that are cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_pieces(text: str | None, rank_file: str, pattern: str) -> Iterator[np.ndarray]:
    """The text's ids, piece by piece, as little-endian unsigned 32-bit integers."""
    coder = encoding(rank_file, pattern)
    for piece in safe_pieces(text or "") if pattern == CUTTABLE else (text or "",):
        if piece:
            yield np.array(coder.encode_ordinary(piece), dtype="<u4")


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text in an array column."""
    keep = [c for c in docs.columns if c != to]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                ids = [np.concatenate([np.zeros(0, "<u4"), *encode_pieces(t.as_py(), rank_file, pattern)]).astype(np.int32) for t in part.column(keep.index(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*keep, to])

    return arrays.batched(docs.select(*keep)).mapInArrow(run, schema)


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the raw bytes that the ids stand for, in a binary column; null ids give null."""
    keep = [c for c in docs.columns if c != to]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                said = [None if x.as_py() is None else coder.decode_bytes(x.as_py()) for x in part.column(keep.index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, type=pa.binary())], names=[*keep, to])

    return arrays.batched(docs.select(*keep)).mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", to: str = "ids", check: str = "decodes") -> DataFrame:
    """``docs`` with the ids of each text, and whether they decode to its bytes; one pass, so a task has one Python worker."""
    keep = [c for c in docs.columns if c not in (to, check)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(to, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())])

    def one(value: str | None) -> tuple[np.ndarray, bool]:
        coder = encoding(rank_file, pattern)
        ids, same = [np.zeros(0, "<u4")], True
        for piece in safe_pieces(value or ""):
            found = coder.encode_ordinary(piece) if piece else []
            ids.append(np.array(found, dtype="<u4"))
            same = same and coder.decode_bytes(found) == piece.encode()
        return np.concatenate(ids).astype(np.int32), same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                out = [one(t.as_py()) for t in part.column(keep.index(text))]
                ends = np.concatenate(([0], np.cumsum([len(ids) for ids, _ in out])))
                ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate([ids for ids, _ in out])))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([same for _, same in out], type=pa.bool_())], names=[*keep, to, check])

    return arrays.batched(docs.select(*keep)).mapInArrow(run, schema)


def digest(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256 of the text encoded and decoded again.

    Works a piece at a time, so a very long text never has all its ids in memory.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def one(value: str | None) -> tuple[int, str, str]:
        coder = encoding(rank_file, pattern)
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for piece in encode_pieces(value, rank_file, pattern):
            n += len(piece)
            ids.update(piece.tobytes())
            back.update(coder.decode_bytes(piece.tolist()))
        return n, ids.hexdigest(), back.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(t.as_py()) for t in batch.column(1)]
            n, ids, back = ([x[i] for x in out] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(back, type=pa.string())], names=schema.names)

    return arrays.batched(docs.select(F.col(key), F.col(text))).mapInArrow(run, schema)
