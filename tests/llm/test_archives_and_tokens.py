"""WARC archives, token counts, byte-level BPE."""

import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinspark.llm import bpe, files, token_counts, warc
from hinspark.llm.queries import tokenizer


@pytest.fixture(scope="module")
def ranks():
    pytest.importorskip("public_tokenizers")
    return tokenizer()


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = None if i is None or len(p) < least or first[p] == i else first[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def some_pages(spark):
    html = ["<p>a</p>", "", None, "é" * 1000, "<p>a</p>", "x" * 300_000]
    rows = [(i * 5, f"http://x.org/{i}" if i % 7 else None, html[i % 6]) for i in range(90)] + [(None, "u", "<p>a</p>"), (5, "bad\r\nurl é", ""), (None, None, None)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")


@pytest.mark.parametrize("least", [0, 2])
def test_archives_round_trip(some_pages, least):
    rows, df = some_pages
    got = warc.write_and_read(df, shard_bytes=500_000, roll_bytes=2_000, min_revisit_bytes=least).collect()
    assert all(r["digest_holds"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected(rows, least), key=key)


def test_archives_are_deterministic(some_pages, tmp_path):
    _, df = some_pages
    made = []
    for name, parts in (("a", 3), ("b", 11)):
        m = warc.write(df.repartition(parts), f"file://{tmp_path}/{name}", shard_bytes=500_000, roll_bytes=2_000)
        made.append(sorted(tuple(r) for r in m.collect()))
        assert not [f for f in os.listdir(tmp_path / name) if "temporary" in f]
    assert made[0] == made[1] and len(made[0]) > 3
    assert all(size <= 2_000 or records == 1 for _, _, _, records, size, _ in made[0])
    for name, _, _, _, size, sha in made[0]:
        data = (tmp_path / "a" / name).read_bytes()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


@pytest.mark.parametrize("ids", [[i for i in range(200)] + [2**62], [-(2**63), 2**63 - 1, *range(5, 100)], [7] * 80, [None] * 80])
def test_shards_follow_the_bytes(spark, tmp_path, ids):
    rows = [(x, None, f"{k}" * 500) for k, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    listed = warc.write(df, f"file://{tmp_path}/w", shard_bytes=10_000).collect()
    assert len({m["shard"] for m in listed}) > 5 and max(m["records"] for m in listed) < 30
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected(rows), key=key)


def test_each_shard_has_a_partition(spark):
    for n in (1, 7, 60):
        routes = spark.createDataFrame([(r,) for r in warc._routes(spark, n)], "r long")
        got = routes.repartition(n, "r").select(F.spark_partition_id().alias("p"), "r").collect()
        assert len({r["p"] for r in got}) == n and [x["r"] for x in sorted(got, key=lambda x: x["p"])] == warc._routes(spark, n)


def test_shard_search(spark):
    bounds = ["b", "d", "dd", "x"]
    got = spark.createDataFrame([(k,) for k in "a b c d dc dd y x".split()], "k string").select("k", warc._shard(F.col("k"), bounds).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: sum(b <= k for b in bounds) for k in "a b c d dc dd y x".split()}
    plan = spark.range(1).select(warc._shard(F.col("id").cast("string"), bounds).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_folders_are_those_of_spark(spark, tmp_path, monkeypatch):
    assert files.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert files.qualified(spark, "s3a://b/x") == "s3a://b/x"
    with pytest.raises(ValueError):
        files.qualified(spark, "ftp://h/x")
    assert files.qualified(spark, f"file://{tmp_path}") == f"file://{tmp_path}" or files.qualified(spark, f"file://{tmp_path}") == f"file:{tmp_path}"
    assert files.opened(f"file:{tmp_path}")[1] == files.opened(f"file://{tmp_path}")[1] == str(tmp_path)
    from pyarrow import fs

    class Asked:
        from_uri = staticmethod(lambda uri: (uri, uri))

    monkeypatch.setattr(fs, "FileSystem", Asked)
    assert [files.opened(f"{x}://b/x/y")[0].split(":")[0] for x in ("s3a", "s3n", "s3", "gs", "abfss", "hdfs")] == ["s3", "s3", "s3", "gs", "abfss", "hdfs"]


def test_ids_that_do_not_fit_are_errors(docs, ranks, tmp_path):
    with pytest.raises(ValueError):
        token_counts.write_tokens(docs, f"{tmp_path}/a", *ranks, end=70_000)
    with pytest.raises(Exception, match="doesn't fit"):
        token_counts.write_tokens(docs, f"{tmp_path}/b", *ranks, kind="u1", end=255)
    assert token_counts.counted(docs.where("false"), *ranks).count() == 0


def test_readers_ignore_what_the_manifest_does_not_list(spark, some_pages, tmp_path):
    rows, df = some_pages
    folder = f"file://{tmp_path}/w"
    warc.write(df, folder)
    (tmp_path / "w" / "shard-00000099-00000.warc.gz").write_bytes(b"broken")
    assert warc.read(spark, folder).count() == len(rows)


def test_empty_archive(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_token_counts_against_encoding(docs, odd, ranks):
    for df in (docs, odd):
        got = token_counts.counted(df, *ranks, block_bytes=1000)
        want = bpe.encode(df.select("doc_id", "text"), *ranks).select("doc_id", F.size("ids").cast("long"))
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separators_across_blocks(spark, tmp_path, block):
    lengths = {"a.bin": [0, 3, 0, 50, 1], "b.bin": [200], "c.bin": [], "d.bin": [0]}
    for name, sizes in lengths.items():
        ids = [x for n in sizes for x in [7] * n + [9]] + ([5, 5] if name == "b.bin" else [])
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    names = spark.createDataFrame([(n,) for n in lengths], "file string")
    got = token_counts.count_tokens(spark, f"file://{tmp_path}", names, end=9, block_bytes=block).collect()
    want = [(f, i, n, True) for f, sizes in lengths.items() for i, n in enumerate(sizes)] + [("b.bin", 1, 2, False)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        token_counts.count_tokens(spark, f"file://{tmp_path}", spark.createDataFrame([("x.bin",)], "file string"), block_bytes=2).collect()


def test_pieces_encode_as_the_whole(ranks):
    coder = bpe.encoding(*ranks)
    texts = ["", "a", "it's  two   spaces \n\n and\ttabs  \u2003x\x1c y", "a" * 5000, " " * 5000, "ab  \n cd " * 400, "漢字かな交じり文 " * 300, "x\u00a0 y " * 300]
    for t in texts:
        for size in (1, 7, 64, 1000):
            assert "".join(bpe.safe_pieces(t, size)) == t
            assert [i for p in bpe.safe_pieces(t, size) for i in coder.encode_ordinary(p)] == coder.encode_ordinary(t)


def test_round_trip(docs, odd, ranks):
    coder = bpe.encoding(*ranks)
    for df in (docs, odd):
        back = bpe.decode(bpe.encode(df, *ranks), *ranks)
        assert back.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0 and back.count() == df.count()
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in bpe.digest(df, *ranks).where("doc_id is not null").collect():
            ids = coder.encode_ordinary(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_special_strings_are_text(ranks):
    assert len(list(bpe.encode_pieces("<|endoftext|>", *ranks))[0]) > 1


class _Refusing:
    """The local file system, which moves onto no name that there is."""

    def __init__(self, fail=False):
        from pyarrow import fs

        self.local, self.fail = fs.LocalFileSystem(), fail

    def __getattr__(self, name):
        return getattr(self.local, name)

    def move(self, a, b):
        if self.fail or os.path.exists(b):
            raise OSError(f"{b} is there")
        self.local.move(a, b)


def test_a_task_that_runs_again_where_names_are_not_replaced(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "opened", lambda uri: (_Refusing(), str(tmp_path / "out")))
    for _ in range(2):
        with files.committed("any", "part") as stream:
            stream.write(b"same")
    assert os.listdir(tmp_path / "out") == ["part"] and (tmp_path / "out/part").read_bytes() == b"same"
    with pytest.raises(RuntimeError), files.committed("any", "other") as stream:
        raise RuntimeError
    monkeypatch.setattr(files, "opened", lambda uri: (_Refusing(fail=True), str(tmp_path / "out")))
    with pytest.raises(OSError), files.committed("any", "new") as stream:
        stream.write(b"x")
    assert os.listdir(tmp_path / "out") == ["part"]


def test_other_patterns_are_not_cut(ranks):
    rank_file, pattern = ranks
    assert pattern == bpe.CUTTABLE
    spaced = r"[^ ]+| +[^ ]* "  # a match may go on over a space
    text = ("word, " * 30_000) + "end"
    whole = bpe.encoding(rank_file, spaced).encode_ordinary(text)
    assert [i for p in bpe.encode_pieces(text, rank_file, spaced) for i in p.tolist()] == whole
    assert len(list(bpe.encode_pieces(text, rank_file, spaced))) == 1 < len(list(bpe.encode_pieces(text, rank_file, pattern)))
