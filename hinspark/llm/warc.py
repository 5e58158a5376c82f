"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page_id, then by payload digest: a running sum of
payload bytes in that order, made on digests and sizes alone, cuts them into shards of
about equal size, the same ones on every run.  Clustered ids, extreme ids, null ids
and ids with many payloads are cut like any others; only equal payloads of one id stay
together.  One task writes a shard, record by record in order, each compressed on its
own, and starts another file when the compressed size passes ``roll_bytes``.
Headers, digests and record ids are made from the data alone, so a shard that is
written again has the same bytes.  Files get their names when they are complete;
the manifest table, committed last, lists them with their sizes and digests, and
readers read what the manifest lists.

Of pages with equal payloads of at least ``min_revisit_bytes``, the one with the
smallest page_id is a response, the others revisit it.  Which page a revisit
refers to is found on digests alone and meets the page in the sorted stream, so
payloads are shuffled once.  Shards are routed to partitions of their own.

Defined results: null html is an empty payload; repeated rows are records of their own;
payloads of any length are written whole; other columns are not used; a null page_id is written last, is
always a response, and is read back as null; rows that share the smallest page_id of
a payload are all responses; a null url gets the target ``urn:page:<id>``; an
empty table gives no files and an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import arrays, files
from ..operators.evaluate import with_running_sum
from ..scratch import new_path, written

#: Shards at most; beyond, they grow with the input.  Their bounds (1 MB) are literals of the plan.
MAX_SHARDS = 1 << 14
#: Bytes that a record counts besides its payload.
RECORD_BYTES = 500

MANIFEST = "file string, shard long, part long, records long, bytes long, sha256 string"

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_holds boolean"

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public URL namespace of UUIDs


def _record(kind: str, page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record, uncompressed; a revisit has the page's HTTP headers and no payload."""
    target = url if url else f"urn:page:{page_id}"
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in target)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    of = lambda n: uuid.uuid5(_NAMESPACE, f"page:{n}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{of(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{of(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _compressed(data: bytes, level: int) -> bytes:
    """One gzip member, with no time in its header."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """Writes the records of one shard to files that roll by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int, date: str):
        self.folder, self.shard, self.roll, self.level, self.date = folder, shard, roll_bytes, level, date
        self.part, self.file, self.done = 0, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:08d}-{self.part:05d}.warc.gz"
        self.context = files.committed(self.folder, self.name)
        self.file, self.size, self.records, self.sum = self.context.__enter__(), 0, 0, hashlib.sha256()
        info = f"software: hinspark\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, self.name)}>\r\nWARC-Date: {self.date}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
        self._put(_compressed(head + info + b"\r\n\r\n", self.level))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sum.update(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        data = _compressed(record, self.level)
        if self.file is not None and self.records and self.size + len(data) > self.roll:
            self.close()
        if self.file is None:
            self._open()
        self._put(data)
        self.records += 1

    def close(self) -> None:
        if self.file is not None:
            self.context.__exit__(None, None, None)
            self.done.append((self.name, self.shard, self.part, self.records, self.size, self.sum.hexdigest()))
            self.file, self.part = None, self.part + 1

    def abort(self, error: BaseException) -> None:
        if self.file is not None:
            self.context.__exit__(type(error), error, error.__traceback__)


def _key(page_id: Column, sha1: Column) -> Column:
    """A string in the order of the records: by page_id, nulls last, then by digest."""
    place = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(place, F.lit("null")), F.hex(sha1))


def _bounds(narrow: DataFrame, shard_bytes: int) -> list[str]:
    """The least key of each shard but the first; shards have about shard_bytes, and there are at most MAX_SHARDS."""
    sizes = narrow.groupBy(_key(F.col("page_id"), F.col("sha1")).alias("key")).agg(F.sum(F.col("size") + RECORD_BYTES).alias("size"))
    summed = with_running_sum(sizes, "key", "size", "before")
    total = summed.agg(F.sum("size")).first()[0] or 0
    each = max(shard_bytes, -(-total // MAX_SHARDS))
    starts = summed.groupBy(F.floor(F.col("before") / each).alias("shard")).agg(F.min("key").alias("key"))
    return sorted(r.key for r in starts.select("key").collect())[1:]  # MAX_SHARDS at most


def _shard(key: Column, bounds: list[str]) -> Column:
    """How many bounds there are up to the key, by binary search."""
    if not bounds:
        return F.lit(0)
    middle = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
    begun = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def search(listed: Column, key: Column) -> Column:
        below = lambda s: F.get(listed, middle(s)) <= key
        step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below(s), middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(below(s), s["hi"]).otherwise(middle(s)).alias("hi")))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), begun, step, lambda s: s["lo"])

    # bound as lambdas' arguments: the list is folded to one literal, the key is made once for a row
    listed = F.array(F.split(F.lit(",".join(bounds)), ","))
    return F.get(F.transform(F.array(key), lambda k: F.get(F.transform(listed, lambda b: search(b, k)), F.lit(0))), F.lit(0))


def _routes(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there."""
    found = {r.p: r.i for r in spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("i")).collect()}  # n rows
    return [found.get(p, p) for p in range(n)]


def write(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, roll_bytes: int = 32 << 20, min_revisit_bytes: int = 0, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) as archives under ``folder``; returns the committed manifest."""
    spark = pages.sparkSession
    folder = files.qualified(spark, folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    narrow = written(rows.select("page_id", "sha1", F.octet_length("payload").cast("long").alias("size")), "digests")
    known = narrow.where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes))
    first = known.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("sha1", "first")
    revisits = known.join(first, "sha1").where("page_id <> first").select("page_id", "first", "sha1").distinct()
    bounds = _bounds(narrow, shard_bytes)
    # a revisit's row comes just before its page in the sorted stream
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first"), "sha1").unionByName(
        revisits.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first", "sha1")
    )
    n = len(bounds) + 1
    routes = F.split(F.lit(",".join(map(str, _routes(spark, n)))), ",")
    placed = both.withColumn("shard", _shard(_key(F.col("page_id"), F.col("sha1")), bounds).cast("long"))
    placed = placed.repartition(n, F.get(routes, F.col("shard").cast("int")).cast("long"))
    placed = placed.select("shard", "page_id", "kind", "url", "payload", "first", "sha1").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha1", "kind", "url")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, refers = None, [], (None, None)
        try:
            for batch in batches:
                columns = [batch.column(i) for i in range(7)]
                for i in range(batch.num_rows):
                    shard, page_id, kind, url, payload, first, sha1 = (c[i].as_py() for c in columns)
                    if now is None or now.shard != shard:
                        if now is not None:
                            now.close()
                            out += now.done
                        now = _Shard(folder, shard, roll_bytes, level, date)
                    if kind == 0:
                        refers = (page_id, sha1), first
                        continue
                    to = refers[1] if refers[0] == (page_id, sha1) else None
                    digest = base64.b32encode(sha1).decode()
                    now.add(_record("response" if to is None else "revisit", page_id, url, payload, digest, len(payload), to, date))
            if now is not None:
                now.close()
                out += now.done
        except BaseException as error:
            if now is not None:
                now.abort(error)
            raise
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

    names = [c.split()[0] for c in MANIFEST.split(", ")]
    arrow = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in MANIFEST.split(", ")])
    arrays.batched(placed).mapInArrow(put, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(parts)
                data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def _parsed(record: bytes) -> tuple | None:
    """A row of READ, or None of a warcinfo record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        holds = len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    else:
        holds = base64.b32encode(hashlib.sha1(block).digest()).decode() == fields["WARC-Block-Digest"].removeprefix("sha1:")
    to = fields.get("X-Refers-To-Page-ID")
    return int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, size, digest, fields["WARC-Type"], int(to) if to else None, holds


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the files that the manifest lists."""
    folder = files.qualified(spark, folder)
    listed = manifest(spark, folder).select("file")
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in READ.split(", ")])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files.opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        if (row := _parsed(record)) is not None:
                            rows.append(dict(zip(names, row, strict=True)))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = max(1, spark.sparkContext.defaultParallelism)
    return listed.repartition(n).mapInArrow(get, READ)


def write_and_read(pages: DataFrame, **kw) -> DataFrame:
    """The pages written as archives in the shared folder, and read back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write(pages, folder, **kw)
    return read(spark, folder)
