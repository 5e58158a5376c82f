"""Files of their own format in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: Hadoop's scheme names, and those of the libraries that tasks use for them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as Spark itself resolves it, so one without a scheme lies in the default file system and not on each machine's disk.

    A scheme that tasks can't open is an error, on the driver and before anything is written.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    scheme = path.toUri().getScheme()
    if scheme is None:
        path = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path)
        scheme = path.toUri().getScheme()
    if scheme not in SCHEMES:
        raise ValueError(f"files of their own format can't be written to {scheme}: (one of {', '.join(SCHEMES)})")
    return path.toString()


def opened(uri: str):
    """(file system, path) of a qualified URI."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


@contextmanager
def committed(folder: str, name: str):
    """A writable stream that gets its name only when all is written.

    A task that runs twice, or again after an executor is lost, writes a
    temporary file of its own.  Its bytes are those that have the name already, as
    far as any do: a file system that moves onto a name replaces them, and where one
    refuses to, as hdfs: does, the temporary file goes.
    """
    from pyarrow import fs

    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/_temporary-{uuid.uuid4().hex}"
    stream = system.open_output_stream(temporary)
    try:
        yield stream
        stream.close()
        try:
            system.move(temporary, f"{path}/{name}")
        except OSError:
            if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                raise
            system.delete_file(temporary)
    except BaseException:
        stream.close()
        system.delete_file(temporary)
        raise
