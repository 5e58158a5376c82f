"""Small files and whole folders on any file system Spark reads, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    system, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    system, where = _at(spark, path)
    return system.getContentSummary(where).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, where = _at(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def removed(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def committed(spark: SparkSession, temporary: str, path: str) -> bool:
    """A finished folder gets its name, if nobody was first; else it goes.

    A rename, which is one step on local and distributed file systems; an object
    store copies, so there two writers of one name must not run at once.
    """
    system, source = _at(spark, temporary)
    _, target = _at(spark, path)
    if not system.exists(target) and system.rename(source, target):
        if not system.exists(target.suffix(f"/{source.getName()}")):  # renamed into a folder that came in between
            return True
        system.delete(target.suffix(f"/{source.getName()}"), True)
        return False
    system.delete(source, True)
    return False
