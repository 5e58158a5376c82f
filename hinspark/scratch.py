"""Tables written between the phases of an operator, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may run without that setting; it then gets a
    temporary folder of its own.  On a cluster a missing setting is an error,
    as no machine-local folder would do.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="hinspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in this application's own folder; the folder goes when the application ends."""
    sc = spark.sparkContext
    folder = f"{scratch_dir(spark)}/hinspark-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if system.mkdirs(path):
        system.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
