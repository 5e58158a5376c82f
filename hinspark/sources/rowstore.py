"""Features of many metapaths laid out by row, so that a batch of nodes is one contiguous read.

Propagation yields a table for each metapath; a batch needs the same rows of all of
them.  The store turns that round: one row for each node, a map from the metapath to
its sparse vector, rows sorted by node in ranges.  A range of nodes is then a few
files, chosen by a small index, and in them a few row groups, chosen by Spark from
their statistics; a metapath is a key of the map.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import folders

#: Bytes of a row group, and rows of a file, at most: what a small range costs to read.
GROUP_BYTES = 8 << 20
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class RowStore:
    """A written store; reading is lazy but for the index of files."""

    spark: SparkSession
    path: str

    @staticmethod
    def write(cells: DataFrame, path: str, file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES) -> RowStore:
        """Store of (mp, nid, slot, col, val), in a folder that must not exist.

        One shuffle: by ranges of nodes, which both groupings below and the sort
        within files then rest on.  The index is written last; without it a folder is
        no store.
        """
        spark = cells.sparkSession
        if folders.exists(spark, path):
            raise FileExistsError(path)
        ranges = cells.where("nid is not null").select("mp", "nid", F.struct("slot", "col", "val").alias("cell")).repartitionByRange("nid")
        vectors = ranges.groupBy("nid", "mp").agg(F.array_sort(F.collect_list("cell")).alias("vector"))
        rows = vectors.groupBy("nid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mp", "vector")))).alias("features"))
        writer = rows.sortWithinPartitions("nid").write.option("maxRecordsPerFile", file_rows).option("parquet.block.size", group_bytes)
        writer.parquet(f"{path}/rows")
        files = spark.read.parquet(f"{path}/rows").groupBy(F.substring_index("_metadata.file_path", "/", -1).alias("file"))
        files.agg(F.min("nid").alias("low"), F.max("nid").alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/index")  # a row for each file
        return RowStore(spark, path)

    @property
    def index(self) -> DataFrame:
        """(file, low, high, n): the nodes of each file."""
        return self.spark.read.parquet(f"{self.path}/index")

    def between(self, low: int, high: int, paths: list[str] | None = None) -> DataFrame:
        """(nid, features) of the nodes low to high, both included, with the asked metapaths only.

        Only the names of files that overlap the range reach the driver.  A node that
        isn't stored has no row.
        """
        near = self.index.where((F.col("high") >= low) & (F.col("low") <= high)).select("file").collect()
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        names = [f"{self.path}/rows/{r.file}" for r in near]
        rows = self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        return self._of_paths(rows.where(F.col("nid").between(low, high)), paths)

    def batch(self, number: int, size: int, paths: list[str] | None = None) -> DataFrame:
        """The batch's nodes: size consecutive ids."""
        return self.between(number * size, (number + 1) * size - 1, paths)

    def rows(self, wanted: DataFrame, paths: list[str] | None = None) -> DataFrame:
        """(nid, features) of the wanted nodes (nid); files outside their bounds aren't read."""
        low, high = wanted.agg(F.min("nid"), F.max("nid")).first()
        near = self.between(low, high, paths) if low is not None else self.between(0, -1, paths)
        return near.join(wanted.select("nid").distinct(), "nid", "left_semi")

    def all(self, paths: list[str] | None = None) -> DataFrame:
        return self._of_paths(self.spark.read.parquet(f"{self.path}/rows"), paths)

    @staticmethod
    def _of_paths(rows: DataFrame, paths: list[str] | None) -> DataFrame:
        if paths is None:
            return rows
        return rows.withColumn("features", F.map_filter("features", lambda k, _: k.isin(*paths)))


def cells_of(rows: DataFrame) -> DataFrame:
    """(mp, nid, slot, col, val) of stored rows: the way back."""
    vectors = rows.select("nid", F.explode("features").alias("mp", "vector"))
    return vectors.select("mp", "nid", F.explode("vector").alias("cell")).select("mp", "nid", "cell.slot", "cell.col", "cell.val")
