"""Blocks of data by name, and tiles of a matrix by row and column block."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under names in a shared folder. Each is of the schema it was first stored with; its schema and size stay known after its data are removed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.meta: dict[str, tuple[str, int]] = {}

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def store(self, name: str, df: DataFrame, by: str | None = None) -> None:
        """Overwrites what has that name, if it is of the same schema."""
        schema = df.schema.simpleString()
        if name in self.meta and self.meta[name][0] != schema:
            raise TypeError(f"{name} holds {self.meta[name][0]}")
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(self._path(name))
        self.meta[name] = (schema, self.spark.read.parquet(self._path(name)).count())

    def fetch(self, name: str, begin: int | None = None, end: int | None = None, position: str = "pos") -> DataFrame:
        """The table, or its rows from begin to before end; the filter reaches the files."""
        if name not in self.meta:
            raise KeyError(name)
        df = self.spark.read.parquet(self._path(name))
        return df if begin is None else df.filter((F.col(position) >= begin) & (F.col(position) < end))

    def prefetch(self, name: str) -> DataFrame:
        """Marks the table to be kept in memory once read, on disk where it doesn't fit."""
        return self.fetch(name).persist()

    def remove(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def size(self, name: str) -> int:
        if name not in self.meta:
            raise KeyError(name)
        return self.meta[name][1]

    def save_meta(self, name: str = "_meta") -> None:
        rows = [(k, *v) for k, v in self.meta.items()]
        self.spark.createDataFrame(rows, "name string, schema string, rows bigint").coalesce(1).write.mode("overwrite").parquet(self._path(name))

    def load_meta(self, name: str = "_meta") -> None:
        self.meta = {r.name: (r.schema, r.rows) for r in self.spark.read.parquet(self._path(name)).collect()}  # one row a table


class TileStore(Store):
    """Triples with rblk and fblk (row and column block), in a folder per column block."""

    def store_tiles(self, name: str, tiles: DataFrame) -> None:
        self.store(name, tiles, "fblk")

    def tile(self, name: str, row_block: int, column_block: int) -> DataFrame:
        """Reads that column block's files only."""
        return self.fetch(name).filter((F.col("fblk") == column_block) & (F.col("rblk") == row_block))
