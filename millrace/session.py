"""Sessions, tables and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", name: str = "millrace", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        # Checkpoints go with the tables that were made from them; clusters set this themselves.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "millrace-warehouse"),
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster's spark.checkpoint.dir as it stands; a folder of our own only where none is set and the session is local."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder, which a cluster needs")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, from files that outlive executors."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written beside the checkpoints, for data that a loop reads again and again. Used as a context, it deletes them at its end, also after a failure."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def put(self, name: str, df: DataFrame, by: str | None = None, only: list[str] | None = None, **sums: Column) -> DataFrame:
        """The same rows, read from files; a table of that name is deleted once they are written. by: a column in whose order they lie, so that reading one value of it
        skips the others' row groups; a value with many rows may span files. sums: aggregates of the rows, which the write takes on its way; found in measured.
        only: the columns that are written."""
        old = self.paths.get(name)
        path = self.folder(name)
        seen = Observation() if sums else None
        watched = df.observe(seen, *(c.alias(n) for n, c in sums.items())) if sums else df
        watched = watched.select(*only) if only else watched
        laid = watched.repartitionByRange(by, "row_id").sortWithinPartitions(by) if by else watched
        laid.write.parquet(path)
        self.measured = dict.fromkeys(sums) | (seen.get if sums else {})
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(watched.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A new path for a table of that name."""
        shared_checkpoints(self.spark)
        self.paths[name] = f"{self.spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        return self.paths[name]

    def keep(self, name: str) -> str:
        """The path of the table, which is then no longer this one's to delete."""
        return self.paths.pop(name)

    def drop(self) -> None:
        for p in self.paths.values():
            remove(self.spark, p)
        self.paths = {}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
