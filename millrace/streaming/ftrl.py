"""Training and counting on streams of rows (row_id, label, features)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.ids import decode_group
from millrace.operators.features import feature_counts, triples
from millrace.operators.losses import gradient, margins
from millrace.operators.metrics import objective
from millrace.operators.updates import Initializer, add_counts, apply_gradient, new_model, random_vector
from millrace.params import SGDUpdate


class StreamTrainer:
    """A model that takes one step for each micro-batch. Each step's model is a folder of its own in a shared place, so a batch that is run again after a failure replaces its step."""

    def __init__(self, spark: SparkSession, folder: str, update: SGDUpdate = SGDUpdate(), init: Initializer | None = None):
        self.spark, self.folder, self.update, self.init = spark, folder, update, init or random_vector(update.seed)

    def _path(self, batch: int) -> str:
        return f"{self.folder}/step={batch:012d}"

    def model(self, batch: int) -> DataFrame:
        """The model after a micro-batch; an empty one before the first."""
        if batch < 0:
            return new_model(self.spark.createDataFrame([], "fid bigint, cnt bigint"), self.update.V_dim)
        return self.spark.read.parquet(self._path(batch))

    def step(self, rows: DataFrame, batch: int) -> None:
        entries = triples(rows)
        model = add_counts(self.model(batch - 1), feature_counts(entries), self.update, self.init)
        scored = margins(entries, rows, model, self.update.V_dim)
        apply_gradient(model, gradient(entries, scored, model, self.update.V_dim), self.update, self.init).write.mode("overwrite").parquet(self._path(batch))
        scored.agg(F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("rows"), objective().alias("loss")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/progress/step={batch:012d}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes", bits: int = 12) -> DataFrame:
    """Entries per feature group and window of event time; rows later than late are left out. For streams and tables alike."""
    entries = stream.withWatermark(time, late).select(time, F.explode("features").alias("x")).filter(F.col("x.idx").isNotNull())
    return entries.groupBy(F.window(time, window).alias("w"), decode_group("x.idx", bits).alias("grp")).agg(F.count(F.lit(1)).alias("nnz")).select(F.col("w.start").alias("begins"), "grp", "nnz")
