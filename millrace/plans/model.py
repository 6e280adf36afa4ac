"""Models kept as files, and predictions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import chance
from millrace.operators.features import triples
from millrace.operators.losses import loss_settings, margins
from millrace.plans.sgd import Trained


def save_model(model: Trained, path: str, drop_zeros: bool = False) -> None:
    """The model's table and its history. drop_zeros: features whose weight is 0 and that have no embedding change no prediction, and are left out."""
    df = model.model.filter((F.col("w") != 0) | F.col("v").isNotNull()) if drop_zeros else model.model
    df.write.mode("overwrite").parquet(f"{path}/features")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps({"dim": model.dim, "history": model.history}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Trained:
    about = json.loads(spark.read.text(f"{path}/about").first().value)
    return Trained(spark.read.parquet(f"{path}/features"), about["history"], about["dim"])


def predict(rows: DataFrame, model: Trained, loss: str = "fm") -> DataFrame:
    """row_id, label, margin, chance for every row, also those without a known feature (margin 0)."""
    return margins(triples(rows), rows, model.model, **loss_settings(loss, model.dim)).select("row_id", "label", "margin", chance("margin").alias("chance"))
