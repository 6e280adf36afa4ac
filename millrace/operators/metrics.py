"""Measures of scored rows (label, margin) and of models, as tables of one row.

Rows without a label or a margin count nowhere. Repeated rows count as often as they stand. No rows at all give sums of 0 and null shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.common import col
from millrace.functions.scalars import chance, logistic_loss, squared_norm


def objective() -> Column:
    """Sum of the logistic loss; 0 for no rows."""
    return F.coalesce(F.sum(logistic_loss("label", "margin")), F.lit(0.0))


def log_loss() -> Column:
    """With chances clipped from below only: a chance of 1 for a negative row gives infinity."""
    p = chance("margin")
    one = F.when(F.col("label") > 0, -F.log(p)).otherwise(F.when(p >= 1, F.lit(float("inf"))).otherwise(-F.log(F.greatest(1 - p, F.lit(1e-300)))))
    return F.coalesce(F.sum(one), F.lit(0.0))


def correct(threshold: float = 0.0) -> Column:
    """Rows on the right side of a threshold for the margin."""
    return F.coalesce(F.sum(((F.col("label") > 0) == (F.col("margin") > threshold)).cast("bigint")), F.lit(0))


def _known(scored: DataFrame, margin: str | Column = "margin") -> DataFrame:
    return scored.filter(F.col("label").isNotNull() & col(margin).isNotNull())


def accuracy(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """rows, correct, accuracy, and acc_sum, the larger of correct and wrong rows."""
    n = _known(scored).agg(F.count(F.lit(1)).alias("rows"), correct(threshold).alias("correct"))
    return n.select("rows", "correct", F.try_divide(F.col("correct").cast("double"), F.col("rows")).alias("accuracy"), F.greatest("correct", F.col("rows") - F.col("correct")).alias("acc_sum"))


def auc(scored: DataFrame, by: list[str] | None = None, margin: str | Column = "margin") -> DataFrame:
    """rows, auc, auc_sum, loss, correct, per group of by if given: auc is the share of pairs of a positive and a negative row that the margin orders rightly; equal margins count half.

    auc_sum is rows times the larger of auc and 1 - auc; 1 if a group has rows of one class only, whose auc is null. loss is the sum of the logistic loss,
    correct the number of rows on the right side of 0.
    Rows are first counted per margin, which combines before anything moves. Running counts are made within ranges of margins; a range then is three
    numbers, to which what lies below it is added, so no task sees all margins and all is one pass.
    """
    by = by or []
    counts = _known(scored, margin).select(*by, col(margin).alias("_m"), (F.col("label") > 0).cast("bigint").alias("_y")).groupBy(*by, "_m").agg(F.sum("_y").alias("pos"), (F.count(F.lit(1)) - F.sum("_y")).alias("neg"))
    ranged = counts.repartitionByRange(*by, "_m").withColumn("_part", F.spark_partition_id())
    before = F.sum("pos").over(Window.partitionBy(*by, "_part").orderBy("_m")) - F.col("pos")
    one = lambda sign: logistic_loss(F.lit(sign), "_m")
    parts = ranged.withColumn("_in", before).groupBy(*by, "_part").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(F.col("neg") * (F.col("_in") + F.col("pos") / 2)).alias("_a"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * one(1.0)).otherwise(0.0) + F.when(F.col("neg") > 0, F.col("neg") * one(0.0)).otherwise(0.0)).alias("_l"), F.sum(F.when(F.col("_m") > 0, F.col("pos")).otherwise(F.col("neg"))).alias("_c")
    )
    below = F.sum("_p").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_p")  # a row a range
    area = parts.withColumn("_below", below).groupBy(*by).agg(F.sum(F.col("_a") + F.col("_below") * F.col("_n")).alias("_wrong"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_l").alias("_l"), F.sum("_c").alias("_c"))
    wrong = F.try_divide(F.col("_wrong"), F.col("_p").cast("double") * F.col("_n"))
    rows = F.coalesce(F.col("_p") + F.col("_n"), F.lit(0))
    return area.select(*by, rows.alias("rows"), (1 - wrong).alias("auc"), F.coalesce(rows * F.greatest(wrong, 1 - wrong), F.lit(1.0)).alias("auc_sum"), F.coalesce("_l", F.lit(0.0)).alias("loss"), F.coalesce("_c", F.lit(0)).alias("correct"))


def penalty(l1: float = 0.0, l2: float = 0.0, v_l2: float = 0.0, dim: int = 0) -> Column:
    """Of a model's rows: l1 |w| + l2 w^2 / 2, and v_l2 v^2 / 2 for each number of v."""
    one = l1 * F.abs("w") + 0.5 * l2 * F.col("w") * F.col("w")
    if dim:
        one = one + F.coalesce(0.5 * v_l2 * squared_norm("v"), F.lit(0.0))
    return F.coalesce(F.sum(one), F.lit(0.0))


def nonzero(dim: int = 0) -> Column:
    """Numbers of the model that aren't 0."""
    one = (F.col("w") != 0).cast("bigint")
    if dim:
        one = one + F.coalesce(F.size(F.filter("v", lambda x: x != 0)), F.lit(0))
    return F.coalesce(F.sum(one), F.lit(0))


def progress(scored: DataFrame, by: list[str], margin: str | Column = "margin") -> DataFrame:
    """Per batch: rows, loss, auc_sum. Batches are merged by adding; the AUC shown is the sum of auc_sum over that of rows."""
    return auc(scored, by, margin).select(*by, "rows", "auc_sum", "loss")


def merged(parts: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    return parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), s("loss"), s("auc_sum")).withColumn("auc", F.try_divide("auc_sum", F.col("rows").cast("double")))
