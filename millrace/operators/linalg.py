"""Sparse products over triples (row_id, fid, val).

Entries with a null row_id, fid or val add nothing; entries of a row and feature that stand twice add twice; no entries give no rows. Other columns are ignored.
Hot rows and features cost no task more than others: sums combine before they move. Joins are on the feature or the row; Spark broadcasts a
model that it knows to be small, and splits skewed partitions of a larger one's join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import inner


def times(entries: DataFrame, x: DataFrame, by: str = "fid", to: str = "row_id", value: str = "x", add: DataFrame | None = None) -> DataFrame:
    """Per to the sum of val times the other side's value: the product of the matrix (by fid, to row_id) or its transpose (by row_id, to fid) with x.

    x: by, value. Missing and zero values of x add nothing, and are dropped before the join. add: to, y; the product is added to it and its rows all come out.
    """
    live = x.filter(F.col(value) != 0).select(by, F.col(value).alias("_x"))
    product = entries.select(by, to, "val").join(live, by).groupBy(to).agg(F.sum(F.col("val") * F.col("_x")).alias("y"))
    if add is None:
        return product
    return product.union(add.select(to, "y")).groupBy(to).agg(F.sum("y").alias("y"))


def times_columns(entries: DataFrame, x: DataFrame, k: int, by: str = "fid", to: str = "row_id", value: str = "x", square: bool = False) -> DataFrame:
    """As times, for arrays of k numbers: to, y (an array). One sum per place, so there is one shuffle and no row for each place. square: squares of the matrix and of x."""
    if k < 1:
        raise ValueError("k must be positive")
    power = (lambda c: c * c) if square else (lambda c: c)
    live = x.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("_x"))
    sums = [F.sum(power(F.col("val")) * power(F.get("_x", F.lit(j)))).alias(f"_{j}") for j in range(k)]
    return entries.select(by, to, "val").join(live, by).groupBy(to).agg(*sums).select(to, F.array(*(F.coalesce(f"_{j}", F.lit(0.0)) for j in range(k))).alias("y"))


def transpose(entries: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Columns in pieces: fid, chunk, items (row_id, val, in row order). A piece holds a feature's entries in span consecutive row_ids, so no feature, however hot, is one row; pieces in order are the column."""
    return entries.groupBy("fid", F.floor(F.col("row_id") / span).cast("bigint").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("row_id", "val"))).alias("items"))


def untranspose(columns: DataFrame) -> DataFrame:
    return columns.select("fid", F.explode("items").alias("x")).select(F.col("x.row_id").alias("row_id"), "fid", F.col("x.val").alias("val"))


def squared(entries: DataFrame) -> DataFrame:
    return entries.withColumn("val", F.col("val") * F.col("val"))


def dots(table: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row with all inner products over the table's rows, in one pass; columns are numbers or arrays."""

    def one(a: Column, b: Column) -> Column:
        kind = dict(table.select(a.alias("a")).dtypes)["a"]
        return F.coalesce(F.sum(inner(a, b) if kind.startswith("array") else a * b), F.lit(0.0))

    return table.agg(*(one(a, b).alias(n) for n, (a, b) in pairs.items()))
