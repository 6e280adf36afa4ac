"""The most frequent values of a column, exactly, in bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-null values: value, n, most frequent first; of equally frequent ones the smaller value counts as more frequent.

    The counts are exact. They are combined in each task before they move, in hash maps that turn to sorted files on disk when they are full;
    each partition then keeps its k best, and the last step orders k rows of each. Fewer than k rows come out where there are fewer values.
    """
    if k < 1:
        raise ValueError("k must be positive")
    return df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def at_least(df: DataFrame, column: str, share: float) -> DataFrame:
    """The values with at least the share of the rows that have one: value, n, exactly. No more than 1 / share values can have it, so they are among so many most frequent ones."""
    if not 0 < share <= 1:
        raise ValueError("share must lie above 0 and at most at 1")
    of = df.agg(F.count(column).alias("of")).scalar()
    return top_values(df, column, int(1 / share) + 1).filter(F.col("n") >= of * F.lit(share))
