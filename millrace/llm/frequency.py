"""Occurrences of every term and the records that hold it, by an external sort and a scan for runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(df: DataFrame, term: str, record: str, unit: list[str] | None = None, weight: Column | None = None, partitions: int | None = None) -> DataFrame:
    """One row per term: term, total (occurrences), records (distinct records that hold it).

    unit: columns that, within a term and record, make an occurrence; one delivered again counts once. Without unit every row counts.
    weight: what an occurrence adds to total (1 if none; its first value in the sort order if delivered again). Rows with a null
    term or record are left out, so an empty table gives no row; a null in unit is a value like others.

    The rows are range-partitioned by term and record and sorted, which spills to disk. A term that fills many ranges is shared out, as its records part it,
    and each range is scanned for runs where it lies: a first row of a run is a new occurrence, or a new record. Ranges send one row per term to be added up,
    and a record lies in one range, so records add up exactly.
    """
    units = [f"unit{i}" for i in range(len(unit or []))]
    weights = [] if weight is None else [weight.alias("weight")]
    rows = df.filter(F.col(term).isNotNull() & F.col(record).isNotNull()).select(F.col(term).alias("term"), F.col(record).alias("record"), *(F.col(c).alias(u) for c, u in zip(unit or [], units, strict=True)), *weights)
    keys = ["term", "record"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    # The ranges keep a term and record together, so the window adds the sort within them, and no exchange.
    within = F.struct(*(units or ["term"]))
    scanned = ranged.withColumn("before", F.lag(within).over(Window.partitionBy(*keys).orderBy(*(units or ["term"]), *(["weight"] if weights else []))))
    new_record = F.col("before").isNull()
    new_unit = (new_record | ~F.col("before").eqNullSafe(within)) if units else F.lit(True)
    adds = F.col("weight") if weights else F.lit(1)
    return scanned.groupBy("term").agg(F.sum(F.when(new_unit, adds).otherwise(0)).alias("total"), F.sum(new_record.cast("bigint")).alias("records"))


def marked(counts: DataFrame, rare: float, common: float, of: Column) -> DataFrame:
    """The counts with mark: rare (total of at most rare), else common (records above the share common of all of), else null."""
    return counts.withColumn("mark", F.when(F.col("total") <= rare, "rare").when(F.col("records") > of * F.lit(common), "common"))


def distinct_count(df: DataFrame, column: str) -> Column:
    """A scalar: distinct non-null values; each task sends a value once."""
    return df.select(F.col(column).alias("of")).filter(F.col("of").isNotNull()).groupBy("of").agg(F.lit(1).alias("one")).agg(F.count("one").alias("of")).scalar()
