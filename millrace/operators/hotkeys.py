"""Per-key results when a few keys own most rows: eager aggregation through a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_state(df: DataFrame, key: str, group: str | None, value: str, default: float | None = None) -> DataFrame:
    """One compact row per key, null too: key_null, key, rows, groups (distinct, null is none; 0 without a group, which saves a step), total.

    Rows count as they stand, duplicates too. A null value counts as default, or is left out of the total where default is
    None; the total of a key with nothing to add is 0. Both steps combine on the map side: a task sends at most one row per key and group it
    holds, and then one per key, so a key with any share of the rows gives no task more than others. An empty table gives no row.
    Columns other than the three are dropped before anything moves.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).isNull().alias("key_null"), F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint")).alias("key"), (F.col(group) if group else F.lit(None).cast("int")).alias("part"), (v if default is None else F.coalesce(v, F.lit(default))).alias("v"))
    if not group:
        return rows.groupBy("key_null", "key").agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("bigint").alias("groups"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
    per_group = rows.groupBy("key_null", "key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    return per_group.groupBy("key_null", "key").agg(F.sum("n").alias("rows"), F.count("part").alias("groups"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("total"))


def eager_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both states of every key of either side, and what the join of the tables themselves would give, without making it.

    pairs is the number of joined rows (the product of the counts), left_pair_total and right_pair_total are the sums of either value over them.
    A null key meets a null key. Counts of an absent side are 0. pairs is a decimal(38,0): products of large counts need it.
    The states are already partitioned by key, so the join moves nothing.
    """
    name = lambda df, p: df.select("key_null", "key", *(F.col(c).alias(f"{p}_{c}") for c in ("rows", "groups", "total")))
    both = name(left, "left").join(name(right, "right"), ["key_null", "key"], "full")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    big = lambda c: of(c).cast("decimal(19,0)")
    return both.select(
        F.when(~F.col("key_null"), F.col("key")).alias("key"),
        *(of(f"{p}_{c}").alias(f"{p}_{c}") for p in ("left", "right") for c in ("rows", "groups", "total")),
        (big("left_rows") * big("right_rows")).cast("decimal(38,0)").alias("pairs"),
        (of("left_total") * of("right_rows")).alias("left_pair_total"),
        (of("right_total") * of("left_rows")).alias("right_pair_total"),
    )


def rolled_up(joined: DataFrame, part: Column) -> DataFrame:
    """What a join of the tables would give per part of the keys (a null key's part is null), from the joined states alone: part, keys on both sides, pairs, left_pair_total, right_pair_total."""
    both = joined.filter((F.col("left_rows") > 0) & (F.col("right_rows") > 0))
    return both.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("keys"), *(F.sum(c).alias(c) for c in ("pairs", "left_pair_total", "right_pair_total")))


def overloaded(joined: DataFrame, sides: dict[str, tuple[str, Column]], share: float) -> DataFrame:
    """(field, key) of each non-null key with at least the share of a side's rows. sides: the field's name to ("left" or "right", the side's row count)."""
    found = F.explode(F.array(*(F.struct(F.lit(field).alias("field"), F.col("key").alias("key"), F.col(f"{side}_rows").alias("n"), total.cast("bigint").alias("of")) for field, (side, total) in sides.items()))).alias("x")
    return joined.filter(F.col("key").isNotNull()).select(found).select("x.*").filter((F.col("n") > 0) & (F.col("n") >= F.col("of") * F.lit(share))).select("field", "key")
