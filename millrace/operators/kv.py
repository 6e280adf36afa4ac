"""Tables of keys and values: matching, union and positions.

Keys are unique within a table, as a model's are. A null key matches nothing and is kept or dropped as any unmatched key.
Columns other than those named are ignored, so clashing names do no harm. Spark picks the join: sorted merge, or a broadcast of a side it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ids import edges_below, ordered
from millrace.functions.scalars import combine


def _pair(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(value).alias(name), F.lit(True).alias(f"has_{name}"))


def kv_match(dst: DataFrame, src: DataFrame, key: str = "key", value: str = "value", op: str = "assign") -> DataFrame:
    """dst's keys: key, value, matched. Where src has the key, the value is dst's op src's; elsewhere it stays as it is, a missing one being 0."""
    both = _pair(dst, key, value, "a").join(_pair(src, key, value, "b"), "key", "left")
    a, hit = F.coalesce("a", F.lit(0.0)), F.coalesce("has_b", F.lit(False))
    return both.select("key", F.when(hit, combine(op, a, F.coalesce("b", F.lit(0.0)))).otherwise(a).alias("value"), hit.alias("matched"))


def kv_match_vectors(dst: DataFrame, src: DataFrame, key: str = "key", value: str = "value", op: str = "assign") -> DataFrame:
    """As kv_match, for arrays of one length per key; a key that src lacks, or holds a null for, keeps its array."""
    both = _pair(dst, key, value, "a").join(_pair(src, key, value, "b"), "key", "left")
    hit = F.col("b").isNotNull()
    zero = F.transform("b", lambda x: x * 0)
    return both.select("key", F.when(hit, F.zip_with(F.coalesce("a", zero), "b", lambda x, y: combine(op, x, y))).otherwise(F.col("a")).alias("value"), hit.alias("matched"))


def kv_match_ragged(dst: DataFrame, src: DataFrame, key: str = "key", value: str = "value", op: str = "assign") -> DataFrame:
    """dst's keys: key, value, length, for arrays of any length. assign: src's array, or an empty one where src lacks the key, dst's own not being looked at.

    Other operations join dst's array to src's place by place; where lengths differ the places that src lacks stay, and those that dst lacks count as 0. A key that src lacks
    keeps its array, and a null array is an empty one.
    """
    empty = F.array().cast("array<double>")
    right = src.select(F.col(key).alias("key"), F.col(value).cast("array<double>").alias("b"))
    if op == "assign":
        out = dst.select(F.col(key).alias("key")).join(right, "key", "left").select("key", F.coalesce("b", empty).alias("value"))
    else:
        both = dst.select(F.col(key).alias("key"), F.coalesce(F.col(value).cast("array<double>"), empty).alias("a")).join(right, "key", "left").withColumn("n", F.size(F.coalesce("b", empty)))
        places = F.zip_with("a", F.coalesce("b", empty), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        joined = F.transform(places, lambda p, i: F.when(i < F.col("n"), combine(op, F.coalesce(p["x"], F.lit(0.0)), F.coalesce(p["y"], F.lit(0.0)))).otherwise(p["x"]))
        out = both.select("key", joined.alias("value"))
    return out.withColumn("length", F.size("value"))


def kv_union(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value", op: str = "plus") -> DataFrame:
    """The keys of either: key, value. a's value (0 where a lacks the key) op b's, where b has it.

    Sums and differences need no join: the values meet in one aggregation, which combines before it moves anything.
    If either table is empty the rule is the same as for any others.
    """
    if op in ("plus", "minus"):
        sign = 1 if op == "plus" else -1
        rows = a.select(F.col(key).alias("key"), F.col(value).alias("value")).union(b.select(F.col(key).alias("key"), (F.col(value) * sign).alias("value")))
        return rows.groupBy("key").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    both = _pair(a, key, value, "a").join(_pair(b, key, value, "b"), "key", "full")
    left = F.coalesce("a", F.lit(0.0))
    return both.select("key", F.when(F.col("has_b"), combine(op, left, F.coalesce("b", F.lit(0.0)))).otherwise(left).alias("value"))


def find_position(src: DataFrame, dst: DataFrame, key: str = "key", position: str = "pos") -> DataFrame:
    """dst's keys: key, pos, the position that src has for it, or -1. src holds positions already, as dense_index gives them."""
    return dst.select(F.col(key).alias("key")).join(src.select(F.col(key).alias("key"), F.col(position).alias("pos")), "key", "left").select("key", F.coalesce("pos", F.lit(-1).cast("bigint")).alias("pos"))


def find_ranges(ids: DataFrame, ranges: list[tuple[int, int]], order: Column) -> DataFrame:
    """Per half-open range its ids' places in id order: rng (the range's number), first, past; where a range has none both are where they would stand.

    order: the unsigned id that sorts as the ids do, with its bits in a bigint. ranges: a plan's, so few. Each id counts in the piece between edges that holds it; the pieces'
    counts, one number an edge, then give all places. Nothing is joined.
    """
    edges = sorted({e for r in ranges for e in r if e < 1 << 64})
    at = {e: i for i, e in enumerate(edges)}
    counts = ids.select(edges_below(edges, ordered(order)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("piece", "n")).alias("pieces"))
    below = lambda e: F.aggregate(F.filter("pieces", lambda x: x["piece"] <= at.get(e, len(edges))), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    rows = F.array(*(F.struct(F.lit(i).alias("rng"), below(b).alias("first"), below(e).alias("past")) for i, (b, e) in enumerate(ranges)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def pull(model: DataFrame, keys: DataFrame, key: str = "fid") -> DataFrame:
    """The model's rows for distinct keys; those it lacks come out with null columns. The model doesn't grow."""
    return keys.select(key).distinct().join(model, key, "left")


def push(model: DataFrame, updates: DataFrame, op: str = "plus", key: str = "key", value: str = "value") -> DataFrame:
    """Values of either, updated: what kv_union gives."""
    return kv_union(model, updates, key, value, op)
