"""Containers of fixed capacity filled with items by harmonic classes, and their leftover room."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items that are packed together, about; the containers that are left part empty are few beside those.
SHARE = 50_000


def harmonic(items: DataFrame) -> DataFrame:
    """Harmonic packing: the items with class and bin. items: group, share, key, size, capacity, and others that are kept; sizes are from 1 to the capacity.

    An item of more than capacity / (j + 1) and at most capacity / j is of class j, and a bin of class j holds exactly j items of its class, whatever they are; the last bin
    of a class in a share may hold fewer. Each class of each share is numbered by itself, so workers need nothing from one another. Bins of a class are
    filled in order of size, which puts items of about the same size together.
    """
    of = Window.partitionBy("group", "share", "class").orderBy(F.desc("size"), "key", "id")
    classed = items.withColumn("class", F.floor(F.col("capacity") / F.col("size")).cast("bigint"))
    return classed.withColumn("bin", F.floor((F.row_number().over(of) - 1) / F.col("class")).cast("bigint"))


def top_up(kind: np.ndarray, number: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0, after the room that harmonic bins leave is filled. kind, number: the class and bin of each item.

    Bins are opened in order of class, those of large items first. An open bin keeps the items that it still has, and the room left takes the largest item that fits, of those in
    bins that aren't open yet, again and again; of items of one size the one in the last bin goes first. A bin that has lost all its items is none.
    """
    order = np.lexsort((np.arange(len(sizes)), number, kind))
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for at, i in enumerate(order.tolist()):
        by_size[sizes[i]].append(at)  # so the last one of a size lies in the last bin
    held = sizes[order].tolist()
    firsts = np.flatnonzero(np.r_[True, (np.diff(kind[order]) != 0) | (np.diff(number[order]) != 0)]).tolist() if len(sizes) else []
    where = [-1] * len(held)
    left = [len(x) for x in by_size]
    #: below[s] leads to the largest size of at most s of which items are left; 0 if none.
    below = [s if s and left[s] else s - 1 for s in range(capacity + 1)]
    below[0] = 0

    def largest(s: int) -> int:
        root = s
        while below[root] != root:
            root = below[root]
        while below[s] != root:
            below[s], s = root, below[s]
        return root

    def take(s: int) -> None:
        left[s] -= 1
        if not left[s]:
            below[s] = s - 1

    used = 0
    for a, b in zip(firsts, [*firsts[1:], len(held)], strict=False):
        own = [i for i in range(a, b) if where[i] < 0]
        if not own:
            continue
        room = capacity
        for i in own:
            where[i] = used
            room -= held[i]
            take(held[i])
        while room and (s := largest(room)):
            where[by_size[s].pop()] = used
            room -= s
            take(s)
        used += 1
    out = np.empty(len(sizes), np.int64)
    out[order] = where
    return out


def pack(items: DataFrame, key: str, size: str, capacity: Column, group: str, shares: int, topped: bool = True) -> DataFrame:
    """Items of each group (a bigint: a limit) in containers of its capacity: group, container, key, piece, first, size.

    An item of more than the capacity is split into pieces of it, each of which fills a container, and a rest, packed like other items; first is where a piece begins.
    No other item is split. Items of no or null size, and those of a group whose capacity is null or below 1, take no container. Items with the same key
    are separate ones. An empty table gives no row.

    Each group is dealt into shares, whatever its keys; a share should have about SHARE items. In each, harmonic packs the items; topped: then top_up fills the room that is left,
    and fewer containers are needed.
    """
    rows = items.select(F.col(group).cast("bigint").alias("group"), F.col(key).cast("bigint").alias("key"), F.col(size).cast("bigint").alias("size"), capacity.cast("bigint").alias("capacity"))
    rows = rows.filter((F.col("size") > 0) & (F.col("capacity") > 0))
    full = F.floor(F.col("size") / F.col("capacity")).cast("bigint")
    many = F.when(F.col("size") > F.col("capacity"), full).otherwise(F.lit(0))
    cutted = rows.withColumn("many", many)
    whole = cutted.filter(F.col("many") > 0).select("group", "key", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1)).alias("piece"))
    whole = whole.select("group", F.concat_ws("-", F.lit("s"), F.coalesce(F.col("key").cast("string"), F.lit("null")), "piece").alias("container"), "key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("first"), F.col("capacity").alias("size"))
    rest = cutted.withColumn("rest", F.col("size") - F.col("many") * F.col("capacity")).filter(F.col("rest") > 0).withColumn("id", F.monotonically_increasing_id())
    rest = rest.select("group", F.pmod(F.xxhash64("key", "id"), F.lit(shares)).cast("int").alias("share"), "key", "id", F.col("many").cast("int").alias("piece"), (F.col("many") * F.col("capacity")).alias("first"), F.col("rest").alias("size"), "capacity")
    # Laid out by share, which serves the numbering in classes and what comes after it.
    binned = harmonic(rest.repartition("group", "share"))
    if not topped:
        return binned.select("group", F.concat_ws("-", "share", "class", "bin").alias("container"), "key", "piece", "first", "size").unionByName(whole)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = top_up(*(pdf[c].to_numpy(np.int64) for c in ("class", "bin", "size")), int(pdf["capacity"].iloc[0]))
        return pdf[["group", "key", "piece", "first", "size"]].assign(container=[f"{pdf['share'].iloc[0]}-{x}" for x in at])

    packed = binned.groupBy("group", "share").applyInPandas(one, "group bigint, key bigint, piece int, first bigint, size bigint, container string")
    return packed.unionByName(whole)
