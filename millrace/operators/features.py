"""Features of sparse examples: triples, counts, filters, dense positions, groups and blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.common import ColumnLike, col
from millrace.functions.ids import decode_group, edges_below, hash_mod, ordered, reverse_id, reversed_hex
from millrace.functions.scalars import drawn
from millrace.session import cut

TAIL = 4


def triples(rows: DataFrame) -> DataFrame:
    """row_id, label, fid, val, one per entry of features (an array of idx, val); a null val is 1. Entries without idx, and rows without features, give nothing; keep a table of rows to score those."""
    # An outer explode, as an inner one makes Spark test the array first, and so make it twice.
    one = rows.select("row_id", "label", F.explode_outer("features").alias("x"))
    return one.filter(F.col("x.idx").isNotNull()).select("row_id", "label", F.col("x.idx").alias("fid"), F.coalesce(F.col("x.val"), F.lit(1.0)).cast("double").alias("val"))


def group_rows(entries: DataFrame) -> DataFrame:
    """Triples back as rows: row_id, label, features in id order."""
    return entries.groupBy("row_id", "label").agg(F.array_sort(F.collect_list(F.struct(F.col("fid").alias("idx"), "val"))).alias("features"))


def feature_counts(entries: DataFrame, modulo: int | None = None) -> DataFrame:
    """fid, cnt: entries (not rows) of each feature, combined before they move. modulo: ids are hashed to so many first."""
    fid = F.col("fid") if modulo is None else hash_mod("fid", modulo)
    return entries.filter(F.col("fid").isNotNull()).groupBy(fid.alias("fid")).agg(F.count(F.lit(1)).alias("cnt"))


def frequent_features(counts: DataFrame, above: int = TAIL) -> DataFrame:
    """Features counted more than above times."""
    return counts.filter(F.col("cnt") > above)


def keep_features(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """The entries whose feature is in kept. Rows may lose all their entries; a table of rows still holds them."""
    return entries.join(kept.select("fid"), "fid", "left_semi")


def dense_index(df: DataFrame, order: Column, name: str = "pos") -> DataFrame:
    """The rows with their places in that order, from 0. Ties stand in any order, and may part between ranges however many they are.

    No window over all rows: they are sorted in ranges, written, and each range is told how many rows the ranges before it hold (one number a range).
    """
    keyed = df.withColumns({"_order": order, "_tie": F.monotonically_increasing_id()})
    placed = cut(keyed.repartitionByRange("_order", "_tie").sortWithinPartitions("_order", "_tie").withColumn("_id", F.monotonically_increasing_id()).drop("_tie"))
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + within).cast("bigint").alias(name))


def dictionary(entries: DataFrame, above: int = 0) -> DataFrame:
    """fid, cnt, pos: the features counted more than above times, with their places in unsigned order of the reversed ids."""
    return dense_index(frequent_features(feature_counts(entries), above), reversed_hex("fid"))


def merged_counts(blocks: DataFrame, unit: list[str] | None = None) -> DataFrame:
    """fid, cnt: the counts of blocks (blk, fid, cnt) added up, as a union of all blocks' counts gives. unit: columns of which equal rows were delivered twice, and count once."""
    known = blocks.filter(F.col("fid").isNotNull() & F.col("cnt").isNotNull())
    once = known.dropDuplicates(unit) if unit else known
    return once.groupBy("fid").agg(F.sum(F.col("cnt").cast("double")).alias("cnt"))


def localize(entries: DataFrame, words: DataFrame) -> DataFrame:
    """The entries with pos in place of fid; those of features that the dictionary lacks are dropped."""
    return entries.select("row_id", "label", "fid", "val").join(words.select("fid", "pos"), "fid").select("row_id", "label", "pos", "val")


def column_map(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Per block the distinct ids in order, with local places and those in the dictionary: blk, fid, local, pos (-1 where it lacks the id)."""
    ids = blocks.select("blk", "fid").distinct()
    local = ids.withColumn("local", F.row_number().over(Window.partitionBy("blk").orderBy(reversed_hex("fid"))).cast("bigint") - 1)
    return local.join(words.select("fid", "pos"), "fid", "left").select("blk", "fid", "local", F.coalesce("pos", F.lit(-1).cast("bigint")).alias("pos"))


def in_order(rows: DataFrame, size: int, order: ColumnLike = "row_id") -> DataFrame:
    """The rows with batch_id: so many in each, in that order; the last may be short."""
    if size < 1:
        raise ValueError("a batch holds a row at least")
    return dense_index(rows, col(order), "_place").withColumn("batch_id", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")


def shuffled(rows: DataFrame, size: int, buffer: int, seed: int, order: ColumnLike = "row_id") -> DataFrame:
    """The rows with batch_id after each buffer of so many rows is put in an order that the seed gives. A buffer holds a batch at least."""
    if buffer < size:
        raise ValueError("the buffer must hold a batch")
    placed = dense_index(rows, col(order), "_place").withColumn("_buffer", F.floor(F.col("_place") / buffer))
    mixed = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_buffer").orderBy(drawn("_place", seed), "_place")) - 1 + F.col("_buffer") * buffer)
    return mixed.withColumn("batch_id", F.floor(F.col("_at") / size).cast("bigint")).drop("_place", "_buffer", "_at")


def batches(rows: DataFrame, size: int, parts: int, buffer: int, seed: int, order: ColumnLike = "row_id") -> DataFrame:
    """The rows with part and batch_id: so many parts, each a stretch of the order, and in each batches of so many rows, after every buffer of rows of a part is put in an order that the seed gives. A buffer of 0 shuffles nothing."""
    if size < 1 or parts < 1:
        raise ValueError("a batch holds a row at least, and there is a part at least")
    placed = dense_index(rows, col(order), "_place")
    n = F.greatest(placed.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(1))
    dealt = placed.withColumn("part", F.floor(F.col("_place") * parts / n).cast("int"))
    at = F.col("_place") - F.ceil(F.col("part") * n / parts)
    if buffer:
        mixed = dealt.withColumn("_buffer", F.floor(at / max(buffer, size)))
        within = Window.partitionBy("part", "_buffer").orderBy(drawn("_place", seed), "_place")
        dealt, at = mixed.withColumn("_at", F.row_number().over(within) - 1 + F.col("_buffer") * max(buffer, size)), F.col("_at")
    return dealt.withColumn("batch_id", F.floor(at / size).cast("bigint")).drop("_place", "_buffer", "_at")


def keep_negatives(rows: DataFrame, share: float, key: str = "row_id", seed: int = 0, inverted: bool = False) -> DataFrame:
    """All rows with a positive label, and the share of the others. inverted: share is what is dropped, as an older reader had it."""
    kept = 1 - share if inverted else share
    return rows.filter((F.col("label") > 0) | (drawn(key, seed) < kept))


def part_of(rows: DataFrame, part: int, parts: int, key: str = "row_id") -> DataFrame:
    """Part of so many parts of the rows, by the key's hash."""
    if not 0 <= part < parts:
        raise ValueError("no such part")
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def every_tenth(rows: DataFrame, block: str = "blk", order: str = "row_id", step: int = 10) -> DataFrame:
    """Every tenth row of each block, its first one included. Blocks are of bounded size, as a reader makes them."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(block).orderBy(order)) - 1).filter(F.col("_k") % step == 0).drop("_k")


def _group(bits: int) -> Column:
    if not 0 <= bits <= 16:
        raise ValueError("groups have at most 16 bits")
    return decode_group("fid", bits).alias("grp")


def group_counts(counts: DataFrame, bits: int) -> DataFrame:
    """Per feature group the entries of its features: grp, nnz. counts: fid, cnt."""
    return counts.groupBy(_group(bits)).agg(F.sum("cnt").alias("nnz"))


def group_stats(entries: DataFrame, sampled: DataFrame, bits: int) -> DataFrame:
    """Per feature group the entries on sampled rows: grp, nnz. sampled: row_id of the sampled rows."""
    return entries.join(sampled.select("row_id"), "row_id", "left_semi").groupBy(_group(bits)).agg(F.count(F.lit(1)).alias("nnz"))


def plan_blocks(stats: dict[int, int], sampled: int, bits: int, ratio: float) -> list[tuple[int, int]]:
    """Half-open ranges of reversed ids, in order and without gaps inside a group. stats: entries on sampled rows by group, at most 2^16 numbers.

    A group of so many entries a sampled row gets that number times ratio blocks, rounded up; the group's digits stand first in a reversed id, so bits is a multiple of 4.
    """
    if bits % 4:
        raise ValueError("group bits must be a multiple of 4")
    width, out = 1 << (64 - bits), []
    for group, nnz in sorted(stats.items()):
        n = math.ceil(nnz / max(1, sampled) * ratio)
        if n < 1:
            continue
        digits = f"{group:0{bits // 4}x}"[::-1] if bits else "0"
        begin = int(digits, 16) * width if bits else 0
        edges = [begin + width * i // n for i in range(n)] + [begin + width]
        out += list(zip(edges, edges[1:], strict=False))
    return sorted(out)


def assign_blocks(entries: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """The entries with fblk, the number of the range that holds their reversed id; those in no range are dropped. A plan has at most 2^16 groups times a few blocks; its edges are literal arrays, of which an id is compared with those that share its leading bits."""
    if not plan:
        return entries.withColumn("fblk", F.lit(0)).filter(F.lit(False))
    last = F.lit(np.array([e - 1 - (1 << 63) for _, e in plan], np.int64))
    keyed = entries.withColumn("_key", ordered(reverse_id("fid")))
    found = keyed.withColumn("fblk", edges_below([b for b, _ in plan], F.col("_key")) - 1)
    return found.filter((F.col("fblk") >= 0) & (F.col("_key") <= F.get(last, F.col("fblk")))).drop("_key")
