"""Examples of evaluation splits that also stand, exactly or nearly, in the training split: an edit-distance segment join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

SID = ["s1", "s2"]
#: Tasks among which the training strings that hold one segment are dealt; larger ones are split by Spark's own skew join.
SALTS = 4
#: Symbols that are verified at once in a worker, about.
CELLS = 1_000_000


@dataclass
class Overlap:
    """members: row_id, role (train or eval), split, source, s1, s2 (the set's key), one row per row_id and spelling-free split.
    links: e1, e2, t1, t2, the keys of an evaluation set and a training set that are alike."""

    members: DataFrame
    links: DataFrame


def _members(rows: DataFrame) -> DataFrame:
    split = F.lower(F.btrim("split_name", F.lit(" \t\r\n")))
    ids = F.array_except(F.col("features")["idx"], F.array(F.lit(None).cast("bigint")))  # distinct ones, without null
    # One order for all strings, by hashes: frequent ids then stand between rare ones, so few segments are made of frequent ones alone.
    string = F.transform(F.sort_array(F.transform(ids, lambda x: F.struct(F.xxhash64(x).alias("at"), x.alias("id")))), lambda x: x["id"])
    some = F.exists("features", lambda x: x["idx"].isNotNull())
    out = rows.filter(some).select("row_id", split.alias("split"), "source", string.alias("string")).filter(F.col("row_id").isNotNull() & F.col("split").isin("train", "val", "test"))
    # Two hashes with different starts: 128 bits in all.
    return out.withColumns({"role": F.when(F.col("split") == "train", "train").otherwise("eval"), "s1": F.xxhash64("string"), "s2": F.xxhash64(F.lit("other"), "string")})


def most_edits(n: Column, m: Column, least: float) -> Column:
    """Insertions and deletions that may part two strings of so many distinct symbols whose sets have at least that Jaccard similarity."""
    return n + m - 2 * F.ceil((n + m) * F.lit(least / (1 + least)) - F.lit(1e-9))


def segment_number(n: Column, least: float) -> Column:
    """Segments of an evaluation string of n symbols: one more than the edits that part it from any string alike, k = n (1 - least) / least at most."""
    return (F.floor(n * F.lit((1 - least) / least) + F.lit(1e-9)) + 1).cast("int")


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Insertions and deletions that turn a[i] into b[i]; where they are more than most[i], a number above it.

    Only cells of the table at most k off its diagonal are made, for all pairs at once, one anti-diagonal after the other: a cell needs its neighbours on the one before
    and the cell on the one before that. A step is a few operations on whole arrays.
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    k = int(max(1, most.max()))
    far = np.int32(1 << 29)
    rows, cols = int(n.max()), int(m.max())
    left, right = np.zeros((len(a), rows), np.int64), np.zeros((len(a), cols), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    # Cell (i, j) stands at place j - i + k + 1, with a place on either side that stays far away.
    older, old = (np.full((len(a), 2 * k + 3), far, np.int32) for _ in range(2))
    old[:, k + 1] = 0
    out = np.where(n + m == 0, 0, far).astype(np.int32)
    end, place = n + m, np.clip(m - n + k + 1, 0, 2 * k + 2)
    for t in range(1, rows + cols + 1):
        new = older  # its cells have the parity of t, and are all made anew or put far away
        first = max(0, t - cols, -(-(t - k) // 2))  # smallest row of the band on this anti-diagonal
        last = min(rows, t, (t + k) // 2)
        if first > last:
            break
        i = np.arange(last, first - 1, -1)  # so that places ascend
        at = slice(t - 2 * last + k + 1, t - 2 * first + k + 2, 2)
        step = np.minimum(old[:, at.start - 1 : at.stop - 1 : 2], old[:, at.start + 1 : at.stop + 1 : 2]) + 1
        same = (left[:, i - 1] == right[:, t - i - 1]) & ((i > 0) & (i < t))
        cells = np.where(same, np.minimum(step, older[:, at]), step)
        new[:, (t + k + 1) % 2 :: 2] = far
        new[:, at] = cells
        older, old = old, new
        done = end == t
        if done.any():
            out[done] = new[done, place[done]]
    return out


def _verified(candidates: DataFrame, least: float) -> DataFrame:
    """candidates: e1, e2, t1, t2, a, b (the strings), most. Keeps those whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            strings = [np.asarray(whole.column(c).flatten()) for c in (4, 5)]
            ends = [np.asarray(whole.column(c).offsets) - whole.column(c).offsets[0].as_py() for c in (4, 5)]
            most = np.asarray(whole.column(6))
            size = np.maximum(*(np.diff(e) for e in ends))
            good = []
            order = np.argsort(size, kind="stable")  # strings of about the same length together, and fewer of long ones
            at = 0
            while at < len(order):
                part = order[at : at + 2048]
                part = part[: max(1, int(np.sum(np.arange(1, len(part) + 1) * size[part] <= CELLS)))]
                at += len(part)
                a, b = ([s[e[i] : e[i + 1]] for i in part] for s, e in zip(strings, ends, strict=True))
                edits = banded_distance(a, b, most[part])
                n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
                common = (n - edits) / 2
                good.append(part[(edits <= most[part]) & (common >= least * (n - common))])
            take = pa.array(np.concatenate(good) if good else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([whole.column(c).take(take) for c in range(4)], ["e1", "e2", "t1", "t2"])

    return candidates.select("e1", "e2", "t1", "t2", "a", "b", "most").mapInArrow(run, "e1 bigint, e2 bigint, t1 bigint, t2 bigint")


def _segments(strings: DataFrame, least: float) -> DataFrame:
    """The segments of evaluation strings, which together are all of each: place (of the first symbol) and segment (the hash of the symbols that all segments of the string have). See overlap."""
    n, i = F.size("string"), F.col("i")
    whole = segment_number(n, least)
    lost = (n - F.ceil(n * F.lit(least) - F.lit(1e-9))).cast("int")
    cut_up = strings.withColumn("number", F.when(whole <= n, whole).otherwise(n)).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(whole <= n, whole - 1).otherwise(lost))))
    placed = cut_up.withColumns({"place": F.floor(i * n / F.col("number")).cast("int"), "length": F.floor(n / F.col("number")).cast("int")})
    return placed.withColumn("segment", F.xxhash64(F.slice("string", F.col("place") + 1, F.col("length"))))


def _substrings(strings: DataFrame, least: float) -> DataFrame:
    """The substrings of training strings that are as long as a segment of an evaluation string of like length: place and segment."""
    m = F.size("string")
    partner = F.sequence(F.ceil(m * F.lit(least) - F.lit(1e-9)).cast("int"), F.floor(m / F.lit(least) + F.lit(1e-9)).cast("int"))
    lengths = strings.withColumn("length", F.explode(F.array_distinct(F.transform(partner, lambda n: F.greatest(F.floor(n / segment_number(n, least)).cast("int"), F.lit(1))))))
    places = lengths.filter(F.col("length") <= m).withColumn("place", F.explode(F.sequence(F.lit(0), m - F.col("length"))))
    return places.withColumn("segment", F.xxhash64(F.slice("string", F.col("place") + 1, F.col("length"))))


def overlap(rows: DataFrame, least: float = 0.75) -> Overlap:
    """Links between distinct sets of feature ids, of at least that Jaccard similarity, one of which an evaluation row has and the other a training row.

    rows: row_id, split_name, source, features (array of idx, val); other columns are ignored. Rows without row_id, split or any non-null idx are in no link; the split's
    case and outer blanks don't matter; order and repetition of idx don't either. Redelivered rows count once. Copies of a set are one set with many members, so a
    group of copies of any size makes one link, not one per pair.

    The ids of a set in the order of their hashes are its string. As its symbols are distinct and all strings are in one order, the insertions and deletions between two
    strings are the ids that only one set holds. The whole evaluation string is cut into k + 1 segments, where k is the most edits that may part it from a string alike; each
    edit spoils one segment at most, so one segment at least stands unspoilt in the other string, at a place that the edits before and after it allow. The segments of a string
    have L or L + 1 symbols (at 0.75 L is 2, and 1 for some strings of 1 to 5 symbols) and are looked up by their first L. Training strings give their substrings of
    those lengths, and the two meet by the segment. Bounds so low that k + 1 is more than the symbols make segments of one symbol, which only deletions spoil: one
    more than may be deleted.
    A pair that meets has to pass a comparison of 32-bit marks of its sets (a bit for each id's hash; sets that differ in d ids differ in d bits at most), and what passes is
    verified by a banded dynamic program, all of it: nothing is capped or sampled. The training strings that hold one segment are dealt among SALTS tasks.
    """
    members = _members(rows)
    train, test = 1, 2
    roles = F.bit_or(F.when(F.col("role") == "train", train).otherwise(test)).alias("roles")
    # The string is a key too, so the hashes decide nothing. Written, as four branches read it.
    sets = cut(members.groupBy(*SID, "string").agg(roles))
    marked = F.aggregate("string", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(x).bitwiseAND(F.lit(31).cast("bigint")).cast("int"))))
    low = F.lit(0xFFFFFFFF).cast("bigint")
    # A number for a set: half a hash and the mark. Sets may share a number: all of them are then verified.
    number = F.col("s1").bitwiseAND(F.bitwise_not(low)).bitwiseOR(marked)

    def cuts(role: int, key: str, make) -> DataFrame:
        of = sets.filter(F.col("roles").bitwiseAND(F.lit(role)) > 0).select(number.alias(key), "string", F.size("string").alias(f"{key}_size"))
        return make(of, least).select(key, f"{key}_size", F.col("place").alias(f"{key}_at"), "segment")

    tests = cuts(test, "e", _segments).withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    trains = cuts(train, "t", _substrings).withColumn("salt", F.pmod(F.shiftright("t", 32), F.lit(SALTS)).cast("int"))
    n, m, p, q = (F.col(c) for c in ("e_size", "t_size", "e_at", "t_at"))
    most = most_edits(n, m, least)
    close = (m >= n * F.lit(least)) & (n >= m * F.lit(least)) & (F.abs(p - q) + F.abs((n - p) - (m - q)) <= most) & (F.bit_count(F.col("e").bitwiseXOR(F.col("t")).bitwiseAND(low)) <= most)
    pairs = tests.join(trains, ["segment", "salt"]).filter(close).select("e", "t").distinct()
    of = lambda key, x, y, name, role: sets.filter(F.col("roles").bitwiseAND(F.lit(role)) > 0).select(number.alias(key), F.col("s1").alias(x), F.col("s2").alias(y), F.col("string").alias(name))
    strings = pairs.join(of("e", "e1", "e2", "a", test), "e").join(of("t", "t1", "t2", "b", train), "t")
    found = _verified(strings.withColumn("most", most_edits(F.size("a"), F.size("b"), least).cast("int")), least)
    return Overlap(members.select("row_id", "role", "split", "source", *SID).distinct(), found)


def row_pairs(o: Overlap) -> DataFrame:
    """row_id_1, row_id_2 (the smaller first) of every evaluation row and training row that are alike, each pair once."""
    rows = o.members.select("row_id", "role", *SID).distinct()
    side = lambda role, names, id_: rows.filter(F.col("role") == role).select(F.col("row_id").alias(id_), *(F.col(c).alias(x) for c, x in zip(SID, names, strict=True)))
    both = o.links.join(side("eval", ["e1", "e2"], "x"), ["e1", "e2"]).join(side("train", ["t1", "t2"], "y"), ["t1", "t2"])
    return both.select(F.least("x", "y").alias("row_id_1"), F.greatest("x", "y").alias("row_id_2")).filter(F.col("row_id_1") != F.col("row_id_2")).distinct()


def report(o: Overlap) -> DataFrame:
    """Per split and source: evaluation rows, and those of them with a training row that is alike, or the same. A null source is one of its own."""
    kinds = o.links.groupBy(F.col("e1").alias("s1"), F.col("e2").alias("s2")).agg(F.lit(1).alias("alike"), F.max(((F.col("e1") == F.col("t1")) & (F.col("e2") == F.col("t2"))).cast("int")).alias("same"))
    rows = o.members.filter(F.col("role") == "eval").join(kinds, SID, "left").groupBy("row_id", "split", "source").agg(F.max("alike").alias("alike"), F.max("same").alias("same"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), some("alike").alias("overlapping"), some("same").alias("exact"))
