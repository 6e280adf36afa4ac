import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import ids as I

VALUES = [0, 1, 5, 2**63 - 1, -1, -(2**63), 0x123456789ABCDEF, -4609863, 4096, None]


def test_reversing_is_an_involution_and_orders_as_unsigned(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x bigint")
    rows = df.select("x", I.reverse_id("x").alias("r"), I.reverse_id(I.reverse_id("x")).alias("back"), I.reversed_hex("x").alias("h")).collect()
    for r in rows:
        assert r.back == r.x
        if r.x is not None:
            assert r.h == f"{r.x % 2**64:016X}"[::-1]
            assert r.r % 2**64 == int(r.h, 16)


def test_groups(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x bigint")
    for r in df.select("x", I.encode_group("x", F.lit(7), 12).alias("e"), I.decode_group("x", 12).alias("d")).collect():
        if r.x is not None:
            assert r.e % 2**64 == ((r.x << 12) | 7) % 2**64
            assert r.d == r.x % 4096
        else:
            assert r.e is None and r.d is None
    with pytest.raises(PySparkException):
        df.select(I.encode_group("x", F.lit(4096), 12)).collect()


@pytest.mark.parametrize("buckets", [1, 2, 1000, 2**30, 2**30 + 1, 2**63 - 1])
def test_hashing_takes_ids_as_unsigned(spark, buckets):
    df = spark.createDataFrame([(v,) for v in VALUES], "x bigint")
    for r in df.select("x", I.hash_mod("x", buckets).alias("m")).collect():
        assert r.m == (None if r.x is None else (r.x % 2**64) % buckets)


def test_unsigned_and_digits(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("9223372036854775808",), ("0",)], "t string")
    assert [r.x for r in df.select(I.from_digits("t").alias("x")).collect()] == [-1, -(2**63), 0]
    back = df.select(I.unsigned(I.from_digits("t")).cast("string").alias("t"))
    assert [r.t for r in back.collect()] == [r.t for r in df.collect()]


def test_segments_cover_the_range():
    for begin, end, parts in [(0, 10, 3), (7, 1_000_003, 9), (0, 2**64 - 1, 7), (5, 5, 2)]:
        cuts = [I.segment(begin, end, i, parts) for i in range(parts)]
        assert cuts[0][0] == begin and cuts[-1][1] == end
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    with pytest.raises(ValueError):
        I.segment(0, 10, 3, 3)


def test_ranges_and_places_among_edges(spark):
    r = random.Random(5)
    ids = [r.getrandbits(64) for _ in range(200)] + [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    signed = [x - 2**64 if x >= 2**63 else x for x in ids]
    df = spark.createDataFrame(list(zip(range(len(ids)), signed)), "n int, x bigint")
    for edges in ([], [0], [2**63], [5, 7, 2**63 - 1, 2**64 - 1], sorted(r.getrandbits(64) for _ in range(900)), sorted({r.getrandbits(20) for _ in range(300)} | {2**64 - 2})):
        got = {x.n: x.k for x in df.select("n", I.edges_below(edges, I.ordered("x")).alias("k")).collect()}
        assert all(got[i] == sum(e <= x for e in edges) for i, x in enumerate(ids))
    for a in (I.Range(0, 10), I.Range(2**63 - 5, 2**63 + 5), I.ALL, I.Range(0, 2**64), I.Range(5, 5)):
        got = {x.n: x.k for x in df.select("n", a.holds("x").alias("k")).collect()}
        assert all(got[i] == a.has(x) for i, x in enumerate(ids))
    a = I.Range(2, 6)
    assert (a + 1, a - 1, a * 3) == (I.Range(3, 7), I.Range(1, 5), I.Range(6, 18)) and a.size == 4 and a.valid and not I.Range(6, 6).valid and a.segment(1, 2) == I.Range(4, 6)
