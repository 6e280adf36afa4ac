import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.ids import reverse_id
from millrace.operators import kv
from millrace.operators.features import dense_index

OPS = {"assign": lambda a, b: b, "plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "times": lambda a, b: a * b, "divide": lambda a, b: a / b if b else None}


def pairs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "key bigint, value double, a string, b int")


def random_pairs(seed, n, most):
    r = np.random.default_rng(seed)
    keys = sorted(set(r.integers(0, most, n).tolist()))
    return [(k, float(r.integers(-9, 10))) for k in keys]


@pytest.mark.parametrize("op", list(OPS))
def test_match_and_union(spark, op):
    for seed in range(2):
        a, b = random_pairs(seed, 60, 120), random_pairs(seed + 9, 60, 120)
        x, y = dict(a), dict(b)
        got = {r.key: r for r in kv.kv_match(pairs(spark, a), pairs(spark, b), op=op).collect()}
        assert got.keys() == x.keys()
        for k, r in got.items():
            assert r.matched == (k in y) and r.value == (OPS[op](x[k], y[k]) if k in y else x[k])
        got = {r.key: r.value for r in kv.kv_union(pairs(spark, a), pairs(spark, b), op=op).collect()}
        assert got == {k: OPS[op](x.get(k, 0.0), y[k]) if k in y else x[k] for k in x | y}


def test_documented_examples(spark):
    src = spark.createDataFrame([(1, 6.0), (2, 7.0), (3, 8.0)], "key bigint, value double")
    dst = spark.createDataFrame([(1, None), (3, None), (5, None)], "key bigint, value double")
    assert {r.key: r.value for r in kv.kv_match(dst, src).collect()} == {1: 6.0, 3: 8.0, 5: 0.0}
    a = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 4.0)], "key bigint, value double")
    b = spark.createDataFrame([(1, 3.0), (3, 4.0), (5, 5.0)], "key bigint, value double")
    assert {r.key: r.value for r in kv.kv_union(a, b).collect()} == {1: 5.0, 2: 3.0, 3: 8.0, 5: 5.0}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "key bigint")
    pos = lambda s, d: [r.pos for r in kv.find_position(dense_index(ids(s), F.col("key")), ids(d)).orderBy("key").collect()]
    assert pos([3, 5, 7], [1, 3, 4, 7, 8]) == [-1, 0, -1, 2, -1]
    assert pos([1, 3, 4, 7, 8], [3, 5, 7]) == [1, -1, 3]


def test_empty_and_null_keys(spark):
    some, none = pairs(spark, [(1, 2.0), (None, 3.0)]), pairs(spark, [])
    assert {r.key: (r.value, r.matched) for r in kv.kv_match(some, none).collect()} == {1: (2.0, False), None: (3.0, False)}
    assert kv.kv_match(none, some).count() == 0
    assert {r.key: r.value for r in kv.kv_union(some, none, op="minus").collect()} == {1: 2.0, None: 3.0}
    assert {r.key: r.value for r in kv.kv_union(none, some, op="minus").collect()} == {1: -2.0, None: -3.0}
    with pytest.raises(ValueError):
        kv.kv_union(some, none, op="xor")


def test_vectors_and_ragged(spark):
    dst = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None)], "key bigint, value array<double>")
    src = spark.createDataFrame([(2, [10.0, 20.0]), (3, [5.0, 6.0])], "key bigint, value array<double>")
    assert {r.key: r.value for r in kv.kv_match_vectors(dst, src, op="plus").collect()} == {1: [1.0, 2.0], 2: [13.0, 24.0], 3: [5.0, 6.0]}
    assert {r.key: (r.value, r.length) for r in kv.kv_match_ragged(dst, src).collect()} == {1: ([], 0), 2: ([10.0, 20.0], 2), 3: ([5.0, 6.0], 2)}
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, [1.0, 2.0, 3.0]), (None, [1.0])], "key bigint, value array<double>")
    b = spark.createDataFrame([(2, [10.0, 20.0]), (3, [5.0]), (4, [1.0]), (4000, [1.0]), (None, [1.0])], "key bigint, value array<double>")
    assert {r.key: (r.value, r.length) for r in kv.kv_match_ragged(a, b, op="minus").collect()} == {1: ([1.0, 2.0], 2), 2: ([-7.0, -20.0], 2), 3: ([-5.0], 1), 4: ([0.0, 2.0, 3.0], 3), None: ([1.0], 1)}


def test_ranges(spark):
    ids = spark.createDataFrame([(k,) for k in (1, 2, 17, 300, -1)], "fid bigint")
    hexed = sorted(f"{k % 2**64:016X}"[::-1] for k in (1, 2, 17, 300, -1))
    ranges = [(0, 1 << 60), (1 << 60, 2 << 60), (2 << 60, 15 << 60), (15 << 60, 1 << 64)]
    got = [(r.first, r.past) for r in kv.find_ranges(ids, ranges, reverse_id("fid")).orderBy("rng").collect()]
    low = lambda e: sum(int(h, 16) < e for h in hexed)
    assert got == [(low(b), low(e)) for b, e in ranges]


def test_push_and_pull(spark):
    model = spark.createDataFrame([(1, 2.0)], "fid bigint, w double")
    keys = spark.createDataFrame([(1,), (1,), (5,)], "fid bigint")
    assert sorted((r.fid, r.w) for r in kv.pull(model, keys).collect() if r.w) == [(1, 2.0)]
    assert kv.pull(model, keys).count() == 2
