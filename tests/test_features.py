import pytest
from brute import sample
from pyspark.sql import functions as F

from millrace.functions.ids import reversed_hex
from millrace.operators import features as X

ROWS = "row_id bigint, label double, features array<struct<idx: bigint, val: double>>, cnt string, val int"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], ROWS)


def test_triples_with_nulls(spark):
    df = rows(spark, [(1, 1.0, [(5, None), (None, 2.0), (5, 3.0)]), (2, None, []), (3, 0.0, None)])
    assert sorted((r.row_id, r.fid, r.val) for r in X.triples(df).collect()) == [(1, 5, 1.0), (1, 5, 3.0)]
    assert X.triples(df.limit(0)).count() == 0
    again = X.group_rows(X.triples(df)).first()
    assert [(x.idx, x.val) for x in again.features] == [(5, 1.0), (5, 3.0)]


def test_counts_filters_and_dictionary(spark):
    data = sample()
    e = X.triples(rows(spark, data))
    count = {}
    for _, _, f in data:
        for k, _ in f:
            count[k] = count.get(k, 0) + 1
    assert {r.fid: r.cnt for r in X.feature_counts(e).collect()} == count
    kept = {k for k, n in count.items() if n > 8}
    assert {r.fid for r in X.keep_features(e, X.frequent_features(X.feature_counts(e), 8)).collect()} == kept
    words = X.dictionary(e, 8)
    order = sorted(kept, key=lambda k: f"{k:016X}"[::-1])
    assert {r.fid: r.pos for r in words.collect()} == {k: i for i, k in enumerate(order)}
    assert X.localize(e, words).count() == sum(count[k] for k in kept)
    local = X.column_map(e.withColumn("blk", F.col("row_id") % 3), words).collect()
    for r in local:
        assert r.pos == (order.index(r.fid) if r.fid in kept else -1)
    for b in range(3):
        own = sorted((r.local, f"{r.fid:016X}"[::-1]) for r in local if r.blk == b)
        assert [x for x, _ in own] == list(range(len(own))) and [h for _, h in own] == sorted(h for _, h in own)


def test_hashing_merges_but_keeps_entries(spark):
    e = X.triples(rows(spark, sample()))
    hashed = X.feature_counts(e, 7).collect()
    assert len(hashed) <= 7 and sum(r.cnt for r in hashed) == e.count()


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("pos2")).repartition(7)
    assert all(r.pos == r.k for r in X.dense_index(df, F.col("k")).collect())
    assert X.dense_index(df.limit(0), F.col("k")).count() == 0
    same = X.dense_index(df.withColumn("k", F.lit(1)), F.col("k"))
    assert sorted(r.pos for r in same.collect()) == list(range(1000))


def test_batches(spark):
    df = rows(spark, sample(rows=103))
    got = {r.batch_id: (r.n, r.a, r.b) for r in X.in_order(df, 37).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).collect()}
    assert got == {0: (37, 0, 36), 1: (37, 37, 73), 2: (29, 74, 102)}
    mixed = X.shuffled(df, 10, 50, 1).select("row_id", "batch_id").collect()
    assert sorted(r.row_id for r in mixed) == list(range(103))
    assert all(r.row_id // 50 == r.batch_id * 10 // 50 for r in mixed)
    assert any(r.row_id // 10 != r.batch_id for r in mixed)
    with pytest.raises(ValueError):
        X.shuffled(df, 10, 5, 1)


def test_sampling_and_parts(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    kept = X.keep_negatives(df, 0.25)
    assert kept.filter("label > 0").count() == 5000
    assert abs(kept.filter("label <= 0").count() / 15_000 - 0.25) < 0.02
    assert abs(X.keep_negatives(df, 0.25, inverted=True).filter("label <= 0").count() / 15_000 - 0.75) < 0.02
    parts = [X.part_of(df, i, 3).select("row_id") for i in range(3)]
    assert sum(p.count() for p in parts) == 20_000 and parts[0].union(parts[1]).union(parts[2]).distinct().count() == 20_000
    tenth = X.every_tenth(df.withColumn("blk", F.floor(F.col("row_id") / 25)))
    assert [r.row_id for r in tenth.orderBy("row_id").limit(6).collect()] == [0, 10, 20, 25, 35, 45]


@pytest.mark.parametrize("bits", [0, 4, 12])
def test_blocks_cover_their_groups(spark, bits):
    ids = [(x << bits) | (x % 3) for x in range(1, 400)]
    e = spark.createDataFrame([(i, 1.0, f, 1.0) for i, f in enumerate(ids)], "row_id bigint, label double, fid bigint, val double")
    stats = {r.grp: r.nnz for r in X.group_stats(e, e, bits).collect()}
    assert sum(stats.values()) == 399
    plan = X.plan_blocks(stats, 100, bits, 2.0)
    assert all(a[1] <= b[0] for a, b in zip(plan, plan[1:]))
    got = {r.fid: r.fblk for r in X.assign_blocks(e, plan).collect()}
    assert len(got) == len(set(ids))
    for f, b in got.items():
        assert plan[b][0] <= int(f"{f:016X}"[::-1], 16) < plan[b][1]
    assert X.assign_blocks(e, []).count() == 0
    with pytest.raises(ValueError):
        X.plan_blocks(stats, 100, 3, 1.0)


def test_unsigned_order(spark):
    df = spark.createDataFrame([(k,) for k in (1, -1, 2**62, 8)], "fid bigint")
    assert [r.fid for r in df.orderBy(reversed_hex("fid")).collect()] == sorted((1, -1, 2**62, 8), key=lambda k: f"{k % 2**64:016X}"[::-1])
