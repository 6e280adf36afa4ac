from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.frequency import distinct_count, marked, term_counts
from millrace.llm.frequent import at_least, top_values

SCHEMA = "term bigint, rec bigint, unit int, weight double, before int, total string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows, unit=True):
    seen, n, recs = set(), Counter(), defaultdict(set)
    for t, r, u, w in rows:
        if t is None or r is None:
            continue
        recs[t].add(r)
        if not unit or (t, r, u) not in seen:
            n[t] += 1
        seen.add((t, r, u))
    return {t: (n[t], len(recs[t])) for t in recs}


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("partitions", [None, 7])
def test_counts(spark, seed, partitions):
    r = np.random.default_rng(seed)
    rows = [(int(r.choice([0, 1, -5, int(r.integers(0, 40))])), int(r.integers(0, 15)), None if r.random() < 0.1 else int(r.integers(0, 3)), 1.0) for _ in range(800)]
    rows += [(None, 1, 1, 1.0), (3, None, 1, 1.0)] + rows[:100]
    df = table(spark, rows)
    got = {x.term: (x.total, x.records) for x in term_counts(df, "term", "rec", ["unit"], partitions=partitions).collect()}
    assert got == brute(rows)
    got = {x.term: (x.total, x.records) for x in term_counts(df, "term", "rec", partitions=partitions).collect()}
    assert got == brute(rows, unit=False)


def test_weights_count_once_per_unit(spark):
    df = table(spark, [(1, 1, 0, 2.0), (1, 1, 0, 2.0), (1, 2, 0, 3.0), (2, 1, 0, 4.0)])
    assert {x.term: (x.total, x.records) for x in term_counts(df, "term", "rec", ["unit"], F.col("weight")).collect()} == {1: (5.0, 2), 2: (4.0, 1)}


def test_a_term_with_a_third_of_the_rows_is_shared_out(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("t"), "id")
    counts = term_counts(df, "t", "id", partitions=8)
    top = counts.orderBy(F.desc("total")).first()
    assert (top.term, top.total, top.records) == (7, 10_000 + (7 % 3 != 0), 10_000 + (7 % 3 != 0))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "rangepartitioning" in plan


def test_marks_and_empty(spark):
    df = table(spark, [(1, r, 0, 1.0) for r in range(10)] + [(2, r, 0, 1.0) for r in range(5)] + [(3, 0, 0, 1.0)])
    got = {x.term: x.mark for x in marked(term_counts(df, "term", "rec"), 1, 0.5, distinct_count(df, "rec")).collect()}
    assert got == {1: "common", 2: None, 3: "rare"}
    assert term_counts(df.limit(0), "term", "rec", ["unit"]).count() == 0


def test_top_values(spark):
    values = [5] * 10 + [3] * 10 + [None] * 50 + [-1] * 4 + list(range(100, 140))
    df = spark.createDataFrame([(v, "x") for v in values], "v bigint, n string")
    assert [(r.value, r.n) for r in top_values(df, "v", 4).collect()] == [(3, 10), (5, 10), (-1, 4), (100, 1)]
    assert [(r.value, r.n) for r in at_least(df, "v", 10 / 64).orderBy("value").collect()] == [(3, 10), (5, 10)]
    assert top_values(df.limit(0), "v", 3).count() == 0 and at_least(df.limit(0), "v", 0.5).count() == 0
    assert top_values(df, "v", 1000).count() == 43
    with pytest.raises(ValueError):
        top_values(df, "v", 0)
    with pytest.raises(ValueError):
        at_least(df, "v", 0)
    even = spark.range(100).select((F.col("id") % 4).alias("v"))
    assert at_least(even, "v", 0.25).count() == 4
