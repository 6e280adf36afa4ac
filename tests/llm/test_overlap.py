import numpy as np
import pytest

from millrace.llm.overlap import banded_distance, overlap, report, row_pairs

SCHEMA = "row_id bigint, split_name string, source string, features array<struct<idx: bigint, val: double>>, n int, id string"
SPLITS = ["train", " Train ", "TRAIN", "val", "Val\t", "test", None, "other"]


def table(spark, rows):
    return spark.createDataFrame([(i, s, src, None if f is None else [(x, 1.0) for x in f], 1, "x") for i, s, src, f in rows], SCHEMA)


def brute(rows, least=0.75):
    clean = {(i, s.strip().lower(), frozenset(x for x in f or [] if x is not None)) for i, s, _, f in rows if s is not None and i is not None}
    train = [(i, f) for i, s, f in clean if s == "train" and f]
    tests = [(i, f) for i, s, f in clean if s in ("val", "test") and f]
    return {(min(i, j), max(i, j)) for i, a in tests for j, b in train if i != j and len(a & b) / len(a | b) >= least}


@pytest.mark.parametrize("seed", range(4))
def test_pairs_equal_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(160):
        if rows and r.random() < 0.6:
            base = [x for x in rows[int(r.integers(0, len(rows)))][3] or [] if x is not None]
            f = [x for x in base if r.random() > 0.1] + r.integers(-3, 60, int(r.integers(0, 3))).tolist()
        else:
            f = r.integers(-3, 60, int(r.integers(0, 25))).tolist()
        r.shuffle(f)
        rows.append((i, SPLITS[int(r.integers(0, len(SPLITS)))], "s", f))
    rows += [(500, "val", None, [1, None, 1, 2, 3]), (501, "train", "s", [3, 2, 1]), (502, "train", "s", None), (503, "val", "s", []), (None, "val", "s", [1, 2, 3]), rows[3], rows[4]]
    got = {(x.row_id_1, x.row_id_2) for x in row_pairs(overlap(table(spark, rows))).collect()}
    assert got == brute(rows) and (500, 501) in got


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.9, 1.0])
def test_other_bounds(spark, least):
    r = np.random.default_rng(9)
    rows = [(i, "train" if i % 2 else "test", "s", sorted(set(r.integers(0, 14, 9).tolist()))) for i in range(120)]
    assert {(x.row_id_1, x.row_id_2) for x in row_pairs(overlap(table(spark, rows), least)).collect()} == brute(rows, least)


def test_short_sets(spark):
    rows = [(i, "train" if i % 2 else "val", "s", sorted({i // 2 % 3, *[10 + i % 5] * (i % 3 > 0), *[20 + i % 2] * (i % 3 > 1)})) for i in range(60)]
    for least in (0.3, 0.5, 0.75):
        assert {(x.row_id_1, x.row_id_2) for x in row_pairs(overlap(table(spark, rows), least)).collect()} == brute(rows, least)


def test_copies_are_one_link(spark):
    rows = [(i, "train" if i % 3 else "val", "s", [1, 2, 3, 4]) for i in range(90)] + [(200, "val", "t", [1, 2, 3, 4, 5]), (201, "val", "t", [9])]
    o = overlap(table(spark, rows))
    assert o.links.count() == 2
    assert {(x.row_id_1, x.row_id_2) for x in row_pairs(o).collect()} == brute(rows)
    got = {(r.split, r.source): (r.rows, r.overlapping, r.exact) for r in report(o).collect()}
    assert got == {("val", "s"): (30, 30, 30), ("val", "t"): (2, 1, 0)}


def test_few_ids_in_many_sets(spark):
    """Each id is held by a third of the sets and more, so no segment is rare."""
    r = np.random.default_rng(11)
    rows = [(i, "train" if i % 3 else "val", "s", sorted(r.choice(16, int(r.integers(4, 13)), replace=False).tolist())) for i in range(300)]
    assert {(x.row_id_1, x.row_id_2) for x in row_pairs(overlap(table(spark, rows))).collect()} == brute(rows)


def test_empty_and_long(spark):
    assert row_pairs(overlap(table(spark, []))).count() == 0 and report(overlap(table(spark, []))).count() == 0
    long = list(range(3000))
    rows = [(1, "train", "s", long), (2, "val", "s", long[300:]), (3, "val", "s", long[:1000])]
    assert {(x.row_id_1, x.row_id_2) for x in row_pairs(overlap(table(spark, rows))).collect()} == {(1, 2)}


def test_banded_distance():
    r = np.random.default_rng(0)

    def plain(a, b):
        t = np.arange(len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(t[j] if x == y else min(t[j + 1], new[j]) + 1)
            t = np.array(new)
        return t[-1]

    a = [r.integers(0, 6, r.integers(1, 15)) for _ in range(200)]
    b = [r.integers(0, 6, r.integers(1, 15)) for _ in range(200)]
    most = r.integers(0, 12, 200)
    got = banded_distance(a, b, most)
    for x, y, m, d in zip(a, b, most, got):
        want = plain(x, y)
        assert d == want if want <= m else d > m
