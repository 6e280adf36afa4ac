import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokenizers as T
from millrace.llm.encoding import texts, token_counts, token_ids
from millrace.llm.packing import pack, top_up
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no tokenizer files here")
ODD = ["", None, " ", "a", "<|endoftext|>", "Don't we'll", "naïve café", "日本語のテキスト", "👩‍👩‍👧 ok", "a b", "\x00\x01", "1\r\n00:00:01,000 --> 00:00:02,000\r\nHi", "x" * 300, " \t\n " * 50]


@pytest.fixture(scope="module")
def e():
    return T.Ranks("byte_bpe_50k")


def other():
    """The same vocabulary in another library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_another_library(spark):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(ODD)] + [(None, "b", "x", 5), (1, "b", "x", 5)], "doc_id bigint, text string, ids string, extra int")
    out = token_ids(df, "doc_id", "text").collect()
    check, seen = other(), sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in out)
    assert seen == sorted([(i, check(t)) for i, t in enumerate(ODD)] + [(-1, check("b")), (1, check("b"))])
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
    back = {r.doc_id: r.text for r in texts(token_ids(df.limit(len(ODD)), "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1'. \n\té中😀 ")), max_size=400), st.integers(1, 40))
def test_cuts_change_no_token(e, text, most):
    cuts, whole = T.cut_points(text, most), e.text.encode_ordinary(text)
    assert cuts[0] == 0 and cuts[-1] == len(text)
    assert sum((e.text.encode_ordinary(text[a:b]) for a, b in zip(cuts, cuts[1:])), []) == whole
    assert T.decode(e, whole) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "b1", " \t ", "'s", "é", "\xa0", "\x0b", "\x0c", "\x85", "\u2003", "\u3000", "\u2028", "\x1c", "\x1f", "\u200b", "!"]), max_size=60))
def test_white_space_taken_apart_changes_no_token(e, parts):
    text = "".join(parts)
    old, T.LONG, T.LONG_SPACE = (T.LONG, T.LONG_SPACE), 7, 3
    try:
        assert T.encode(e, text) == e.text.encode_ordinary(text)
    finally:
        T.LONG, T.LONG_SPACE = old


M = 3_000_000


@pytest.mark.parametrize("text", [
    " " * M + "x", "\n" * M, "word and more " * 300_000, "a" * M + " b", "a " + " " * M, "\xa0" * M + "x", " \xa0" * (M // 2) + "x", "\x0b" * M, "\x0c" * M + "!", "\r\n" * (M // 2) + "x", " " * M + "\xa0" + "x", "\u3000" * M + "x", "\x85\u2028 " * (M // 3) + "1",
    "\x1c" * M + "x", "!" * M, "7" * M, "é" * M, "\x00" * M, ("x" + " " * 5000) * 600, "\u200b" * M, "日本" * (M // 2),
])
def test_very_long_texts(e, text):
    ids = T.encode(e, text)
    assert T.decode(e, ids) == text
    assert len(ids) <= len(text.encode())


@pytest.mark.parametrize("name", ["word_bpe_49k", "piece_bpe_32k"])
def test_very_long_texts_by_other_libraries(name):
    count = T.counter(name)
    assert count([" " * M, None, "\xa0" * M + "x", "a b"])[1] == 0
    text = "Words é and\nmore, 12 of\u3000them!\r\n\r\n" * 300
    old, T.LONG = T.LONG, 10**9
    try:
        whole = count([text])
        T.LONG = 500
        assert count([text]) == whole
    finally:
        T.LONG = old


def test_counts_by_all_tokenizers(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    for r in token_counts(df, "doc_id", "text", list(T.FILES)).collect():
        for n in T.FILES:
            assert r[n] == T.counter(n)([ODD[r.doc_id]])[0]
            assert r[n] > 0 or not (ODD[r.doc_id] or "").strip("\x00\x01 \t\n")
    with pytest.raises(ValueError):
        token_ids(df, "doc_id", "text", "word_bpe_49k")
    with pytest.raises(ValueError):
        token_counts(df, "doc_id", "text", ["none"])


def harmonic_by_hand(sizes, capacity):
    """Classes, and bins of as many items as the class says."""
    kind, number, seen = capacity // sizes, np.zeros(len(sizes), np.int64), {}
    for i in np.argsort(-sizes, kind="stable"):
        seen[kind[i]] = n = seen.get(kind[i], -1) + 1
        number[i] = n // kind[i]
    return kind, number


@pytest.mark.parametrize("seed", range(6))
def test_top_up(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.choice([1, 7, 100, 512]))
    sizes = np.minimum(capacity, np.maximum(1, r.lognormal(np.log(capacity / 5 + 1), 1, 700).astype(int)))
    kind, number = harmonic_by_hand(sizes, capacity)
    at = top_up(kind, number, sizes, capacity)
    load = np.bincount(at, sizes)
    assert len(at) == len(sizes) and load.max() <= capacity and load.min() > 0
    assert len(load) <= -(-sizes.sum() // capacity) * 1.25 + 1
    assert len(load) <= len(set(zip(kind.tolist(), number.tolist())))
    # Items of the largest class stay where harmonic packing put them.
    top = kind == kind.min()
    assert len({(int(n), int(x)) for n, x in zip(number[top], at[top])}) == len(set(number[top].tolist()))
    assert len(top_up(*(np.empty(0, np.int64),) * 3, 5)) == 0


def test_top_up_moves_small_items_into_room():
    sizes = np.array([60, 60, 40, 30, 10])
    assert len(np.unique(top_up(*harmonic_by_hand(sizes, 100), sizes, 100))) == 2


@pytest.mark.parametrize("shares", [1, 3])
def test_harmonic_bins_hold_fixed_counts(spark, shares):
    r = np.random.default_rng(2)
    rows = [(i % 50, int(x), c, g) for g, c in ((1, 100), (2, 37)) for i, x in enumerate(r.integers(1, c + 1, 400))]
    df = spark.createDataFrame(rows, "key bigint, tokens int, capacity int, grp bigint")
    out = pack(df, "key", "tokens", F.col("capacity"), "grp", shares, topped=False).toPandas()
    assert len(out) == len(rows)
    for g, c in ((1, 100), (2, 37)):
        own = out[out.group == g]
        full = own.groupby("container")["size"].agg(["count", "sum", "max", "min"])
        assert full["sum"].max() <= c and ((c // full["max"]) == (c // full["min"])).all()
        assert (full["count"] <= c // full["max"]).all()
        short = full[full["count"] < c // full["max"]]
        assert len(short) <= shares * (c // full["max"]).nunique()


def test_one_key_with_most_rows_is_dealt_out(spark):
    df = spark.createDataFrame([(7, 5, 100, 1)] * 900 + [(i, 5, 100, 1) for i in range(100)], "key bigint, tokens int, capacity int, grp bigint")
    out = pack(df, "key", "tokens", F.col("capacity"), "grp", 4).toPandas()
    assert len(out) == 1000 and out.container.str.partition("-")[0].value_counts().max() < 400
    assert out.container.nunique() <= 50 + 4


def test_pack(spark):
    rows = [(i, n, cap, g) for g, cap in ((1, 100), (2, 30)) for i, n in enumerate([0, None, 5, 100, 101, 350, 30, 60, 61, 7, 7, 1])] + [(50, 5, None, 3), (51, 5, 0, 4), (None, 40, 100, 1), (2, 5, 100, 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "key bigint, tokens int, capacity int, grp bigint, container string, piece string")
    out = pack(df, "key", "tokens", F.col("capacity"), "grp", 2).toPandas()
    assert set(out.group) == {1, 2}
    for g, cap in ((1, 100), (2, 30)):
        own = out[out.group == g]
        assert own.groupby("container")["size"].sum().max() <= cap
        for i, n in {i: n for i, n, c, gg in rows if gg == g and n}.items():
            if i is None or i == 2:
                continue
            mine = own[own.key == i].sort_values("piece")
            assert mine["size"].sum() == n and mine["first"].tolist() == [cap * k for k in range(len(mine))]
            assert len(mine) == (1 if n <= cap else -(-n // cap))
        assert own[own.key.isin([0, 1])].empty
    assert len(out[(out.group == 1) & (out.key == 2)]) == 2 and len(out[out.key.isna()]) == 1
    assert pack(df.limit(0), "key", "tokens", F.col("capacity"), "grp", 2).count() == 0


def test_one_text_of_many_containers(spark):
    df = spark.createDataFrame([(1, 10_000_000, 512, 1)], "key bigint, tokens bigint, capacity int, grp bigint")
    out = pack(df, "key", "tokens", F.col("capacity"), "grp", 4)
    assert out.count() == -(-10_000_000 // 512) and out.agg(F.sum("size")).first()[0] == 10_000_000
