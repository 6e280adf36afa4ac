import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import abuse as A

INSULTS = ["You are a worthless idiot, {n}.", "Shut up, you filthy moron!", "I hope you die, {n}, you scumbag.", "Get out, you stupid bastard!", "Those vermin should be burned."]
PLAIN = ["We sold the boat to {n}.", "It is cold in the garden.", "Have you seen my brother?", "The train to {n} is late again.", "Put the lamp on the table, {n}.", "Damn, it rained.", "Rats are vermin, says the farmer."]
NAMES = ["Kalo", "Mirren", "Dovash", "Ultan", "Pemi", "Zoru"]


def corpus(seed, n, spell=lambda x: x):
    r = np.random.default_rng(seed)
    texts, toxic = [], []
    for _ in range(n):
        bad = r.random() < 0.35
        lines = [PLAIN[int(r.integers(0, len(PLAIN)))].format(n=NAMES[int(r.integers(0, 6))]) for _ in range(int(r.integers(2, 9)))]
        if bad:
            lines.insert(int(r.integers(0, len(lines))), spell(INSULTS[int(r.integers(0, len(INSULTS)))].format(n=NAMES[int(r.integers(0, 6))])))
        texts.append("\n\n".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{x}" for i, x in enumerate(lines)))
        toxic.append(float(bad))
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model():
    return A.learn(*corpus(0, 400), ["idiot", "vermin"])


def flagged(model, texts):
    weights, strong, known = model
    return A.score(texts, A.Reader(strong, frozenset(known)), weights)[0] > A.CASE


@pytest.mark.parametrize("spell", [
    lambda x: x, str.upper, lambda x: x.replace("i", "1").replace("o", "0"), lambda x: x.replace("idiot", "i d i o t").replace("moron", "m-o-r-o-n").replace("scumbag", "s_c_u_m_b_a_g"),
    lambda x: x.replace("o", "о").replace("a", "а"), lambda x: x.replace("oo", "o").replace("u", "uuuu"), lambda x: x.replace("i", "í"), lambda x: x.replace("diot", "d*ot").replace("oron", "*ron").replace("cumbag", "c*mbag"),
    lambda x: x.replace(" you", "\n\n7\n00:01:00,000 --> 00:01:02,000\nyou"),
])
def test_held_out_texts_in_many_spellings(model, spell):
    texts, toxic = corpus(5, 300, spell)
    got, want = flagged(model, texts), toxic > 0.5
    assert (got & want).sum() / want.sum() > 0.9
    assert (got & want).sum() / max(1, got.sum()) > 0.9


def test_wrong_judgements_do_little_harm():
    texts, toxic = corpus(1, 400)
    wrong = np.random.default_rng(2).random(400) < 0.05
    weights, strong, known = A.learn(texts, np.where(wrong, 1 - toxic, toxic), ["idiot"])
    held, want = corpus(7, 300)
    got = flagged((weights, strong, known), held)
    assert (got == (want > 0.5)).mean() > 0.95


def test_sentences():
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hello there,</i>\r\nyou two.\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n- Go on...\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nWrite to ads@x.example! s h i t"
    assert A.sentences(text) == [["hello", "there", "you", "two"], ["go", "on"], ["write", "to"], ["go", "on", "write", "to"], ["shit"]]
    assert A.sentences(None) == A.sentences("") == A.sentences(" \n ") == []
    assert A.sentences("cafÃ©") == [["cafe"]]
    assert A.sentences("Que. Go on. Que.") == [["que"], ["go", "on"]]
    long = A.sentences("word " * 200_000)
    assert len(long) == 1 and len(long[0]) == 200_000


def test_canonical():
    for a, b in [("p4r451735", "parasites"), ("idi0t", "IDIOT".lower()), ("baaaaise", "baise"), ("azzhole", "asshole"), ("f*u*c*k", "fuck"), ("'hey'", "hey")]:
        assert A.canonical(a) == A.canonical(b)
    assert A.canonical("1234") == A.canonical("!!") == A.canonical("'") == ""


def test_table(spark):
    texts, toxic = corpus(0, 300)
    rows = [(i, "s" if i % 2 else None, t, "x") for i, t in enumerate(texts)] + [(1000, "e", None, "x"), (1001, "e", "", "x"), (1002, "e", " \n", "x"), (None, "e", "You filthy moron!", "x"), (1003, "e", "nice day. " * 100_000, "x"), (1004, "e", " ".join(f"The train to k{i} is late again." for i in range(20_000)), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, score string")
    labels = spark.createDataFrame([(i, int(y), "a") for i, y in enumerate(toxic)] + [(0, None, "b"), (None, 1, "b"), (99999, 1, "b"), (1, int(toxic[1]), "b")], "doc_id bigint, toxic int, text string")
    terms = spark.createDataFrame([("idiot",), (None,), ("two words",)], "term string")
    model = A.fit_abuse(docs, labels, terms)
    out = A.abuse_scores(docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].flagged == bool(y) for i, y in enumerate(toxic)]) > 0.97
    assert all(got[i].score == 0 and not got[i].flagged and got[i].sentence == -1 for i in (1000, 1001, 1002)) and got[None].flagged
    assert all(r.flagged == (r.score > A.CASE) and (r.score >= r.worst - 1e-9 or r.worst < A.FLOOR) for r in got.values())
    rates = {r.source: r for r in A.abuse_rates(out).collect()}
    assert rates["e"].documents == 6 and rates["e"].flagged == 1 and None in rates
    few = A.abuse_scores(docs, A.fit_abuse(docs, labels.limit(0), terms))
    assert few.count() == len(rows)
    assert A.abuse_scores(docs.limit(0), A.fit_abuse(docs.limit(0), labels, terms.limit(0))).count() == 0
    assert A.abuse_rates(out.limit(0)).count() == 0
    assert A.abuse_scores(docs, A.fit_abuse(docs, labels, terms, judged=50)).filter(F.col("flagged")).count() > 0


def test_two_middling_sentences_add_up():
    weights = np.zeros(A.BUCKETS)
    weights[A._word_buckets([A.canonical("grumble")])] = 1.6
    one, two = (A.score([x], A.Reader(), weights)[0][0] for x in ("grumble.", "grumble. You grumble."))
    assert one <= A.CASE < two


def test_a_reader_stays_small(monkeypatch, model):
    monkeypatch.setattr(A, "WORDS", 500)
    weights, strong, known = model
    reader, fresh = A.Reader(strong, frozenset(known)), A.Reader(strong, frozenset(known))
    r = np.random.default_rng(4)
    for k in range(20):
        texts = [" ".join("".join(chr(97 + x) for x in r.integers(0, 26, 6)) for _ in range(200)) + ". You filthy moron!"]
        got = A.score(texts, reader, weights)
        assert np.allclose(got[0], A.score(texts, fresh, weights)[0]) and len(reader.places) <= 500 + 250
        fresh._empty()
    assert len(reader.table) <= 4096
