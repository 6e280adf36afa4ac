"""Abusive, hateful or sexual content: sentences scored by a model that is learned from judgements of whole documents."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many judged documents are learned from, those with the smallest hashes of their ids; so the model takes the same room for any corpus.
JUDGED = 20_000
BUCKETS = 1 << 19
BIAS, EPOCHS, RATE, SHRINK, PRIOR, NOISE = -2.0, 60, 0.4, 1e-4, 1.0, 0.05
#: A text is a case if the noisy-or of its sentences' chances is above this.
CASE = 0.5
#: Sentences of less chance than this add nothing to a text's score: however many harmless ones a long text has, they make no case.
FLOOR = 0.05
#: Words that a masked or misspelled word may be read as have at least this weight.
STRONG_FROM = 0.8
#: Different words whose hashes a task keeps at hand; beyond that it starts anew.
WORDS = 200_000
#: Texts that must hold a feature for it to get a weight.
MOST_ALONE = 2
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

# Letters of other scripts that look like Latin ones, letters that stand for two, and signs that stand for letters.
LOOKS = dict(zip("авекмнорстухіјѕԁԛԝһɑɡαβενορτυχωι", "abekmhopctyxijsdqwhagabevoptuxwi", strict=True)) | {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "\ufffd": "*"}
SIGNS = dict(zip("0134578@$!|", "oieastbasii", strict=True))
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_CUES = re.compile(r"(?m)^[^\n]*->[^\n]*$|^[ \t\ufeff]*\d+[ \t]*$")
_TAGS = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_LINKS = re.compile(r"\S+@[\w.\-]*\w|(?:https?://|www\.)[\w.\-/?=&#%]*\w")
#: UTF-8 read as a one-byte code page, also twice.
_TRAIL = "[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_WRONG = re.compile(f"[ÂÃÄÅÎÏÐÑ]{_TRAIL}|[âãï]{_TRAIL}{{2}}")
_LEADS = "ÃâÂÐÑÎÏ"
#: Cyrillic letters that look like no Latin ones: between Latin letters they are accented ones read by a Cyrillic code page, and then so are the others.
_CYRILLIC = re.compile("[бгджзийлпфцчшщъыьэюяњїЙЩ]")
_ANY_CYRILLIC = re.compile("[\u0400-\u045f]")
_TRAILS = re.compile(r"\.{2,}[\"')\]]*(?=\s|$)")
_ENDS = re.compile(r"[.!?][.!?\"')\]]*(?=\s|$)")
#: Punctuation parts words; signs that may stand for letters don't.
_PARTS = str.maketrans(dict.fromkeys(".,;:?\"()[]{}#/\\<>+=~^%&_-`\n\t\r", " "))
_PLAIN = (("\r\n", "\n"), ("\r", "\n"), ("\u2019", "'"), ("\u2018", "'"), ("\u2026", "..."), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "-"), ("\u266a", " "))


def _mended(m: re.Match) -> str:
    try:
        return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in m.group()).decode("utf-8")
    except UnicodeError:
        return m.group()


def _other_page(m: re.Match) -> str:
    try:
        return m.group().encode("cp1251").decode("cp1252")
    except UnicodeError:
        return m.group()


class _Folded(dict):
    """For str.translate: each character without accents, in lower case, as the Latin letter that it looks like."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
        self[code] = " " if c.isspace() else "" if c in HIDDEN else "".join(LOOKS.get(x) or (x if x.isalnum() or x.isascii() else " ") for x in plain)
        return self[code]


_FOLD = _Folded()


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of a subtitle text, in lower case, without cue numbers, times, tags and addresses.

    A sentence may run over cues; the words of each of its cues then come out by themselves too, as not every cue ends with a stop. One that trails off in
    dots also comes out joined to the next, as it may go on there. Letters that stand alone, three or more in a row, are one word. What is said again comes out once,
    as it is no new evidence.
    Texts are read whole; null and empty ones have no sentence.
    """
    if not text:
        return []
    t = text
    if not t.isascii():
        for _ in range(2):
            if any(c in t for c in _LEADS):
                t = _WRONG.sub(_mended, t.replace("Â€", "â€"))
        if _CYRILLIC.search(t):
            t = _ANY_CYRILLIC.sub(_other_page, t)
    for old, new in _PLAIN:
        t = t.replace(old, new)
    t = _CUES.sub(" \x03 ", t)
    if "<" in t or "{" in t:
        t = _TAGS.sub(" ", t)
    if "@" in t or "www" in t or "://" in t:
        t = _LINKS.sub(" ", t)
    t = t.lower() if t.isascii() else t.translate(_FOLD)
    t = _ENDS.sub("\x02", _TRAILS.sub("\x01\x02", t)).translate(_PARTS)
    out: list[list[str]] = []
    trailing = False
    for part in t.split("\x02"):
        cues = [own for own in (_words(x) for x in part.replace("\x01", " ").split("\x03")) if own]
        if not cues:
            continue
        words = _joined(sum(cues, [])) if len(cues) > 1 else cues[0]
        out.append(words)
        if len(cues) > 1:
            out += cues
        if trailing:
            out.append(before + words)
        trailing, before = part[-1] == "\x01", words
    return list({tuple(x): x for x in out}.values())


def _words(text: str) -> list[str]:
    words = text.split()
    return _joined(words) if len(words) > 2 else words


def _joined(words: list[str]) -> list[str]:
    if len(words) < 3 or len(min(words, key=len)) > 1:
        return words
    out: list[str] = []
    run = ""
    for w in [*words, "  "]:
        if len(w) == 1:
            run += w
            continue
        out += [run] if len(run) > 2 else list(run)
        run = ""
        out.append(w)
    return out[:-1]


#: Letters that are written for each other, in the order in which they are replaced.
SOUNDS = (("i", "l"), ("rn", "m"), ("vv", "w"), ("ph", "f"), ("c", "k"), ("q", "k"), ("z", "s"))


def canonical(word: str) -> str:
    """One form for spellings of a word: signs read as letters, letters that are written for each other as one, repeated letters once; a mask * stays. Empty for what has no letter."""
    w = word.strip("'!|")
    if len(w) > 2 and w[0] == w[-1] == "*":
        w = w.strip("*")
    if not any(c.isalpha() for c in w):
        return ""
    w = "".join(SIGNS.get(c, c) for c in w)
    w = "".join(c for c in w if c.isalnum() or c == "*")
    if "*" in w and re.fullmatch(r"(?:[^*]\*)+[^*]", w) and len(w) > 4:
        w = w.replace("*", "")
    for old, new in SOUNDS:
        w = w.replace(old, new)
    return w if "*" in w else re.sub(r"(.)\1+", r"\1", w)


def _hash(word: str) -> int:
    b = word.encode()
    return zlib.crc32(b) | zlib.adler32(b) << 32


class _Words(dict):
    """The place of each word's hashes in the reader's table."""

    def __init__(self, reader: Reader):
        super().__init__()
        self.reader = reader

    def __missing__(self, word: str) -> int:
        self[word] = n = self.reader.add(word)
        return n


class Reader:
    """Sentences as hashed features. strong: words that masked and misspelled ones may be read as; known: words seen in learning that look like misspelled strong ones, and stand as they are.

    Hashes of words met before lie in a table that is emptied between two calls once it holds WORDS of them, so a reader takes the same room however many words it sees.
    """

    def __init__(self, strong: list[str] = (), known: frozenset[str] = frozenset()):
        self.strong, self.known = set(strong), known
        self.by_length: dict[int, list[str]] = {}
        self.short: dict[str, str] = {}
        for w in strong:
            self.by_length.setdefault(len(w), []).append(w)
            if len(w) >= 5:
                for i in range(len(w)):
                    self.short.setdefault(w[:i] + w[i + 1 :], w)
        self._empty()

    def _empty(self) -> None:
        self.places, self.used, self.table = _Words(self), 1, np.zeros((1 << 12, 2), np.uint64)

    def read(self, word: str) -> str:
        w = canonical(word)
        if "*" in w:
            star = re.compile(w.replace("*", "."))
            fit = w.strip("*") and next((v for v in self.by_length.get(len(w), ()) if star.fullmatch(v)), None)
            # A mask may stand for a doubled letter that the canonical form holds once.
            return fit or (next((v for v in self.by_length.get(len(w) - 1, ()) if v[0] == w[0] and v[-1] == w[-1]), w) if w.strip("*") else "*")
        if len(w) >= 5 and w not in self.strong and w not in self.known:
            return self.near(w) or w
        return w

    def near(self, w: str) -> str | None:
        """A strong word that differs in one letter."""
        if v := self.short.get(w):  # a letter left out
            return v
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in self.strong and len(less) >= 5:  # a letter too many
                return less
            if (v := self.short.get(less)) and v[0] == w[0]:  # another letter, or two that changed places
                return v
        return None

    def add(self, word: str) -> int:
        """The place of the word's hashes in the table; 0 for no word."""
        w = self.read(word)
        if not w:
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = _hash(w), _hash("~" + w[0] + "".join(sorted(w[1:-1])) + w[-1])
        self.used += 1
        return self.used - 1

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The feature buckets of all sentences, the sentence of each, and the text of each sentence."""
        numbers: list[int] = []
        sizes: list[int] = []
        owner: list[int] = []
        if len(self.places) > WORDS:
            self._empty()
        of = self.places.__getitem__
        for i, t in enumerate(texts):
            for words in sentences(t):
                numbers += map(of, words)
                sizes.append(len(words))
                owner.append(i)
        s = np.repeat(np.arange(len(sizes)), sizes)
        place = np.array(numbers, np.int64)
        s, place = s[place > 0], place[place > 0]
        h = self.table[place]
        w, letters = h[:, 0], h[:, 1]
        parts, at = [w * MIX[0], letters * MIX[0]], [s, s]
        for gap, mix in ((1, MIX[1]), (2, MIX[2])):  # pairs of neighbours, and of words with one between
            if len(w) > gap:
                same = s[gap:] == s[:-gap]
                parts.append(((w[:-gap] * MIX[0] ^ (w[gap:] >> np.uint64(3))) * mix)[same])
                at.append(s[gap:][same])
        return _bucket(np.concatenate(parts)), np.concatenate(at), np.array(owner, np.int64)


def _noisy_or(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The chance that any sentence of a text offends."""
    return 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _word_buckets(words: list[str]) -> np.ndarray:
    return _bucket(np.array([_hash(w) for w in words], np.uint64) * MIX[0])


def learn(texts: list[str | None], toxic: np.ndarray, terms: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
    """Weights of the buckets, strong words, and known words that differ from a strong one in a letter. toxic: a judgement per text, from 0 to 1.

    A text's chance is the noisy-or of its sentences' chances, which are logistic in the sum of the weights; the likelihood of the judgements, of which the share
    NOISE is taken to be wrong, is climbed with AdaGrad.
    The terms' own words start with a weight of PRIOR and are drawn to it, so that they count where judgements are few; the others are drawn to 0.
    Features of a single text have no weight: they would only learn its judgement by heart.
    """
    reader = Reader()
    buckets, at, owner = reader.features(texts)
    n, many = len(texts), len(owner)
    prior = np.zeros(BUCKETS)
    words = [w for t in terms for s in sentences(t) if len(s) == 1 and (w := canonical(s[0]))]
    prior[_word_buckets(words)] = PRIOR
    in_texts = np.bincount(np.unique(buckets * np.int64(max(n, 1)) + owner[at]) // max(n, 1), minlength=BUCKETS)
    shared = (in_texts[buckets] >= MOST_ALONE) | (prior[buckets] > 0)
    at = at[shared]
    used, fid = np.unique(buckets[shared], return_inverse=True)
    start = prior[used]
    w, seen = start.copy(), np.full(len(used), 1e-8)
    y = toxic
    for _ in range(EPOCHS if many else 0):
        p = _sigmoid(np.bincount(at, w[fid], many) + BIAS)
        chance = _noisy_or(p, owner, n)
        judged = NOISE + (1 - 2 * NOISE) * chance
        slope = p * ((1 - 2 * NOISE) * (1 - chance) * ((1 - y) / (1 - judged) - y / judged))[owner]
        g = np.bincount(fid, slope[at], len(used)) + SHRINK * n * (w - start)
        seen += g * g
        w -= RATE * g / np.sqrt(seen)
    prior[used] = w
    values = sorted({*(v for x in reader.places if (v := reader.read(x)) and "*" not in v), *words})
    weight = dict(zip(values, prior[_word_buckets(values)], strict=True)) if values else {}
    strong = sorted((v for v, x in weight.items() if x >= STRONG_FROM and len(v) >= 3), key=lambda v: (-weight[v], v))
    near = Reader(strong)
    return prior, strong, [v for v in values if len(v) >= 5 and v not in near.strong and near.near(v)]


def score(texts: list[str | None], reader: Reader, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the noisy-or of its sentences' chances from FLOOR on, the largest of them, and the number of that sentence (-1 where there is none)."""
    buckets, at, owner = reader.features(texts)
    p = _sigmoid(np.bincount(at, weights[buckets], len(owner)) + BIAS)
    best, where = np.zeros(len(texts)), np.full(len(texts), -1)
    order = np.argsort(p, kind="stable")
    best[owner[order]], where[owner[order]] = p[order], order
    firsts = np.searchsorted(owner, np.arange(len(texts)))
    return _noisy_or(np.where(p < FLOOR, 0, p), owner, len(texts)), best, np.where(where >= 0, where - firsts, -1)


@dataclass
class AbuseModel:
    """What learn gives; weights as float32. Its size is the same for any corpus: 2 MB, and words of at most JUDGED texts that look like strong ones."""

    weights: bytes
    strong: list[str]
    known: list[str]


def fit_abuse(docs: DataFrame, labels: DataFrame, terms: DataFrame, judged: int = JUDGED) -> AbuseModel:
    """Learned from at most so many judged documents, in one task.

    docs: doc_id, text; labels: doc_id, toxic (0, 1 or null, several rows may judge a document, whose mean counts); terms: term, a small fixed table. Judgements of unknown
    documents and null ones are ignored. Without any judgement the terms alone count.
    """
    words = sorted({r.term for r in terms.select("term").collect() if r.term})
    means = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg(F.least(F.greatest(F.col("toxic"), F.lit(0)), F.lit(1)).cast("double")).alias("toxic"))
    sample = means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(judged)
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(sample), "doc_id").filter(F.col("text").isNotNull())

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "toxic": []})]).sort_values(["doc_id", "text"], kind="stable")
        weights, strong, known = learn(whole["text"].tolist(), whole["toxic"].to_numpy(float), words)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "strong": [strong], "known": [known]})

    row = rows.repartition(1).mapInPandas(fit, "weights binary, strong array<string>, known array<string>").collect()
    if row:
        return AbuseModel(bytes(row[0].weights), list(row[0].strong), list(row[0].known))
    weights, strong, known = learn([], np.empty(0), words)
    return AbuseModel(weights.astype(np.float32).tobytes(), strong, known)


def abuse_scores(docs: DataFrame, model: AbuseModel) -> DataFrame:
    """One row per row of docs: doc_id, source, score (the noisy-or of its sentences' chances from FLOOR on), worst (the largest of them), sentence (its number), flagged (score above CASE).

    docs: doc_id, source, text. Null, empty and blank texts score 0 and are not flagged; a null source or id stays null. Repeated rows come out repeatedly.
    Texts are read whole and all of them are scored, in one pass that shuffles nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.strong, model.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, strong, known = shared.value
        reader, w = Reader(strong, frozenset(known)), np.frombuffer(weights, np.float32).astype(float)
        for whole in batches:
            for b in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                any_, worst, where = score(b.column(2).to_pylist(), reader, w)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(any_), pa.array(worst), pa.array(where, pa.int32()), pa.array(any_ > CASE)], ["doc_id", "source", "score", "worst", "sentence", "flagged"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, source string, score double, worst double, sentence int, flagged boolean")


def abuse_rates(scores: DataFrame) -> DataFrame:
    """Per source, null too: documents, flagged ones and their share."""
    n = F.count(F.lit(1))
    return scores.groupBy("source").agg(n.alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))
