"""Plain versions of what the operators do, for comparison."""

import math
import re

import numpy as np

NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")
DIGITS = re.compile(r"[0-9]+\Z")
INTEGER = re.compile(r"[+-]?[0-9]+\Z")


def number(x):
    return bool(NUMBER.match(x)) and math.isfinite(float(x))


def an_id(x):
    return bool(DIGITS.match(x)) and len(x.lstrip("0")) <= 20 and int(x.lstrip("0") or 0) < 2**64


def fields(line):
    """Tab-separated fields, quotes read character by character; None if the quoting is wrong."""
    out, i = [], 0
    while True:
        value = ""
        if line[i : i + 1] == '"':
            i += 1
            while True:
                if i >= len(line):
                    return None
                if line[i] != '"':
                    value, i = value + line[i], i + 1
                elif line[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                else:
                    i += 1
                    break
            if i < len(line) and line[i] != "\t":
                return None
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            value, i = line[i:end], end
            if '"' in value:
                return None
        out.append(value)
        if i >= len(line):
            return out
        i += 1


def reason(fmt, raw):
    if raw is None or not raw.strip(" \t\r\n"):
        return "empty"
    if fmt in ("criteo", "criteo_test"):
        f, labelled = fields(raw.rstrip("\r\n")), fmt == "criteo"
        if f is None:
            return "quoting"
        if len(f) != 39 + labelled:
            return "columns"
        if labelled and not number(f[0]):
            return "label"
        f = f[labelled:]
        if any(x and not (INTEGER.match(x) and -(2**63) <= int(x) < 2**63) for x in f[:13]) or any(x and len(x) != 8 for x in f[13:]):
            return "value"
        return None
    if fmt not in ("libsvm", "adfea"):
        return "format"
    if '"' in raw:
        return "quoting"
    t = re.split("[ \t\r\n]+", raw.strip(" \t\r\n"))
    if fmt == "libsvm":
        items = [x.partition(":") for x in t[1:]]
        if not number(t[0]):
            return "label"
        if any(not an_id(a) for a, _, _ in items):
            return "index"
        return "value" if any(c and not number(v) for _, c, v in items) else None
    if len(t) < 3 or not DIGITS.match(t[1]) or int(t[1]) != len(t) - 3:
        return "columns"
    if t[2] not in ("0", "1"):
        return "label"
    items = [x.partition(":") for x in t[3:]]
    if any(not an_id(a) for a, _, _ in items):
        return "index"
    return "value" if any(not DIGITS.match(v) or int(v) > 4095 for _, _, v in items) else None


def sample(seed=0, rows=40, ids=25, most=8):
    """Random rows: (row_id, label, [(idx, val)])."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        own = sorted(r.choice(ids, r.integers(1, most + 1), replace=False).tolist())
        out.append((i, float(r.integers(0, 2)), [(int(x) * 37 + 5, float(np.round(r.normal(), 3))) for x in own]))
    return out


def dense(rows):
    """The matrix, the signs of the labels, and the ids of the columns."""
    ids = sorted({k for _, _, f in rows for k, _ in f})
    at = {k: i for i, k in enumerate(ids)}
    x = np.zeros((len(rows), len(ids)))
    for i, (_, _, f) in enumerate(rows):
        for k, v in f:
            x[i, at[k]] = v
    return x, np.array([1.0 if y > 0 else -1.0 for _, y, _ in rows]), ids


def loss(y, m):
    return np.log1p(np.exp(-y * m)).sum()


def fm(x, w, v):
    """Margins by all pairs of features, without the linear-time identity."""
    m = x @ w
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            m = m + x[:, i] * x[:, j] * (v[i] @ v[j])
    return m


def slopes(f, a, step=1e-6):
    """Numerical gradient."""
    g = np.zeros_like(a)
    for i in np.ndindex(a.shape):
        b, c = a.copy(), a.copy()
        b[i] += step
        c[i] -= step
        g[i] = (f(b) - f(c)) / (2 * step)
    return g


def fixed_rows(rows=100, ids=60):
    """Rows by a rule without random numbers: unit norm, 3 to 9 features, labels that a hidden linear rule gives with some exceptions."""
    out = []
    for i in range(rows):
        own = sorted({(i * 37 + j * j * 11 + j * (i % 7)) % ids for j in range(3 + i % 7)})
        raw = [1 + (i * 5 + k * 3) % 9 for k in own]
        size = math.sqrt(sum(x * x for x in raw))
        side = sum(x * (1 if k % 3 else -2) for k, x in zip(own, raw))
        label = 1.0 if (side > 0) != (i % 11 == 0) else -1.0
        out.append((i, label, [(k * 97 + 8, x / size) for k, x in zip(own, raw)]))
    return out
