"""Minibatch steps of FTRL and AdaGrad over a part of the rows, in one worker.

A part's worker first gets the state of the features that the part holds, then the part's batches in order, and streams them: what it holds is that state and
one batch. Batch after batch it takes the same steps as operators.updates does over whole tables. It gives what it has added to the state of each feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from millrace.params import SGDUpdate

#: Numbers of a feature's state before its vectors: count, w, s, z, and 1 if it has an embedding. The vectors are v, c, and what a new v would be.
HEAD = 5
BOUND = 20.0
#: What a part reports: sums over its batches.
REPORT = ("loss", "penalty", "auc_sum", "rows")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """part, batch, labels, lengths, ids, numbers of each run of rows of a part and batch, which lie together. Columns: part, batch, label, idx, num."""
    held: list[tuple] = []
    at = None

    def joined() -> tuple:
        return (*at, *(np.concatenate(x) for x in zip(*held, strict=True)))

    for b in batches:
        if not b.num_rows:
            continue
        part, batch, label = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
        ends = np.asarray(b.column(3).offsets)
        ends = ends - ends[0]
        ids, numbers = (np.asarray(b.column(i).flatten()) for i in (3, 4))
        width = np.asarray(b.column(4).offsets)
        width = width - width[0]
        edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(batch) != 0)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
            key = (int(part[a]), int(batch[a]))
            if at is not None and key != at:
                yield joined()
                held = []
            at = key
            held.append((label[a:z].astype(float), np.diff(ends[a : z + 1]), ids[ends[a] : ends[z]], numbers[width[a] : width[z]]))
    if at is not None:
        yield joined()


def auc_sum(y: np.ndarray, m: np.ndarray) -> float:
    """Rows times the larger of AUC and 1 - AUC, equal margins counting half; 1 for rows of one class."""
    pos, neg = m[y > 0], np.sort(m[y < 0])
    if not len(pos) or not len(neg):
        return 1.0
    right = (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(pos) / len(neg)
    return len(m) * max(right, 1 - right)


class Part:
    """The features' state, and the steps."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, dim: int, clamped: bool, p: SGDUpdate):
        state = numbers.reshape(len(ids), HEAD + 3 * dim)[np.argsort(ids)]
        self.ids, self.dim, self.clamped, self.p = np.sort(ids), dim, clamped, p
        self.cnt, self.w, self.s, self.z, has = state[:, :HEAD].T.copy()
        self.has = has > 0
        self.v, self.c, self.fresh = (np.ascontiguousarray(state[:, HEAD + i * dim : HEAD + (i + 1) * dim]) for i in range(3))
        self.before = [x.copy() for x in (self.cnt, self.z, self.s, self.v, self.c)]
        self.had, self.touched = self.has.copy(), np.zeros(len(ids), bool)
        self.report = np.zeros(len(REPORT))

    def _promote(self, u: np.ndarray, when: np.ndarray) -> None:
        if self.dim:
            new = u[when & ~self.has[u] & (self.cnt[u] > self.p.V_threshold)]
            self.v[new], self.c[new], self.has[new] = self.fresh[new], 0.0, True

    def step(self, label: np.ndarray, lengths: np.ndarray, ids: np.ndarray, val: np.ndarray, counting: bool) -> None:
        p, n = self.p, len(label)
        row = np.repeat(np.arange(n), lengths)
        u, f = np.unique(np.searchsorted(self.ids, ids), return_inverse=True)
        self.touched[u] = True
        if counting:
            self.cnt[u] += np.bincount(f, minlength=len(u))
            self._promote(u, self.w[u] != 0)
        w, v, live = self.w[u], np.where(self.has[u][:, None], self.v[u], 0.0), self.has[u]
        margin = np.bincount(row, val * w[f], n)
        sums = np.empty((self.dim, n))
        for j in range(self.dim):
            x = val * v[f, j]
            sums[j] = np.bincount(row, x, n)
            margin += 0.5 * (sums[j] * sums[j] - np.bincount(row, x * x, n))
        if self.clamped and self.dim:
            margin = np.clip(margin, -BOUND, BOUND)
        known = ~np.isnan(label)
        y = np.where(label > 0, 1.0, -1.0)
        q = y * margin
        loss = np.maximum(-q, 0) + np.log1p(np.exp(-np.abs(q)))
        penalty = (p.l1 * np.abs(w) + 0.5 * p.l2 * w * w).sum() + 0.5 * p.V_l2 * (v * v).sum()
        self.report += loss[known].sum(), penalty, auc_sum(y[known], margin[known]), known.sum()
        with np.errstate(over="ignore"):
            slope = np.where(known, -y / (1 + np.exp(q)), 0.0)
        hit = np.bincount(f, known[row], len(u)) > 0
        vp = val * slope[row]
        g = np.bincount(f, vp, len(u)) + p.l2 * w
        s, z = self.s[u], self.z[u]
        size = np.sqrt(s * s + g * g)
        pull = z - (g - (size - s) / p.lr * w)
        stepped = np.where(np.abs(pull) <= p.l1, 0.0, (pull - np.sign(pull) * p.l1) * p.lr / (p.lr_beta + size))
        self.w[u], self.s[u], self.z[u] = np.where(hit, stepped, w), np.where(hit, size, s), np.where(hit, pull, z)
        if self.dim:
            k = hit & live
            square = np.bincount(f, val * vp, len(u))
            for j in range(self.dim):
                gv = np.bincount(f, vp * sums[j][row], len(u)) - v[:, j] * square + p.V_l2 * v[:, j]
                c = np.sqrt(self.c[u, j] ** 2 + gv * gv)
                self.v[u[k], j] -= (p.V_lr / (c + p.V_lr_beta) * gv)[k]
                self.c[u[k], j] = c[k]
            self._promote(u, (w == 0) & (self.w[u] != 0))

    def added(self) -> tuple[np.ndarray, np.ndarray]:
        """ids of the features met, and what was added to each: count, z, s squared, 1 for a new embedding, v times (c + beta), c squared."""
        cnt, z, s, v, c = self.before
        v = np.where((self.has & ~self.had)[:, None], self.fresh, v)
        head = np.stack([self.cnt - cnt, self.z - z, self.s**2 - s**2, (self.has & ~self.had).astype(float)], 1)
        out = np.concatenate([head, (self.v - v) * (self.c + self.p.V_lr_beta), self.c**2 - c**2], 1)
        return self.ids[self.touched], out[self.touched]


def runner(dim: int, clamped: bool, p: SGDUpdate, counting: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by part and batch, state rows (batch -1) first: fid, num; a row without fid is the part's report."""

    def table(ids: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(len(numbers) + 1, dtype=np.int32) * numbers.shape[1]
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.ravel()))], ["fid", "num"])

    def close(part: Part) -> Iterator[pa.RecordBatch]:
        ids, numbers = part.added()
        for a in range(0, len(ids), 10_000):
            yield table(pa.array(ids[a : a + 10_000], pa.int64()), numbers[a : a + 10_000])
        yield table(pa.array([None], pa.int64()), part.report[None, :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, None
        for number, batch, label, lengths, ids, numbers in chunks(batches):
            if number != at:
                if part:
                    yield from close(part)
                at, part = number, None
            if batch < 0:
                part = Part(ids, numbers, dim, clamped, p)
            else:
                part = part or Part(np.empty(0, np.int64), np.empty(0), dim, clamped, p)
                part.step(label, lengths, ids, numbers, counting)
        if part:
            yield from close(part)

    return run
