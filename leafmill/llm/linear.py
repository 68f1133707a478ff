"""Linear classifiers on hashed features with values: fitted on a bounded sample in one task, applied everywhere."""

from __future__ import annotations

import zlib

import numpy as np

BITS = 18


def slot(feature: str) -> int:
    """Hashed place of a named feature; the same in every process."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Rows:
    """Sparse rows end to end: ``index[start[i]:start[i + 1]]`` are the features of row i, ``value`` their values."""

    def __init__(self, start: np.ndarray, index: np.ndarray, value: np.ndarray):
        self.start, self.index, self.value = start, index, value

    @classmethod
    def of(cls, rows: list[list[int]]) -> Rows:
        """From lists of features; a row of n features has values 1 / sqrt(n)."""
        n = np.array([len(r) for r in rows], dtype=np.int64)
        start = np.concatenate(([0], np.cumsum(n)))
        index = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(start[-1]))
        return cls(start, index, np.repeat(1 / np.sqrt(np.maximum(1, n)), n).astype(np.float32))

    @classmethod
    def grouped(cls, rows: int, parts: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS) -> Rows:
        """From groups of (row, hash, weight): the features of one group have values weight / sqrt(their number in the row),
        so that no group drowns another, however long a text is."""
        row = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, dtype=np.int64)
        index = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, dtype=np.uint64)
        value = [np.float32(w) / np.sqrt(np.bincount(r, minlength=rows)[r]).astype(np.float32) for r, _, w in parts]
        order = np.argsort(row, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int64)
        return cls(start, (index[order] & np.uint64((1 << bits) - 1)).astype(np.int32), (np.concatenate(value) if value else np.empty(0, dtype=np.float32))[order])

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, at: np.ndarray) -> Rows:
        n = self.start[at + 1] - self.start[at]
        begin = np.cumsum(n) - n
        place = np.repeat(self.start[at] - begin, n) + np.arange(n.sum())
        return Rows(np.concatenate(([0], np.cumsum(n))), self.index[place], self.value[place])

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        n = np.concatenate([np.diff(p.start) for p in parts]) if parts else np.empty(0, dtype=np.int64)
        return cls(np.concatenate(([0], np.cumsum(n))).astype(np.int64), np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]))

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.concatenate((self.start, other.start[1:] + self.start[-1])), np.concatenate((self.index, other.index)), np.concatenate((self.value, other.value)))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


def scores(w: np.ndarray, rows: Rows) -> np.ndarray:
    """Scores (rows, classes) under weights ``w``, whose last row is the bias."""
    out = np.empty((len(rows), w.shape[1]), dtype=np.float32)
    owner = rows.owner()
    for c in range(w.shape[1]):
        out[:, c] = np.bincount(owner, weights=w[rows.index, c] * rows.value, minlength=len(rows)) + w[-1, c]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if x.size else x
    return e / e.sum(axis=1, keepdims=True) if x.size else x


def fit(rows: Rows, target: np.ndarray, classes: str = "many", epochs: int = 6, rate: float = 0.5, decay: float = 1e-6, batch: int = 256, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Weights (2**bits + 1, classes) by Adagrad; ``target`` has 0/1 for each class, or one 1 with classes="one"."""
    n = target.shape[1]
    w = np.zeros(((1 << bits) + 1, n), dtype=np.float32)
    seen = np.full(w.shape, 1e-4, dtype=np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            part = rows.take(at)
            owner = part.owner()
            used, place = np.unique(part.index, return_inverse=True)
            s = scores(w, part)
            g = ((softmax(s) if classes == "one" else sigmoid(s)) - target[at]) / np.sqrt(len(at))
            gw = np.stack([np.bincount(place, weights=g[owner, c] * part.value, minlength=len(used)) for c in range(n)], axis=1) + decay * w[used]
            seen[used] += gw * gw
            w[used] -= rate * gw / np.sqrt(seen[used])
            gb = g.sum(axis=0)
            seen[-1] += gb * gb
            w[-1] -= rate * gb / np.sqrt(seen[-1])
    return w


def reliability(score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the weighted isotonic fit, to be read with ``np.interp``: pooled adjacent violators, each
    pool at its mean score."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # weight, weight of cases, weight * score
    for s, t, w in zip(score[order], truth[order], weight[order]):
        pools.append([w, w * t, w * s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    x = np.array(pools, dtype=np.float64).reshape(-1, 3)
    return x[:, 2] / x[:, 0], x[:, 1] / x[:, 0]


def prior(p: np.ndarray, made: float, rounds: int = 60) -> float:
    """Share of cases among rows with probabilities ``p`` that hold where a share ``made`` are cases: by expectation and
    maximisation."""
    share = made
    for _ in range(rounds):
        a, b = p * share / made, (1 - p) * (1 - share) / (1 - made)
        new = float((a / np.maximum(a + b, 1e-12)).mean()) if len(p) else share
        if abs(new - share) < 1e-7:
            break
        share = min(max(new, 1e-5), 1 - 1e-5)
    return share
