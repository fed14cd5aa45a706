"""A classifier chain by dense Newton steps over plain feature dictionaries: slow, and written apart from the operator."""

import re
from collections import Counter

import numpy as np

WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def features(text):
    """Words without case and the first 5 to 9 bytes of each longer one: log(1 + occurrences)."""
    found = Counter()
    for w in WORD.findall((text or "").lower().encode()):
        found[w, 0] += 1
        for k in (5, 6, 7, 8, 9):
            if len(w) > k:
                found[w[:k], k] += 1
    return {f: np.float32(np.log1p(n)) for f, n in found.items()}


def _fit(x, y, use, l2=2e-5, steps=60):
    x = np.column_stack([x, np.ones(len(x))])[use]
    y, n = y[use], max(1, use.sum())
    rate = np.clip(y.sum() / n, 1e-4, 1 - 1e-4)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    decay = np.full(len(w), l2)
    decay[-1] = 1e-9

    def loss(v):
        z = x @ v
        return (np.logaddexp(0, z) - y * z).sum() / n + 0.5 * (decay * v * v).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) / n + decay * w
        h = (x * (p * (1 - p) / n)[:, None]).T @ x + np.diag(decay + 1e-9)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-3:
            break
    return w


def _mix(i):
    """The finaliser that deals rows to folds, in plain integers."""
    m = (1 << 64) - 1
    i = ((i ^ (i >> 30)) * 0xBF58476D1CE4E5B9) & m
    i = ((i ^ (i >> 27)) * 0x94D049BB133111EB) & m
    return i ^ (i >> 31)


class BruteChain:
    """``rows``: (text, [label of each category]) in the order in which folds are dealt."""

    def __init__(self, rows, folds=3, most=4096):
        own = [features(t) for t, _ in rows]
        y = np.array([marks for _, marks in rows], float)
        seen = Counter(f for o in own for f in o)
        gain = {}
        for f, n in seen.items():
            if n < 3:
                continue
            got = sum(y[i] for i, o in enumerate(own) if f in o)
            expected = n * y.mean(0)
            gain[f] = max((got - expected) ** 2 / np.maximum(expected * (1 - y.mean(0)), 1e-9))
        chosen = sorted(gain, key=lambda f: -gain[f])[:most]
        self.place = {f: k for k, f in enumerate(f for f in chosen if gain[f] > 0)}
        x = self._dense(own)
        fold = np.array([_mix(i) % folds for i in range(len(rows))])
        extra = np.zeros((len(rows), 0))
        self.links = []
        for j in range(y.shape[1]):
            predicted = np.zeros(len(rows))
            if j + 1 < y.shape[1]:
                for k in range(folds):
                    w = _fit(np.column_stack([x, extra]), y[:, j], fold != k)
                    predicted[fold == k] = self._p(w, x[fold == k], extra[fold == k])
            self.links.append(_fit(np.column_stack([x, extra]), y[:, j], np.ones(len(rows), bool)))
            extra = np.column_stack([extra, predicted])

    def _dense(self, own):
        x = np.zeros((len(own), len(self.place)))
        for i, o in enumerate(own):
            for f, v in o.items():
                if f in self.place:
                    x[i, self.place[f]] = v
        return x

    @staticmethod
    def _p(w, x, extra):
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, extra, np.ones(len(x))]) @ w, -35, 35)))

    def predict(self, texts):
        x = self._dense([features(t) for t in texts])
        extra = np.zeros((len(x), 0))
        for w in self.links:
            extra = np.column_stack([extra, self._p(w, x, extra)])
        return extra
