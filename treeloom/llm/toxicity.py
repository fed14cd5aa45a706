"""Toxicity by a classifier chain over hashed word and word-beginning features.

Categories are predicted one after another.  Each has a logistic model over the
same text features plus the probabilities of all earlier categories.  For
training, those probabilities are out-of-fold predictions, so later models see
them as noisy as they will be; for scoring, every link is fitted on all training
rows and fed with the actual outputs of the links before it.

Features of a text are its words without case and the first 5 to 9 bytes of
each (stems of inflected insults), hashed to 2**18 numbers; the value is
log(1 + occurrences), to which long and short texts contribute alike.  The
``max_features`` most telling of them (largest chi-square against any category)
are kept, so the model is a few small arrays that travel in the task closure.

Only training is bounded: at most ``max_train`` labelled rows, chosen by the
smallest hash of their id, reach the driver as feature numbers, never as texts.
Scoring reads every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

DIMS = 1 << 18
STEMS = (5, 6, 7, 8, 9)
_LETTERS = K.ALNUM.copy()
_LETTERS[0x30:0x3A] = False


def features(texts: Sequence[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) triples, sorted; ``wanted`` (bool by feature) keeps some only."""
    rows, cols, values = [], [], []
    data, off = K.text_bytes(pa.array([(t or "").lower() for t in texts], pa.string()))
    for a, b in K.pieces(off, 2 << 20):
        part = data[off[a] : off[b]]
        s, e, first = K.words(part, off[a : b + 1] - off[a], _LETTERS)
        owner = np.repeat(np.arange(a, b), np.diff(first))
        keys = []
        for k in (None, *STEMS):
            own = np.ones(len(s), bool) if k is None else e - s > k
            h = K.HASH(part, s[own], e[own] if k is None else s[own] + k)
            f = ((h ^ np.uint64(k or 0)) >> np.uint64(46)).astype(np.int64)
            if wanted is not None:
                good = wanted[f]
                keys.append(owner[own][good] * DIMS + f[good])
            else:
                keys.append(owner[own] * DIMS + f)
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        rows.append(key // DIMS)
        cols.append(key % DIMS)
        values.append(np.log1p(n).astype(np.float32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


@dataclass
class Sparse:
    """A sparse matrix as sorted triples; products by bincount."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Link:
    """One logistic model: text weights, weights of the earlier categories, bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: Sparse, extra: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float, rounds: int) -> Link:
        """Truncated Newton steps (conjugate gradients) on the rows ``use`` (a 0/1 weight per row)."""
        m, k, n = x.shape[1], extra.shape[1], max(1.0, use.sum())
        rate = float(np.clip((y * use).sum() / n, 1e-4, 1 - 1e-4))
        w = np.zeros(m + k + 1)
        w[-1] = np.log(rate / (1 - rate))
        decay = np.full(len(w), l2)
        decay[-1] = 0

        def forward(v):
            return x.dot(v[:m]) + extra @ v[m:-1] + v[-1]

        def back(r):
            return np.concatenate([x.back(r), extra.T @ r, [r.sum()]])

        def loss(z, v):
            return float((use * (np.logaddexp(0, z) - y * z)).sum() / n + 0.5 * (decay * v * v).sum())

        z = forward(w)
        now = loss(z, w)
        for _ in range(rounds):
            p = _sigmoid(z)
            g = back((p - y) * use / n) + decay * w
            d = p * (1 - p) * use / n + 1e-12
            step, r = np.zeros_like(w), -g
            q, rr = r.copy(), float(r @ r)
            goal = min(0.25, rr**0.25) ** 2 * rr
            for _ in range(25):
                if rr <= goal:
                    break
                h = back(d * forward(q)) + (decay + 1e-9) * q
                a = rr / float(q @ h)
                step += a * q
                r = r - a * h
                new = float(r @ r)
                q, rr = r + (new / rr) * q, new
            zs, size = forward(step), 1.0
            while size > 1e-3 and loss(z + size * zs, w + size * step) > now + 1e-4 * size * float(g @ step):
                size /= 2
            w, z = w + size * step, z + size * zs
            before, now = now, loss(z, w)
            if before - now < 1e-7:
                break
        return cls(w[:m], w[m:-1], float(w[-1]))

    def __call__(self, x: Sparse, extra: np.ndarray) -> np.ndarray:
        return _sigmoid(x.dot(self.weights) + extra @ self.earlier + self.bias)


@dataclass
class Chain:
    """The fitted chain: selected features and one link per category, in order."""

    categories: tuple[str, ...]
    column: np.ndarray  # place of each feature among the selected ones, -1: not selected
    links: list[Link]

    @classmethod
    def fit(cls, categories: Sequence[str], row: np.ndarray, col: np.ndarray, val: np.ndarray, labels: np.ndarray, max_features: int = 4096, folds: int = 3, l2: float = 2e-5, rounds: int = 12) -> Chain:
        n = len(labels)
        seen = np.bincount(col, minlength=DIMS).astype(float)
        gain = np.zeros(DIMS)
        for j in range(labels.shape[1]):
            rate = labels[:, j].mean() if n else 0.0
            got = np.bincount(col, labels[row, j], DIMS)
            gain = np.maximum(gain, (got - seen * rate) ** 2 / np.maximum(seen * rate * (1 - rate), 1e-9))
        gain[seen < 3] = 0
        chosen = np.sort(np.argsort(-gain, kind="stable")[:max_features])
        chosen = chosen[gain[chosen] > 0]
        column = np.full(DIMS, -1, np.int64)
        column[chosen] = np.arange(len(chosen))
        own = column[col] >= 0
        x = Sparse(row[own], column[col[own]], val[own].astype(float), (n, len(chosen)))
        fold = (K.mix(np.arange(n, dtype=np.uint64)) % np.uint64(folds)).astype(int)
        links, out_of_fold = [], np.zeros((n, 0))
        for j in range(labels.shape[1]):
            y = labels[:, j].astype(float)
            predicted = np.zeros(n)
            if j + 1 < labels.shape[1]:  # the last category feeds nothing
                for k in range(folds):
                    link = Link.fit(x, out_of_fold, y, (fold != k).astype(float), l2, rounds)
                    predicted[fold == k] = link(x, out_of_fold)[fold == k]
            links.append(Link.fit(x, out_of_fold, y, np.ones(n), l2, rounds))
            out_of_fold = np.column_stack([out_of_fold, predicted])
        return cls(tuple(categories), column, links)

    def predict(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities, one column per category."""
        row, col, val = features(texts, self.column >= 0)
        x = Sparse(row, self.column[col], val.astype(float), (len(texts), int((self.column >= 0).sum())))
        out = np.zeros((len(texts), 0))
        for link in self.links:
            out = np.column_stack([out, link(x, out)])
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int = 8_000, id_col: str = "doc_id", text_col: str = "text", **options) -> Chain:
    """Fit a chain.  ``categories`` maps names to SQL conditions over ``labels``, in chain order.

    Uses at most ``max_train`` labelled rows (smallest hashes of the id).  Labels
    with a null id or a null condition, and labels without a document, are left
    out; null texts have no features.  Of documents that repeat an id the first text
    in order counts.  Without any training rows every probability is the same, near zero.
    """
    conditions = [F.expr(c).cast("double").alias(f"_y{i}") for i, c in enumerate(categories.values())]
    known = labels.select(F.col(id_col).alias("_id"), *conditions).dropna().dropDuplicates(["_id"])
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = C.small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")  # at most max_train rows
    # one document per label, however often its id is repeated
    marks = [f"_y{i}" for i in range(len(categories))]
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), *(F.min(m).alias(m) for m in marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for batch in batches for b in K.slices(batch, "_text", 4 << 20)):
            n = b.num_rows
            row, col, val = features(b.column("_text").to_pylist())
            cut = np.searchsorted(row, np.arange(n + 1))
            packed = [[a[i:j].astype(t).tobytes() for i, j in zip(cut, cut[1:], strict=False)] for a, t in ((col, "<u4"), (val, "<f2"))]
            y = np.column_stack([b.column(f"_y{i}").to_numpy(zero_copy_only=False) for i in range(len(categories))]) if n else np.zeros((0, len(categories)))
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary())], ["k", "c", "v", "y"])

    packed = rows.withColumn("_key", F.xxhash64("_id", "_text")).mapInArrow(run, "k bigint, c binary, v binary, y binary").toArrow().sort_by("k")
    cols = [np.frombuffer(c, "<u4") for c in packed["c"].to_pylist()]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate([np.zeros(0, "<u4"), *cols]).astype(np.int64)
    val = np.concatenate([np.zeros(0, "<f2"), *(np.frombuffer(v, "<f2") for v in packed["v"].to_pylist())]).astype(np.float32)
    y = np.array([np.frombuffer(r, "<f8") for r in packed["y"].to_pylist()]).reshape(-1, len(categories))
    chain = Chain.fit(tuple(categories), row, col, val, y, **options)
    del packed, cols, row, col, val, y
    K.trim()
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """Every row and column of ``docs`` plus ``{prefix}{category}`` (double) per category.

    A null or empty text gets the probabilities of a text without features.
    Repeated rows are scored alike; a clash with a new column name raises
    ValueError (choose another ``prefix``); an empty table stays empty.
    """
    names = [f"{prefix}{c}" for c in chain.categories]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for batch in batches for b in K.slices(batch, text_col, 4 << 20)):
            p = chain.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i]) for i in range(len(names)))], [*b.schema.names, *names])

    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return C.small_batches(docs).mapInArrow(run, ", ".join([ddl, *(f"`{n}` double" for n in names)]))
