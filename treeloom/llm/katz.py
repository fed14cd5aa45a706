"""Katz backoff language model over words, with Good-Turing discounts.

    P1(w)    = d1[c(w)] c(w) / N                  seen words; the rest of the mass is the unknown word's
    Pk(w|h)  = dk[c(hw)] c(hw) / c(h)             seen after h, the k - 1 tokens before (begin marks in front)
             = alpha(h) Pk-1(w|h')                not seen after a known h; h' is h without its first token
             = Pk-1(w|h')                         h never a context in training
    alpha(h) = (1 - sum of seen Pk(.|h)) / (1 - sum of Pk-1(.|h') over the words seen after h)

so every distribution sums to 1 over the training vocabulary and one unknown word.
Counts up to ``CUT`` are discounted with Good-Turing's, from smoothed counts of counts;
absolute discounts take their place only where the smoothed counts fall too slowly for
it (a slope of -1 or more, or fewer than two of them).  A context whose discounts leave no mass gets
one more count in its denominator.

Tables and evaluation.  The corpus is stored once as a bucketed table of packed
batches (a few MB of compressed documents a row).  The counts of each order are
hash-partitioned: a batch sends each of its distinct n-grams once, in packed
columns, to the partition of its context; the partition adds up the counts of all
batches and answers with the totals a batch needs to evaluate its tokens
recursively, from words to pairs and on to the order of the model.  The answers of an order are a
table cut to the shared folder, and join the batches by their bucketing without
moving them.  A context with many tokens is split over several partitions by its
next word; its totals are sums over them.  The driver sees some ten numbers an
order, however large the corpus is.

Words are 64-bit hashes; the next word of a pair is told apart by 48 bits within
its context.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

CUT = 5
SPLIT = 1 << 20  # tokens of a context in one partition
END, BEGIN = np.uint64(0x0E0D_0E0D_0E0D_0E0D), np.uint64(0xBE61_BE61_BE61_BE61)
_ZSTD = pa.Codec("zstd", 1)


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of numbers, plane by plane, compressed; undone by ``expand``."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def expand(b: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = _ZSTD.decompress(b[8:], n, asbytes=True) if n else b""
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes(), kind)


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Factors for counts 0..CUT from ``kinds``: how many n-grams occur 1, 2, ... CUT + 1 times.

    The counts of counts are smoothed by a line through their logarithms, S(r) = A r**b
    (Simple Good-Turing).  For b < -1 all factors lie in (0, 1).
    """
    n, d, r = kinds.astype(float), np.ones(CUT + 1), np.arange(1, CUT + 1)
    some = np.flatnonzero(n > 0) + 1
    if len(some) > 1:
        gap = np.append(some[1:], 2 * some[-1] - some[-2]) - np.insert(some[:-1], 0, 0)
        x, y = np.log(some), np.log(2 * n[some - 1] / gap)  # zeros are spread over their neighbours
        b = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        if b < -1:
            rest = (CUT + 1.0) ** (b + 1)
            d[1:] = (((r + 1) / r) ** (b + 1) - rest) / (1 - rest)
            return d
    one, two = n[0], n[1]
    part = float(np.clip((one + 0.5) / (one + 2 * two + 1), 0.05, 0.95))
    d[1:] = (r - part) / r
    return d


@dataclass(frozen=True)
class Words:
    """What level one leaves: tokens, vocabulary, discounts, and the unknown word's mass."""

    tokens: int
    vocabulary: int
    discount: np.ndarray
    total: float  # denominator
    unknown: float

    @classmethod
    def of(cls, tokens: int, vocabulary: int, kinds: np.ndarray) -> Words:
        d = discounts(kinds)
        lost = float((np.arange(1, CUT + 1) * kinds[:CUT] * (1 - d[1:])).sum())
        total = float(tokens) if lost > 0 else tokens + 1.0
        return cls(tokens, vocabulary, d, total, (total - tokens + lost) / total)

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = c * np.where(c <= CUT, self.discount[np.minimum(c, CUT)], 1.0) / self.total
        return np.where(c > 0, seen, self.unknown)


class Batch:
    """The tokens of a batch: local word numbers (by hash), contexts, and the distinct pairs."""

    def __init__(self, blob: bytes):
        K.trim()  # of the batch before
        t = pa.ipc.open_stream(io.BytesIO(blob)).read_all()
        self.ids, self.train = t["id"], np.asarray(t["train"].combine_chunks()).astype(bool) if t.num_rows else np.zeros(0, bool)
        data, off = K.text_bytes(t["text"])
        s, e, first = K.words(data, off, K.SPACE)
        h = K.HASH(data, s, e, lower=True)
        self.n = np.diff(first) + 1  # words and one end
        self.start = np.cumsum(self.n) - self.n
        flat = np.full(int(self.n.sum()), END, np.uint64)
        inner = np.ones(len(flat), bool)
        inner[self.start + self.n - 1] = False
        flat[inner] = h
        self.hash, word = np.unique(np.append(flat, BEGIN), return_inverse=True)
        self.word, self.begin = word[:-1], int(word[-1])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.learn = self.train[self.doc]

    def counts(self) -> np.ndarray:
        """Training occurrences of each local word; texts for the begin mark."""
        c = np.bincount(self.word[self.learn], minlength=len(self.hash))
        c[self.begin] = int(self.train.sum())
        return c

    def grams(self, below: Grams | None = None) -> Grams:
        """The pairs, or what is one token longer than ``below``."""
        context = np.empty_like(self.word)
        if below is None:
            heads = self.hash
            context[1:] = self.word[:-1]
            context[self.start] = self.begin
        else:
            with np.errstate(over="ignore"):
                heads = K.mix(below.heads[below.context] * np.uint64(3) + self.hash[below.word])
            first = K.mix(below.heads[below.context[below.which[self.start[:1]]]] + BEGIN) if len(self.start) else heads[:0]
            heads = np.append(heads, first)  # the context of begin marks alone comes last
            context[1:] = below.which[:-1]
            context[self.start] = len(below.context)
        key, which = np.unique(context * len(self.hash) + self.word, return_inverse=True)
        context, word = key // len(self.hash), key % len(self.hash)
        low = word
        if below is not None:
            low = np.empty(len(key), np.int64)
            low[which] = below.which
        return Grams(context, word, np.bincount(which[self.learn], minlength=len(key)), which, heads, low)


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of a batch as (context, word), in their order."""

    context: np.ndarray  # local number
    word: np.ndarray  # local number
    count: np.ndarray  # occurrences in this batch's training texts
    which: np.ndarray  # of each token
    heads: np.ndarray  # hash of each context
    low: np.ndarray  # the same without its first token: a word, or a gram of the level below


def _home(h: np.ndarray, n: int) -> np.ndarray:
    return ((K.mix(h) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Dealt:
    """Places by home: only homes that get some cost anything, however many homes there are."""

    def __init__(self, home: np.ndarray):
        self.order = np.argsort(home, kind="stable")
        self.homes, first = np.unique(home[self.order], return_index=True)
        self.ends = np.append(first, len(home))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for k, i in enumerate(self.homes.tolist()):
            yield i, self.order[self.ends[k] : self.ends[k + 1]]

    def of(self, home: int) -> np.ndarray:
        k = int(np.searchsorted(self.homes, home))
        if k == len(self.homes) or self.homes[k] != home:
            return self.order[:0]
        return self.order[self.ends[k] : self.ends[k + 1]]


def _word_homes(b: Batch, n: int) -> Dealt:
    return Dealt(_home(b.hash, n))


_ROW = pa.schema([("home", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary()), ("f", pa.binary())])
_ROW_DDL = "home int, batch bigint, a binary, b binary, c binary, d binary, e binary, f binary"
_STATS = [f"s{i}" for i in range(CUT + 3)]  # tokens, kinds, kinds of 1 .. CUT + 1 occurrences
_ANSWER = pa.schema([("batch", pa.int64()), ("level", pa.int32()), ("home", pa.int32()), ("v", pa.binary()), ("w", pa.binary()), *((s, pa.int64()) for s in _STATS)])
_ANSWER_DDL = "batch bigint, level int, home int, v binary, w binary, " + ", ".join(f"{s} bigint" for s in _STATS)


def _stats(tokens: int, r: np.ndarray) -> dict:
    few = np.bincount(np.minimum(r[r > 0], CUT + 2), minlength=CUT + 3)
    return dict(zip(_STATS, [tokens, int((r > 0).sum()), *few[1 : CUT + 2].tolist()], strict=True))


def _answers(rows: list[dict], stats: dict) -> pa.Table:
    """The partition's own numbers stand on its first row only, so that sums over rows are right."""
    none = dict.fromkeys(_STATS, 0)
    return pa.Table.from_pylist([r | (stats if i == 0 else none) for i, r in enumerate(rows)], _ANSWER)


def _send_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                b = Batch(blob)
                c = b.counts()
                out = []
                for i, own in _word_homes(b, n):
                    out.append({"home": i, "batch": number, "a": b.hash[own].tobytes(), "b": squeeze(c[own])})
                yield from pa.Table.from_pylist(out, _ROW).to_batches()

    return run


def _add_words(t: pa.Table) -> pa.Table:
    keys = [np.frombuffer(a, np.uint64) for a in t["a"].to_pylist()]
    h = np.concatenate(keys)
    c = np.concatenate([expand(b, "<i8") for b in t["b"].to_pylist()])
    kinds, which = np.unique(h, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, which, c)
    words = total[kinds != BEGIN]
    ends = np.cumsum([len(k) for k in keys])
    home = t["home"][0].as_py()
    rows = [{"batch": b, "level": 1, "home": home, "v": squeeze(total[which[z - len(k) : z]]), "w": b""} for b, k, z in zip(t["batch"].to_pylist(), keys, ends, strict=True)]
    return _answers(rows, _stats(int(words.sum()), words))


def _word_counts(b: Batch, back: pa.Table, n: int) -> np.ndarray:
    dealt = _word_homes(b, n)
    c = np.zeros(len(b.hash), np.int64)
    for level, home, v in zip(back["level"].to_pylist(), back["home"].to_pylist(), back["v"].to_pylist(), strict=True):
        if level == 1:
            c[dealt.of(home)] = expand(v, "<i8")
    return c


def _gram_rows(b: Batch, g: Grams, seen: np.ndarray, n: int, split: int):
    """By partition: its grams, its contexts, and the grams of each context, in order of context and word.

    Contexts with many training tokens (``seen``) have several parts, told apart by the next word."""
    parts = 1 + seen // split
    part = (b.hash[g.word] % parts[g.context].astype(np.uint64)).astype(np.int64)
    used = np.unique(g.context)
    owner, place = K.ragged(np.zeros(len(used), np.int64), parts[used])
    heads = used[owner]  # every part of every context used
    dealt = Dealt(_home(g.heads[g.context] + part.astype(np.uint64), n))
    rank = np.empty(len(g.heads), np.int64)  # of a partition's contexts
    for i, at in Dealt(_home(g.heads[heads] + place.astype(np.uint64), n)):
        own = dealt.of(i)
        ctx = np.unique(heads[at])  # two parts of a context may share a partition
        ctx = ctx[np.argsort(g.heads[ctx], kind="stable")]
        rank[ctx] = np.arange(len(ctx))
        own = own[np.argsort(rank[g.context[own]], kind="stable")]
        yield i, own, ctx, np.bincount(rank[g.context[own]], minlength=len(ctx)), parts


@dataclass(frozen=True)
class Levels:
    """The model as far as it is known: the words, and the discounts of the levels above."""

    words: Words
    discount: tuple[np.ndarray, ...] = ()

    def of(self, b: Batch, back: pa.Table, n: int, split: int):
        """(grams, training tokens of their contexts, probability of each gram's lower one, word counts)
        of the first level without discounts, and the probability of all grams below it."""
        c = _word_counts(b, back, n)
        said: dict[int, dict[int, tuple[bytes, bytes]]] = {}
        for level, home, v, w in zip(*(back[x].to_pylist() for x in ("level", "home", "v", "w")), strict=True):
            said.setdefault(level, {})[home] = (v, w)
        g, seen, low = b.grams(), c, self.words.p(c)
        p = low
        for level, discount in enumerate(self.discount, 2):
            r, p = _evaluated(b, g, seen, low, said.get(level, {}), discount, n, split)
            g, seen, low = b.grams(g), np.append(r, c[b.begin]), p
        return g, seen, low, c, p


def _evaluated(b: Batch, g: Grams, seen: np.ndarray, low: np.ndarray, said: dict, discount: np.ndarray, n: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(total, probability) of every gram of a level, from the answers of its partitions."""
    r = np.zeros(len(g.context), np.int64)
    table, below = np.zeros((CUT + 1, len(g.heads)), np.int64), np.zeros(len(g.heads))
    for i, own, ctx, _, _ in _gram_rows(b, g, seen, n, split):
        v, w = said[i]
        r[own] = expand(v, "<u4")
        w = expand(w, "<i8")
        table[:, ctx] += w[: (CUT + 1) * len(ctx)].reshape(CUT + 1, -1)
        below[ctx] += w[(CUT + 1) * len(ctx) :].view(np.float64)
    size = np.arange(1, CUT + 1)[:, None] * table[:CUT]
    total = size.sum(0) + table[CUT]
    kept = (discount[1:, None] * size).sum(0) + table[CUT]
    bottom = np.where(kept < total, total, total + 1).astype(float)
    alpha = (1 - kept / bottom) / (1 - below)
    own = r * np.where(r <= CUT, discount[np.minimum(r, CUT)], 1.0) / bottom[g.context]
    return r, np.where(r > 0, own, np.where(total[g.context] > 0, alpha[g.context], 1.0) * low[g.low])


def _send_grams(n: int, split: int, levels: Levels):
    """The grams of the next level, with what the sums of lower probabilities need: of pairs the
    count of the word, of longer ones the probability itself."""

    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for number, blob in zip(t["batch"].to_pylist(), t["blob"].to_pylist(), strict=True):
            b = Batch(blob)
            g, seen, low, c, _ = levels.of(b, back, n, split)
            known = np.where(g.count > 0, low[g.low].view(np.int64) if levels.discount else c[g.low], 0)
            for i, own, ctx, size, parts in _gram_rows(b, g, seen, n, split):
                out.append({
                    "home": i, "batch": number, "a": g.heads[ctx].tobytes(), "b": squeeze(size.astype("<u4")), "c": _six(b.hash[g.word[own]]),
                    "d": squeeze(g.count[own].astype("<u4")), "e": squeeze(known[own]), "f": squeeze((parts[ctx] > 1).astype(np.uint8)),
                })
        return pa.Table.from_pylist(out, _ROW)

    return run


AT_ONCE = 300_000  # pairs added up in one go


def _merge_pairs(words: Words | None, heads: list, sizes: list, word: np.ndarray, count: np.ndarray, known: np.ndarray):
    """Totals of pairs whose contexts stand in ``heads``, batch by batch: (the total of each pair
    as it was sent, the context of each head, counts by context, P1 by context, the totals)."""
    kinds, context = np.unique(np.concatenate(heads), return_inverse=True)
    owner = np.repeat(context, np.concatenate(sizes))
    order = np.lexsort((word, owner))
    o, w = owner[order], word[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(count[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(known[order], first) if len(first) else np.zeros(0, np.int64)
    low = words.p(most) if words is not None else most.view(np.float64)  # of numbers above zero the bits are in their order
    mine = np.empty(len(o), np.int64)
    mine[order] = np.repeat(total, np.diff(np.append(first, len(o))))
    ctx, seen = o[first], total > 0
    table = np.zeros((CUT + 1, len(kinds)), np.int64)
    for r in range(1, CUT + 1):
        table[r - 1] = np.bincount(ctx[total == r], minlength=len(kinds))
    np.add.at(table[CUT], ctx[total > CUT], total[total > CUT])
    return mine, context, table, np.bincount(ctx[seen], low[seen], len(kinds)), total


def _add_grams(words: Words | None, level: int):
    """Totals of the grams of one partition.  Answers per gram its count, per context how many
    occur 1 .. CUT times, the occurrences of the others, and the lower probability of the words
    seen after it.  ``words``: the model of words, for pairs; longer grams bring probabilities.

    Every batch sends its contexts in the order of their hashes, so the partition is
    worked off in ranges of hashes with some ``AT_ONCE`` pairs each.
    """

    def run(t: pa.Table) -> pa.Table:
        K.trim()  # of the partition before
        sent = t.to_pylist()
        heads = [np.frombuffer(r["a"], np.uint64) for r in sent]
        sizes = [expand(r["b"], "<u4").astype(np.int64) for r in sent]
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
        pairs = int(sum(e[-1] for e in ends))
        n = -(-pairs // AT_ONCE) or 1
        edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
        cuts = [np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]) for h in heads]
        word, count, known = ([f(r[k]) for r in sent] for k, f in (("c", bytes), ("d", lambda b: expand(b, "<u4")), ("e", lambda b: expand(b, "<i8"))))
        answers: list[list[np.ndarray]] = [[] for _ in sent]
        tables: list[list[np.ndarray]] = [[] for _ in sent]
        belows: list[list[np.ndarray]] = [[] for _ in sent]
        kinds, tokens = np.zeros(CUT + 3, np.int64), 0
        for i in range(n):
            part = [(c[i], c[i + 1]) for c in cuts]
            rows = [(e[a], e[b]) for e, (a, b) in zip(ends, part, strict=True)]
            take = lambda own, rows=rows: np.concatenate([x[a:b] for x, (a, b) in zip(own, rows, strict=True)])
            mine, context, table, below, total = _merge_pairs(
                words, [h[a:b] for h, (a, b) in zip(heads, part, strict=True)], [s[a:b] for s, (a, b) in zip(sizes, part, strict=True)],
                np.concatenate([_unsix(x[6 * a : 6 * b]) for x, (a, b) in zip(word, rows, strict=True)]), take(count), take(known),
            )
            x = y = 0
            for j, ((a, b), (c, d)) in enumerate(zip(part, rows, strict=True)):
                own = context[x : x + b - a]
                answers[j].append(mine[y : y + d - c].astype("<u4"))
                tables[j].append(table[:, own])
                belows[j].append(below[own])
                x, y = x + b - a, y + d - c
            kinds += np.bincount(np.minimum(total[total > 0], CUT + 2), minlength=CUT + 3)
            tokens += int(total.sum())
        out, home = [], t["home"][0].as_py()
        for j, r in enumerate(sent):
            answer, table, below = np.concatenate(answers[j]), np.concatenate(tables[j], axis=1), np.concatenate(belows[j])
            backs_off = np.bincount(np.repeat(np.arange(len(heads[j])), sizes[j]), answer == 0, len(heads[j])) > 0
            wanted = backs_off | (expand(r["f"], "u1") > 0)
            out.append({"batch": r["batch"], "level": level, "home": home, "v": squeeze(answer), "w": squeeze(np.concatenate([table.ravel(), np.where(wanted, below, 0.0).view(np.int64)]))})
        stats = dict(zip(_STATS, [tokens, int(kinds.sum()), *kinds[1 : CUT + 2].tolist()], strict=True))
        return _answers(out, stats)

    return run


_OUT = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_DDL = "id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(n: int, split: int, levels: Levels):
    def evaluate(blob: bytes, back: pa.Table) -> pa.Table:
        b = Batch(blob)
        top = Levels(levels.words, levels.discount[:-1])
        g, seen, low, c, p = top.of(b, back, n, split)
        which = b.word
        if levels.discount:
            said = {h: (v, w) for level, h, v, w in zip(*(back[x].to_pylist() for x in ("level", "home", "v", "w")), strict=True) if level == len(levels.discount) + 1}
            _, p = _evaluated(b, g, seen, low, said, levels.discount[-1], n, split)
            which = g.which
        docs, k = b.doc, len(b.n)
        known = np.bincount(docs, c[b.word] > 0, k).astype(np.int64)
        base = np.bincount(docs, np.log10(c + 1.0)[b.word], k) - b.n * np.log10(levels.words.tokens + levels.words.vocabulary + 1.0)
        return pa.table([b.ids, pa.array(b.train), pa.array(b.n), pa.array(known), pa.array(base), pa.array(np.bincount(docs, np.log10(p)[which], k))], schema=_OUT)

    def run(t: pa.Table, back: pa.Table) -> pa.Table:
        return pa.concat_tables([_OUT.empty_table(), *(evaluate(blob, back) for blob in t["blob"].to_pylist())])

    return run


def _packed(rows: DataFrame) -> DataFrame:
    """(batch, blob): compressed documents, some MB of text a row; batches are numbered by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for rows in batches:
            _, off = K.text_bytes(pa.chunked_array([rows.column("text")]))
            for a, z in K.pieces(off, C.BATCH_BYTES):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(rows.slice(a, z - a))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue()], pa.binary())], ["batch", "blob"])
                number += 1

    return rows.mapInArrow(run, "batch bigint, blob binary")


def _drop(spark: SparkSession, name: str) -> None:
    """Forget the table of batches in the catalog; its files stay until ``common.release``."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def _totals(answers: DataFrame) -> list[int]:
    return [int(x or 0) for x in answers.agg(*(F.sum(s) for s in _STATS)).first()]


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, order: int = 2) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row, whole texts.

    Returns ``id_col, train, n_tokens, n_known, train_tokens, base_score, score``:
    the words without case (A-Z) and one end; those seen in training; all training
    tokens; log10 of the text under add-one unigrams and under the Katz model.

    ``order``: the longest n-grams.  Contexts with over ``split`` tokens are spread over several partitions.

    * null and empty texts: the end alone.  A null ``train`` counts as false.
    * rows that repeat an id or text count each time, in learning and in the result.
    * nothing to learn from: every probability is the unknown word's, which is 1.
    * an empty table gives an empty result; other columns are ignored.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark: SparkSession = docs.sparkSession
    rows = C.small_batches(docs).select(C.integer_id(docs, id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = C.parts(rows)
    files = -(-n // 4)  # a home is a partition, and four of them a file
    name = f"treeloom_batches_{uuid.uuid4().hex}"
    _packed(rows).write.bucketBy(n, "batch").option("path", C.scratch(spark, "batches")).option("compression", "zstd").saveAsTable(name)
    batches = spark.table(name)

    sent = batches.select("batch", "blob").mapInArrow(_send_words(n), _ROW_DDL)
    answers = C.cut(sent.repartitionById(n, F.col("home")).groupBy("home").applyInArrow(_add_words, _ANSWER_DDL), files)
    tokens, kinds, *few = _totals(answers)
    levels = Levels(Words.of(tokens, kinds, np.array(few)))

    def of(answers: DataFrame):
        return answers.select("batch", "level", "home", "v", "w").repartition(n, "batch").groupBy("batch")

    for level in range(2, order + 1):
        sent = batches.groupBy("batch").cogroup(of(answers)).applyInArrow(_send_grams(n, split, levels), _ROW_DDL)
        added = sent.repartitionById(n, F.col("home")).groupBy("home").applyInArrow(_add_grams(levels.words if level == 2 else None, level), _ANSWER_DDL)
        added = C.cut(added, files)
        _, _, *few = _totals(added)
        answers, levels = answers.unionByName(added), Levels(levels.words, (*levels.discount, discounts(np.array(few))))
    out = batches.groupBy("batch").cogroup(of(answers)).applyInArrow(_score(n, split, levels), _OUT_DDL)
    _drop(spark, name)  # the plan knows its files
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
