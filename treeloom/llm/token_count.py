"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch are laid out as one flat array of symbols with
row starts.  In each round the rank of every adjacent pair is looked up, each row
applies all occurrences of its own lowest-ranked pair at once, and rows without a
known pair drop out.  What is left of a row is its token count.  Counts of
pre-tokens are remembered within a worker in a table of bounded size.

Splitting follows the tokenizer file (special strings, normaliser, pattern).
Texts made of common Latin characters are split here; any text with other
characters is normalised and split by the tokenizer library itself, because
character tables differ between libraries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

REMEMBERED = 400_000
_NONE = np.iinfo(np.int32).max
_UNCOMMON = regex.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧‰-‾€]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Symbols and merge ranks of a byte-level BPE model."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made[order]

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        want = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, at, -1)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece (non-empty byte strings)."""
        length = np.array([len(p) for p in pieces], np.int64)
        out = length.copy()
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(length)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        row = np.repeat(np.arange(len(pieces)), length)
        while len(sym) > 1:
            at = self._look(sym[:-1], sym[1:])
            at[row[:-1] != row[1:]] = -1
            rank = np.where(at >= 0, self.rank[at], _NONE)
            head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            least = np.minimum.reduceat(np.append(rank, _NONE), head)
            size = np.diff(np.append(head, len(row)))
            least = np.repeat(least, size)
            hit = (rank == least[:-1]) & (rank != _NONE)
            # of touching occurrences (a a a) the first, third, ... are applied
            place = np.arange(len(hit))
            before = np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (place - before) % 2 == 1
            first = np.flatnonzero(hit)
            sym[first] = self.made[at[first]]
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            keep &= least != _NONE  # finished rows leave
            done = np.flatnonzero(least[head] == _NONE)
            out[row[head[done]]] = size[done]
            sym, row = sym[keep], row[keep]
        if len(sym) == 1:
            out[row[0]] = 1
        return out


class TokenCounter:
    """Counts like the tokenizer library does for a BPE ``.json`` file, default special strings included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.library = Tokenizer.from_file(path)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [spec["normalizer"]] if spec.get("normalizer") else [])
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "Split"]
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.own = len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"] and {s["type"] for s in steps} <= {"NFC", "Replace", "Lowercase"}
        self.pattern = regex.compile(split[0]["pattern"]["Regex"]) if self.own else None
        self.merges = Merges(model)
        self.bytes_of = {c: b for b, c in byte_letters().items()}
        self.known: dict[str | bytes, int] = {}

    def _split(self, text: str) -> list:
        """Pre-tokens: str where split here, bytes where the library did it."""
        if self.own and not _UNCOMMON.search(text):
            return self.pattern.findall(text.lower() if self.lower else text)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if p]

    def counts(self, texts: list[str | None]) -> list[int]:
        split, extra = [], []
        for text in texts:
            parts, n = [text or ""], 0
            if self.special and text:
                parts = self.special.split(text)
                n = len(parts) - 1
            tokens: list = []
            for p in parts:
                tokens += self._split(p)
            split.append(tokens)
            extra.append(n)
        known = self.known
        new = [*{w for tokens in split for w in tokens if w not in known}]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = [*{w for tokens in split for w in tokens}]
        if new:
            known.update(zip(new, self.merges.count([w if isinstance(w, bytes) else w.encode() for w in new]).tolist(), strict=True))
        return [sum(map(known.__getitem__, tokens)) + n for tokens, n in zip(split, extra, strict=True)]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row; ``path`` is read on the executors.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and null ids
    are counted row by row; other columns are ignored; an empty table stays empty.
    """
    held: dict[str, TokenCounter] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held.setdefault(path, TokenCounter(path))
        for batch in batches:
            for b in K.slices(batch, "text", 2 << 20):
                n = counter.counts(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["k", "n_tokens"])

    key = F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"))
    rows = C.small_batches(docs).select(key.alias("k"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(run, f"k {kind}, n_tokens bigint")
    return out.select(F.col("k.id").alias(id_col), F.col("k.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
