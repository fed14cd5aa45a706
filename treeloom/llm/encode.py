"""Token ids of byte-level BPE texts, equal to the tokenizer library's.

Texts of common Latin characters go through the faster of two encoders that
share the vocabulary; any other text, and any that the fast one refuses, goes
through the library, whose character tables decide.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from .token_count import byte_letters

_UNCOMMON = regex.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧‰-‾€]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        self.fast = None
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"] and not spec["post_processor"]:
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            back = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None, end: int | None = None) -> np.ndarray:
        """uint32 ids of ``text`` (null: none), then ``end``."""
        text, ids = text or "", None
        if self.fast and not _UNCOMMON.search(text):
            try:
                ids = self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # a panic of the native code isn't an Exception
                if type(e).__name__ != "PanicException":
                    raise
        if ids is None:
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return ids.astype("<u4") if end is None else np.append(ids, end).astype("<u4")


_held: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]
