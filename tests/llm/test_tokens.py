"""Token counts, packing and record files against the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from treeloom.llm import packing as K
from treeloom.llm import records as R
from treeloom.llm.common import scratch
from treeloom.llm.encode import Encoder
from treeloom.llm.queries import tokenizer_file
from treeloom.llm.token_count import TokenCounter, token_counts

from .conftest import EDGE

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


def fuzz(n=4000):
    random.seed(3)
    pool = [chr(c) for c in [*range(9, 14), *range(28, 127), *range(0x80, 0x250), 0x3A3, 0x300, 0x307, 0x4E2D, 0x1F600, 0x2028, 0x3000, 0x200B, 0xFB01, 0x1E9E, 0x660, 0xAC00, 0x1161, 0x212B]]
    pool += ["<|endoftext|>", "<|startoftext|>", "the", "aaaa", "'s", "'LL", "  ", "Σ"]
    return ["".join(random.choice(pool) for _ in range(random.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library():
    library, texts = Tokenizer.from_file(WORD), [*fuzz(), "ab" * 5000, "", "a" * 999, "İstanbul Σίσυφος"]
    assert TokenCounter(WORD).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    library, enc = Tokenizer.from_file(BYTE), Encoder(BYTE)
    for text in [*fuzz(), "a" * 5000, "", " \n" * 500]:
        assert enc(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert enc(None, 0).tolist() == [0]


def test_token_counts(docs, texts, edge, none):
    library = Tokenizer.from_file(WORD)
    one = lambda i, t: (i, len((t or "").encode()), (n := len(library.encode(t or "", add_special_tokens=False).ids)), n > 2048)
    assert Counter(map(tuple, token_counts(docs, WORD).collect())) == Counter(one(*x) for x in texts.items())
    assert Counter(map(tuple, token_counts(edge, WORD).collect())) == Counter(one(i, t) for i, t, _ in EDGE)
    assert token_counts(none, WORD).count() == 0


def ids_of(text):
    return np.array(Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_packing(rows, texts, size):
    """Every document whole, every sequence gapless and short enough; few sequences."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    expected = defaultdict(list)
    for i, text in texts:
        ids = ids_of(text)
        first = len(ids) % size or min(size, len(ids))
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i].append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in expected.items()}
    return len(sequences), -(-sum(p[2] for own in expected.values() for p in own) // size)


@pytest.mark.parametrize("size", [2048, 100])
def test_packing(docs, texts, size):
    made, least = check_packing(K.pack_documents(docs, BYTE, size).collect(), texts.items(), size)
    assert made <= least * 1.01 + 1


def test_packing_edges(edge, none):
    check_packing(K.pack_documents(edge, BYTE, 64).collect(), [(i, t) for i, t, _ in EDGE], 64)
    assert K.pack_documents(none, BYTE).count() == 0


@pytest.mark.parametrize("case", ["uniform", "small", "big", "one", "none", "mixed"])
def test_plan_uses_every_length_as_often_as_it_occurs(case):
    rng, size = np.random.default_rng(1), 256
    lengths = {"uniform": rng.integers(1, 257, 4000), "small": rng.integers(1, 9, 500), "big": rng.integers(129, 257, 300), "one": [5] * 7, "none": [], "mixed": [200] * 9 + [56] * 3 + [1] * 400}[case]
    hist = np.bincount(np.array(lengths, int), minlength=size + 1)
    made = K.plan(hist, size)
    used = np.zeros(size + 1, int)
    for pattern, k in made:
        assert sum(pattern) <= size and k > 0
        for x in pattern:
            used[x] += k
    assert (used == hist).all()
    total = sum(k for _, k in made)
    big = int(hist[size // 2 + 1 :].sum())
    assert total <= max(big, 1.02 * int((hist * np.arange(size + 1)).sum()) / size) + 2


def test_nnls_recovers_exact_counts():
    pats = np.array([[200, 56, 0, 0], [128, 128, 0, 0], [100, 100, 56, 0]])
    hist = np.bincount([200] * 30 + [56] * 50 + [128] * 20 + [100] * 40, minlength=257).astype(float)
    assert np.allclose(K.nnls(pats, hist, 3000), [30, 10, 20], atol=0.3)


# ---- records -------------------------------------------------------------


def test_records_round_trip(spark, docs, texts, edge, none):
    for df, rows in ((docs, list(texts.items())), (edge, [(i, t) for i, t, _ in EDGE])):
        made = R.write_records(df, scratch(spark, "records"), BYTE)
        got = R.read_records(spark, made).collect()
        own = Counter((i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in rows)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == own
        at = 0
        order = sorted(got, key=lambda r: r.start)
        for r in order:
            assert r.start == at
            at += r.n_tokens
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in order]
        assert keys == sorted(keys)
    assert R.read_records(spark, R.write_records(none, scratch(spark, "records"), BYTE)).count() == 0


def test_files_are_cut_and_shuffled_reads_find_every_record(spark, docs, texts, monkeypatch):
    made = R.write_records(docs.limit(50), scratch(spark, "records"), BYTE)
    uris = [r.uri for r in made.collect()]
    keys = []
    for uri in uris:
        f = R.RecordFile(uri)
        assert len(f) == sum(1 for _ in f.read())
        keys += [key for _, key, ids in f.shuffled(1) if (ids == ids_of(texts[key])).all()]
    assert len(keys) == len(set(keys)) == 50


def test_damage_is_found():
    raw = R.frame(7, np.arange(20), 2)
    assert R.unframe(raw)[0] == 7
    for i in range(len(raw)):
        bad = bytearray(raw)
        bad[i] ^= 1
        with pytest.raises(R.Corrupt):
            R.unframe(bytes(bad))
    with pytest.raises(R.Corrupt):
        R.unframe(raw[:-1])
