import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import tokenids
from ledgerloom.llm.parameters import byte_tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_tokenizer())


def test_encoder_equals_library(library, prose, edge_rows):
    dice = random.Random(3)
    texts = [t or "" for _, t in edge_rows] + ["it's  12 l'été\r\n\n x", "a \u00a0b", "a\x1cb", "  lead", "trail  ", "\n\n", "a \n b", "x<|endoftext|>y"]
    texts += ["".join(dice.choice(" \n\t'!aé1s×ªⅣ²") for _ in range(40)) for _ in range(200)]
    encoder = tokenids.Encoder(byte_tokenizer())
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:50])


def test_small_cache(monkeypatch, prose):
    texts = [prose(k, 200) for k in range(600)]
    want = tokenids.Encoder(byte_tokenizer()).encode(texts)
    monkeypatch.setattr(tokenids, "CACHED_UNITS", 50)
    assert tokenids.Encoder(byte_tokenizer()).encode(texts) == want


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    dice = np.random.default_rng(seed)
    ids = dice.integers(0, (3, 50, 50_000, 5)[seed], 20_000).astype("<u4")
    if seed == 3:
        ids = np.tile(ids[:40], 500)
    lengths = np.array([0, 5, len(ids) - 5, 0])
    content = tokenids.to_file(ids, lengths, min_count=2)
    file = tokenids.ShardFile(content)
    assert (file.ids() == ids).all() and file.lengths.tolist() == lengths.tolist()
    assert seed == 2 or len(file.seq) < 0.8 * len(ids)
    for a, b in dice.integers(0, len(ids) + 1, (100, 2)):
        assert (file.ids(int(min(a, b)), int(max(a, b))) == ids[min(a, b):max(a, b)]).all()
    assert (file.document(1) == ids[:5]).all() and len(file.document(3)) == 0
    assert len(tokenids.ShardFile(tokenids.to_file(ids[:0], np.array([], np.int64))).ids()) == 0


def test_default_grammar_leaves_no_frequent_pair():
    dice = np.random.default_rng(9)
    words = [dice.integers(0, 900, dice.integers(2, 9)) for _ in range(400)]
    ids = np.concatenate([words[k] for k in dice.zipf(1.3, 30_000) % 400] + [np.full(5000, 7), np.tile([1, 1, 2], 900)]).astype("<u4")
    base, rules, seq = tokenids.compress(ids.copy())
    pairs, counts = np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:], return_counts=True)
    assert counts.max() < tokenids.MIN_COUNT and len(seq) + 2 * len(rules) < 0.3 * len(ids)
    file = tokenids.ShardFile(tokenids.to_file(ids, np.array([len(ids)])))
    assert (file.ids() == ids).all() and (file.ids(100_001, 100_100) == ids[100_001:100_100]).all()


@pytest.mark.parametrize("n", [2, 3, 1000, 1001, 4097])
def test_runs_of_one_id_shrink(n):
    ids = np.full(n, 5, "<u4")
    base, rules, seq = tokenids.compress(ids.copy(), min_count=2)
    file = tokenids.ShardFile(tokenids.to_file(ids, np.array([n]), min_count=2))
    assert (file.ids() == ids).all() and len(seq) <= max(3, n.bit_length()) and len(rules) <= n.bit_length()


@pytest.mark.parametrize("shard_ids", [1, 500, 1 << 20])
def test_files_equal_library(documents, edge_rows, library, shard_ids):
    found = tokenids.written_ids(documents(edge_rows).withColumnRenamed("source", "start"), byte_tokenizer(), shard_ids=shard_ids)
    want, at = [], 0
    for doc, text in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
    assert tokenids.written_ids(documents([]), byte_tokenizer()).count() == 0
