import random

import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import tokencount
from ledgerloom.llm.parameters import byte_tokenizer, piece_tokenizer, word_tokenizer


def library_count(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def check(docs, rows, path, **options):
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.report(docs, path, **options).collect())
    texts = [r[1] or "" for r in rows]
    assert found == sorted((str(r[0]), len(t.encode()), n, n > 2048) for r, t, n in zip(rows, texts, library_count(path, texts)))


def mixture(seed, n):
    """Words, runs of punctuation, marks, digits, long unbroken runs, names of special tokens."""
    dice = random.Random(seed)
    kinds = [lambda: "".join(dice.choices("abcdefgh", k=dice.randint(1, 12))), lambda: " " * dice.randint(1, 4), lambda: dice.choice("\n\t\r  "),
             lambda: "".join(dice.choices(".,!?'-<|>", k=dice.randint(1, 6))), lambda: str(dice.randint(0, 10 ** 9)), lambda: "日本語テキスト"[:dice.randint(1, 7)],
             lambda: "ȩ́", lambda: "<|endoftext|>", lambda: "<|startoftext|>", lambda: "it's we'LL", lambda: "ΣΊΣΥΦΟΣ", lambda: "🙂👍🏽"]
    return "".join(dice.choice(kinds)() for _ in range(n))


@pytest.mark.parametrize("path", [word_tokenizer, byte_tokenizer, piece_tokenizer])
def test_equals_the_library(documents, edge_rows, path):
    rows = edge_rows + [(30 + k, mixture(k, 40)) for k in range(20)] + [(60, "tail \n"), (61, "\n\n head"), (62, " "), (63, "Straße No. 5 ")]
    check(documents(rows), rows, path())


@pytest.mark.parametrize("path", [word_tokenizer, byte_tokenizer, piece_tokenizer])
def test_chunks_are_spliced_exactly(documents, path):
    rows = [(k, mixture(100 + k, 1500)) for k in range(8)] + [(8, None), (8, mixture(100, 1500))]
    check(documents(rows), rows, path(), chunk_chars=400, overlap_chars=200)


@pytest.mark.parametrize("path", [word_tokenizer, byte_tokenizer, piece_tokenizer])
def test_overlaps_are_widened(documents, path):
    """Texts without any place to splice at: one word, one run of marks, a word longer than the first overlaps in the middle."""
    rows = [(1, "ab" * 3000), (2, "é" * 2000), (3, "one two " * 300 + "x" * 3000 + " three four" * 300), (4, "!" * 2500), (5, "a b " * 900)]
    check(documents(rows), rows, path(), chunk_chars=400, overlap_chars=200)


def test_first_chunks_fail_and_wider_ones_hold(documents, spark):
    docs = documents([(1, "one two " * 300 + "x" * 3000 + " three four" * 300)]).selectExpr("doc_id", "text", "1L AS n_bytes")
    _, chunks = tokencount._first_pass(docs, word_tokenizer(), 400, 200)
    found = tokencount._spliced(tokencount._encoded(chunks, word_tokenizer(), 400, 200)).collect()
    assert [r.n_tokens for r in found] == [None]


def test_other_columns_do_not_matter(documents, edge_rows):
    docs = documents(edge_rows).withColumnRenamed("source", "key").withColumnRenamed("lang", "n_tokens")
    assert tokencount.report(docs, word_tokenizer()).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert tokencount.report(documents([]), word_tokenizer()).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        tokencount.report(docs, word_tokenizer(), chunk_chars=100, overlap_chars=90)
