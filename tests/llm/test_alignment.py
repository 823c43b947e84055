import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment, vocabulary
from ledgerloom.llm.parameters import byte_tokenizer, piece_tokenizer
from ledgerloom.llm.vocabulary import ByteLevel, Encoders, SentencePiece


def brute(rows):
    """All of it by plain loops over token byte ranges."""
    a_tok, b_tok = Tokenizer.from_file(byte_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer())
    a_tok.encode_special_tokens = True
    a_bytes, b_bytes = ByteLevel(byte_tokenizer()).token_bytes, SentencePiece(piece_tokenizer()).token_bytes
    links, groups, ids = [], [], []
    for _, text in rows:
        text = text or ""
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((a_bytes, a), (b_bytes, b))]
        begin = [[0, *e[:-1]] for e in ends]
        links.append([(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                      if begin[0][i] < ends[1][j] and begin[1][j] < ends[0][i]] if len(a) < 3000 else None)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts, at = [], 0
        for cut in cuts:
            parts.append(",".join(str(x) for x, e in zip(a, ends[0]) if at < e <= cut) + "|" + ",".join(str(x) for x, e in zip(b, ends[1]) if at < e <= cut))
            at = cut
        groups.append(parts)
        ids.append((a, b))
    count = Counter(p for one in links for p in set(one))
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    return sorted((str(row[0]), len(a), len(b), len(g), len(one), sum(count[p] == highest[p[0]] for p in one), sum(count[p] for p in one),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
                  for row, (a, b), g, one in zip(rows, ids, groups, links))


def test_equals_brute_force(documents, prose):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (4, "a b c"), (5, "A  b\nc"), (6, prose("x", 400)), (7, prose("x", 400)), (None, "no id"),
            (8, "123 !!! ###"), (9, "déjà vu\x0b日本語 🙂 <|endoftext|> end <s> </s>"), (10, "a ▁ mark"), (11, "ﬁne ① ½"), (12, "tabs\tand\r\nlines\n\n  x "),
            (13, "  two  spaces   three"), (14, "\nfirst line"), (15, "tail \n"), (16, "é é"), (17, "\x00 nul"), (18, "x" * 400)]
    rows += [(100 + k, prose(k, 60)) for k in range(30)]
    found = alignment.report(documents(rows), byte_tokenizer(), piece_tokenizer(), block_bytes=4000).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == brute(rows)


def test_edges(documents, edge_rows):
    docs = documents(edge_rows).withColumnRenamed("source", "block").withColumnRenamed("lang", "pair")
    found = {str(r.doc_id): r for r in alignment.report(docs, byte_tokenizer(), piece_tokenizer()).collect()}
    assert found["6"].n_links == found["6"].n_a + found["6"].n_b - found["6"].n_groups > 50_000
    assert found["6"][1:] == found["7"][1:]
    assert found["1"][1:] == found["2"][1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.report(documents([]), byte_tokenizer(), piece_tokenizer()).count() == 0


def test_diagonal_runs():
    """Against sets of ends, over random cuts of several texts at once."""
    dice = random.Random(1)
    for _ in range(200):
        ends, first = [[], []], [[0], [0]]
        at = 0
        for _ in range(dice.randint(1, 6)):
            size = dice.choice([0, 1, 5, 200])
            for side in (0, 1):
                inner = {x for x in range(1, size) if dice.random() < dice.choice([0.1, 0.9])}
                ends[side] += sorted(at + x for x in inner | ({size} if size else set()))
                first[side].append(len(ends[side]))
            at += size
        a, b = (np.array(e, np.int64) for e in ends)
        cut_a, cut_b = alignment.aligned(a, b, *(np.array(f) for f in first))
        assert cut_a.tolist() == np.isin(a, b).tolist() and cut_b.tolist() == np.isin(b, a).tolist()


@pytest.mark.parametrize("cached", [50, 1 << 20])
def test_cached_units_equal_whole_texts(prose, monkeypatch, cached):
    monkeypatch.setattr(vocabulary, "CACHED_UNITS", cached)
    encoders = Encoders(byte_tokenizer(), piece_tokenizer())
    texts = [prose(k, 80).replace("on ", "on.\n", 3).replace("re ", "re  ", 2) for k in range(50)] + [
        "", "x ", "\n", " lead", "Ünïcode ɏ word's they'll 12,5", "日本語", "a ▁ mark", "", "tab\tand \r", "ɐ", "<|endoftext|> </s>", "last"]
    whole = [c.encode(texts) for c in encoders.codecs]
    for _ in range(2):
        found = encoders.encode_column(pa.array(texts, pa.string()))
        for codec, want, (ids, lengths) in zip(encoders.codecs, whole, found):
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            for k, text in enumerate(texts):
                own = [] if text in ("", "a ▁ mark") else want[k].tolist()
                assert ids[cuts[k]:cuts[k + 1]].tolist() == own, text
