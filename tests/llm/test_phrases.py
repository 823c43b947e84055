import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, top=2000):
    f, n = Counter(), Counter()
    for row in rows:
        lang = (row[2] if len(row) > 2 else None) or "und" if len(row) < 3 or row[2] is None else row[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(row[1] or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, *words[i:i + m]) for i in range(len(words) - m + 1))
    candidates = {g: a for g, a in f.items() if a >= min_count and 3 <= len(g) <= 5}
    dropped = set()
    for longer, b in candidates.items():
        lang, words = longer[0], longer[1:]
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                part = (lang, *words[i:i + m])
                if 100 * b >= 80 * candidates[part]:
                    dropped.add(part)
    scored = {}
    for g, a in candidates.items():
        if g not in dropped:
            cuts = [(2_000_000 * a // (f[g[:k + 1]] + f[(g[0], *g[k + 1:])]), k, f[g[:k + 1]], f[(g[0], *g[k + 1:])]) for k in range(1, len(g) - 1)]
            scored.setdefault(g[0], []).append((-min(cuts)[0], -a, " ".join(g[1:]).encode(), min(cuts)))
    return sorted((lang, i + 1, p.decode(), -a, cut[2], cut[3], n[lang], -s) for lang, found in scored.items()
                  for i, (s, a, p, cut) in enumerate(sorted(found)[:top]))


def corpus(seed, n_docs, n_words):
    dice = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(n_words)] + ["The", "the", "É", "x-y"]
    passages = [" ".join(dice.choices(vocabulary, k=dice.randint(3, 12))) for _ in range(6)]
    rows = []
    for i in range(n_docs):
        text = ""
        for _ in range(dice.randint(0, 12)):
            text += dice.choice(passages) if dice.random() < 0.5 else " ".join(dice.choices(vocabulary, k=dice.randint(1, 7)))
            text += dice.choice([" ", ". ", ",", "\n", "  ", "\t", "!? ", " "])
        rows.append((i, text, dice.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed,n_words,min_count", [(1, 12, 5), (2, 40, 3), (3, 5, 30), (4, 200, 2)])
def test_equals_brute_force(documents, seed, n_words, min_count):
    rows = corpus(seed, 150, n_words)
    expected = brute(rows, min_count)
    found = phrases.mine(documents(rows), min_count=min_count, block_bytes=3000).collect()
    assert sorted(map(tuple, found)) == expected and len(expected) > 20


def test_top_and_ties(documents):
    rows = corpus(5, 100, 10)
    assert sorted(map(tuple, phrases.mine(documents(rows), min_count=3, top=7).collect())) == brute(rows, 3, 7)


def test_edges(documents, edge_rows):
    rows = [(*r[:2], "en") for r in edge_rows] + [(50, "one two three " * 10_000, "en"), (51, "word", None), (52, "A\u0000b c", "en")] * 3
    docs = documents(rows)
    found = phrases.mine(docs.withColumnRenamed("source", "words").withColumnRenamed("n_chars", "n"), min_count=3)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3)
    assert phrases.mine(documents([])).count() == 0
    assert phrases.mine(documents([(1, "too rare", "en")])).count() == 0


def test_parts_of_a_common_word(documents, monkeypatch):
    """The successors of a common word are counted in several places."""
    monkeypatch.setattr(phrases, "PART_ENTRIES", 16)
    rows = [(k, f"the w{k % 40} the w{k % 7} end", "en") for k in range(400)]
    assert sorted(map(tuple, phrases.mine(documents(rows), min_count=5, block_bytes=500).collect())) == brute(rows, 5)


def test_unary_paths_are_compacted():
    """Three runs of one path of 8 words, one of which goes on: paths, piece ends, weights."""
    seq = np.array([1, 2, 3, 4, 5, 6, 7, 8, 0] * 2 + [1, 2, 3, 4, 5, 6, 7, 8, 9, 0], "<u4")
    at, both = phrases._pairs_at(seq, np.zeros(len(seq), bool), 9)
    distinct, pair = np.unique(both, return_inverse=True)
    begin, size, weight = phrases.compacted(seq, at, pair, len(distinct))
    found = sorted((tuple(seq[b:b + s].tolist()), w) for b, s, w in zip(begin.tolist(), size.tolist(), weight.tolist()))
    assert found == [((1, 2, 3, 4, 5, 6, 7, 8), 3), ((6, 7, 8), 2), ((6, 7, 8, 9), 1), ((7, 8), 2), ((7, 8, 9), 1), ((8, 9), 1)]
