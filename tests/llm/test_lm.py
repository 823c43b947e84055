import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lm, queries


def brute(rows, train, prior):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    words, pairs = Counter(), Counter()
    for t, learn in zip(tokens, train):
        if learn:
            words.update(t)
            pairs.update(zip(["^"] + t[:-1], t))
    n, v = sum(words.values()), len(words)
    n1, n2 = (sum(c == k for c in words.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.01), 0.99)
    words_and_start = Counter(words)
    words_and_start["^"] = words[None]

    def log_p(h, w):
        p = (words[w] - d) / n if words[w] else (d * v / n if n else 1.0)
        if words_and_start[h]:
            p = (pairs[h, w] + prior * p) / (words_and_start[h] + prior)
        return math.log10(p)

    return [(len(t), sum(words[w] > 0 for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t),
             sum(log_p(h, w) for h, w in zip(["^"] + t[:-1], t))) for t in tokens]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_scores_equal_brute_force(documents, edge_rows, prose, block_bytes):
    rows = edge_rows[:5] + [(k, prose(k % 7, 40)) for k in range(20, 60)]
    found = lm.score(documents(rows), train=F.col("doc_id") % 3 != 0, block_bytes=block_bytes).collect()
    want = brute(rows, [r[0] is not None and r[0] % 3 != 0 for r in rows], lm.PRIOR)
    key = lambda r: (r[0] or 0, r[1])
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found], key=key)
    for g, (r, w) in zip(got, sorted([(r, w) for r, w in zip(rows, want)], key=lambda x: (x[0][0] or 0, x[1][0]))):
        assert g[:4] == (r[0], *w[:3])
        assert g[4:] == pytest.approx(w[3:], rel=1e-9)


def test_without_training_rows_and_empty_table(documents):
    found = lm.score(documents([(1, "a b"), (2, None)]), train=F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm.score(documents([]), train=F.lit(True)).count() == 0


def test_probabilities_of_a_history_sum_to_one():
    words = np.sort(np.append(lm.mix(np.arange(1, 5, dtype=np.uint64)), lm.END))
    end = int(np.searchsorted(words, lm.END))
    history, *others = [k for k in range(5) if k != end]
    totals = np.full(5, 3)
    totals[others[0]] = 0  # stands for all unknown words
    before, after = np.array([history, history]), np.array([others[1], end])
    pairs = lm.pair_hashes(words[before], words[after])
    order = np.argsort(pairs)
    machine = lm.Automaton(words, totals, pairs[order], np.array([2, 1])[order], before[order], after[order], int(totals.sum()), 4, 1, 1, 10.0)
    first = machine.run(np.array([history]), np.array([1]))[0]
    total = sum(10 ** (machine.run(np.array([history, w]), np.array([2]))[0] - first) for w in range(5))
    assert total == pytest.approx(1.0)


def test_better_than_the_base_on_held_out_texts(spark):
    found = queries.op1_lm_score(spark, "/root/testdata/sf0.001").toPandas()
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 7 == 2 for i in found.doc_id]
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()
