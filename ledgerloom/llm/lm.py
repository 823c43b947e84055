"""Language-model scoring with a weighted backoff automaton over word bigrams.

States are the empty history and every word seen in training (and the start of a text). A state's arcs lead to
the words seen after it; its failure arc, taken for any other word, costs the backoff weight and leads to the
empty history, whose arcs are the smoothed single words. The word just read is the next state.

    p(w)     = (c(w) - D) / N, and D V / N for all unknown words together   (absolute discounting)
    p(w | h) = (c(h w) + K p(w)) / (c(h) + K); failure weight of h: K / (c(h) + K)

A model of all word pairs of a large corpus fits no executor, so it is never in one place. The texts are written once as
blocks of word numbers. Each block sends the sorted hashes of its distinct words and pairs, with their training counts,
to shards by hash; the shards add up and answer each block, value by value in the order it sent; the block then has the
part of the automaton that its own texts can visit, and runs them through it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, spans_of, utf8, written
from ledgerloom.llm.tokens import WHITE_SPACE, mix, split_words

BLOCK_BYTES = 8 << 20  # text of one block
SHARD_BYTES = 8 << 20  # text per shard of the counts
PIECE_BYTES = 1 << 20
PRIOR = 300.0  # K: how many observations the shorter history counts for
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56 bits, a byte less to send: of n distinct pairs in the corpus about n^2 / 2^57 collide, one in 700 runs at 10 million pairs, 70 pairs of 100 billion."""
    return mix(before * _PAIR + word) >> np.uint64(8)


def pack(values: np.ndarray) -> bytes:
    """Numbers with the bytes of equal weight side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def _with_history(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pair hash of each token with the one before it; a text's first token follows START."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = START
    return pair_hashes(before, tokens)


class _Block:
    """Texts gathered up to the size of a block."""

    def __init__(self):
        self.ids, self.train, self.lengths, self.tokens, self.size = [], [], [], [], 0

    def add(self, ids: list, train: list, data: np.ndarray, offsets: np.ndarray) -> None:
        words = split_words(data, offsets, WHITE_SPACE)
        n = np.diff(words.first)
        tokens = np.full(len(words) + len(n), END, np.uint64)
        keep = np.ones(len(tokens), bool)
        keep[np.cumsum(n + 1) - 1] = False
        tokens[keep] = words.hashes()
        self.tokens.append(tokens)
        self.lengths.append(n + 1)
        self.ids += ids
        self.train += train
        self.size += len(data)

    def row(self, name: int, id_type: pa.DataType) -> pa.RecordBatch:
        lengths, tokens = np.concatenate(self.lengths), np.concatenate(self.tokens)
        words = np.unique(tokens)
        n_train = int(lengths[np.array(self.train, bool)].sum())
        return pa.RecordBatch.from_arrays([
            pa.array([name], pa.int64()), pa.array([pack_sorted(words)], pa.binary()),
            pa.array([pack(np.searchsorted(words, tokens).astype("<u4"))], pa.binary()), pa.array([self.ids], pa.list_(id_type)),
            pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([self.train], pa.list_(pa.bool_())),
            pa.array([n_train], pa.int64())], names=["block", "words", "ids", "doc_ids", "lengths", "train", "n_train"])


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts as numbers of words (hashes, in order) per block, as a written table."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, id_type = TaskContext.get().partitionId() << 32, _Block(), None
        for batch in batches:
            id_type = batch.column(0).type
            data, offsets = utf8(batch.column(1))
            ids, chosen = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in spans_of(offsets, PIECE_BYTES):
                block.add(ids[i:j], chosen[i:j], data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                if block.size >= block_bytes:
                    yield block.row(name, id_type)
                    name, block = name + 1, _Block()
        if block.ids:
            yield block.row(name, id_type)

    return written(narrow.mapInArrow(run, (
        f"block long, words binary, ids binary, doc_ids array<{kind}>, lengths array<long>, train array<boolean>, n_train long")), "lm-blocks")


def counts(texts: DataFrame, shards: int) -> DataFrame:
    """Per block and shard: sorted hashes of the block's distinct words and pairs, and their training counts.

    Only shards that have any are listed, so there are never more rows than distinct words and pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(shards + 1, dtype=np.uint64) * np.uint64((1 << 32) // shards)
        for batch in batches:
            for name, words, ids, lengths, train in zip(*batch.columns):
                words, ids, lengths = unpack_sorted(words.as_py()), unpack(ids.as_py(), "<u4"), lengths.values.to_numpy()
                learnt = np.repeat(train.values.to_numpy(zero_copy_only=False), lengths)
                word_counts = np.bincount(ids[learnt], minlength=len(words)).astype("<u4")
                grams = _with_history(words[ids], np.cumsum(lengths) - lengths)
                pairs, chosen = np.unique(grams), np.sort(grams[learnt])
                pair_counts = (np.searchsorted(chosen, pairs, "right") - np.searchsorted(chosen, pairs, "left")).astype("<u4")
                by_word, by_pair = np.searchsorted(words >> np.uint64(32), bounds), np.searchsorted(pairs >> np.uint64(24), bounds)
                out = [(name.as_py(), k, pack_sorted(words[a:b]), pack(word_counts[a:b]), pack_sorted(pairs[c:d]), pack(pair_counts[c:d]))
                       for k, (a, b, c, d) in enumerate(zip(by_word, by_word[1:], by_pair, by_pair[1:])) if b > a or d > c]
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), [
                    pa.int64(), pa.int32(), *[pa.binary()] * 4])], names=["block", "shard", "words", "word_counts", "pairs", "pair_counts"])

    return texts.select("block", "words", "ids", "lengths", "train").mapInArrow(run, (
        "block long, shard int, words binary, word_counts binary, pairs binary, pair_counts binary"))


def _total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For several sorted key lists, the sum of counts of each of their keys over all lists; and all sums, once per key."""
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(count[order], starts) if len(key) else np.zeros(0, np.int64)
    each = np.empty(len(key), np.int64)
    each[order] = np.repeat(sums, np.diff(np.append(starts, len(key))))
    return np.split(each, np.cumsum([len(k) for k in keys])[:-1]), sums


def _merge(table: pa.Table) -> pa.Table:
    """One shard: totals per block in the order of its keys, and in a row of block -1 what the word totals add up to."""
    shard = table.column("shard")[0].as_py()
    rows = table.drop_columns(["shard"]).to_pylist()
    words, sums = _total([unpack_sorted(r["words"]) for r in rows], [unpack(r["word_counts"], "<u4") for r in rows])
    pairs, _ = _total([unpack_sorted(r["pairs"]) for r in rows], [unpack(r["pair_counts"], "<u4") for r in rows])
    out = [(r["block"], shard, pack(w), pack(p), None, None, None) for r, w, p in zip(rows, words, pairs)]
    out.append((-1, shard, None, None, int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), [
        pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])],
        names=["block", "shard", "word_totals", "pair_totals", "v", "n1", "n2"])


class Automaton:
    """The part of the model that one block's texts can visit. Words are numbers; state -1 is the empty history."""

    def __init__(self, words, word_totals, pairs, pair_totals, before, after, n_tokens, v, n1, n2, prior):
        discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        discount = min(max(discount, 0.01), 0.99)
        unknown = discount * v / n_tokens if n_tokens else 1.0
        with np.errstate(divide="ignore"):
            single = np.where(word_totals > 0, (word_totals - discount) / max(n_tokens, 1), unknown)
        self.single = np.log10(single)
        history = word_totals.astype(np.float64)
        end = np.searchsorted(words, END)
        starts = float(word_totals[end])  # as many texts begin as end
        self.start = len(words) if starts else -1
        history = np.append(history, starts)
        self.is_state = history > 0
        self.failure = np.log10(prior / (history + prior))
        seen = pair_totals > 0
        self.arcs = pairs[seen]
        h = np.where(before[seen] < 0, len(words), before[seen])
        self.weights = np.log10((pair_totals[seen] + prior * single[after[seen]]) / (history[h] + prior))
        self.word_hash = np.append(words, START)

    def run(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text, all texts of the block advancing one word per step."""
        order = np.argsort(-lengths, kind="stable")
        left, at = lengths[order], (np.cumsum(lengths) - lengths)[order]
        state = np.full(len(order), self.start)
        score = np.zeros(len(order))
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, side="left"))
            word, now = ids[at[:n] + k], state[:n]
            gain = self.single[word]
            if len(self.arcs):
                live = np.flatnonzero(now >= 0)
                key = pair_hashes(self.word_hash[now[live]], self.word_hash[word[live]])
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[arc] == key
                gain[live] = np.where(hit, self.weights[arc], gain[live] + self.failure[now[live]])
            score[:n] += gain
            state[:n] = np.where(self.is_state[word], word, -1)
        out = np.empty(len(order))
        out[order] = score
        return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR,
          block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Words are split at ASCII white space, A-Z lower-cased; each text ends with one end token. NULL and
    empty texts are the end token alone. `train` says which rows the model learns from (NULL: not); repeated rows are
    counted and scored each. Without training rows each word costs nothing, as all are one unknown word. Words are
    told apart by 64-bit hashes, word pairs by 56-bit ones (`pair_hashes`). An empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = 1 << max(4, math.ceil(math.log2(max(size / shard_bytes, 1))))
    table = blocks(docs, id_col, text_col, train, block_bytes)
    totals = written(counts(table, shards).groupBy("shard").applyInArrow(
        _merge, "block long, shard int, word_totals binary, pair_totals binary, v long, n1 long, n2 long"), "lm-totals")
    v, n1, n2 = (x or 0 for x in totals.where("block = -1").agg(F.sum("v"), F.sum("n1"), F.sum("n2")).first())
    n_tokens = table.agg(F.sum("n_train")).first()[0] or 0
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(answers: pa.Table, texts: pa.Table) -> pa.Table:
        row = texts.select(["words", "ids", "doc_ids", "lengths", "train"]).to_pylist()[0]
        parts = sorted(answers.select(["shard", "word_totals", "pair_totals"]).to_pylist(), key=lambda r: r["shard"])
        words, ids, lengths = unpack_sorted(row["words"]), unpack(row["ids"], "<u4").astype(np.int64), np.array(row["lengths"])
        word_totals = np.concatenate([unpack(p["word_totals"], "<i8") for p in parts])
        pair_totals = np.concatenate([unpack(p["pair_totals"], "<i8") for p in parts])
        first = np.cumsum(lengths) - lengths
        pairs, at = np.unique(_with_history(words[ids], first), return_index=True)
        begins = np.zeros(len(ids), bool)
        begins[first] = True
        before = np.where(begins[at], -1, ids[at - 1])
        machine = Automaton(words, word_totals, pairs, pair_totals, before, ids[at], n_tokens, v, n1, n2, prior)
        base = np.log10((word_totals + 1) / (n_tokens + v + 1))
        return pa.table([
            texts.column("doc_ids").combine_chunks().flatten(), pa.array(row["train"], pa.bool_()), pa.array(lengths, pa.int64()),
            pa.array(np.add.reduceat((word_totals > 0)[ids].astype(np.int64), first)),
            pa.array(np.full(len(lengths), n_tokens, np.int64)), pa.array(np.add.reduceat(base[ids], first)),
            pa.array(machine.run(ids, lengths))],
            names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (totals.where("block >= 0").drop("v", "n1", "n2").groupBy("block")
            .cogroup(table.drop("n_train").groupBy("block"))
            .applyInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double"))
