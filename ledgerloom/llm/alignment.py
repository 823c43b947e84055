"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both token sequences of a text are arrays of byte ends. As long as entry i of one equals entry i + d of the other, tokens
correspond one to one along the diagonal d. The run is probed in steps of 1, 2, 4 ... entries, compared as slices; the first
difference ends it. There the side that is behind advances until the ends meet again: an irregular group, after which
the diagonal d has changed and probing starts anew. All texts of a batch advance together, one probe a step.

Which tokens correspond is counted over the corpus. A block of texts lists its distinct linked id pairs with the number of texts
that hold them; these rows are summed by pair, and the sums come back to the blocks that have the pair. A pair is one
row per block at most, so no pair, however common, makes a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, spans_of, utf8, written, written_kinds
from ledgerloom.llm.vocabulary import Encoders

BLOCK_BYTES = 24 << 20  # text of one block
PIECE_BYTES, PIECE_TEXTS = 2 << 20, 1 << 16  # aligned at once


def aligned(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token of a, and of b, ends where one of the other ends. `first` has where each text's tokens begin, and the end."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    lane = np.flatnonzero(np.diff(first_a) > 0)
    i, stop_a = first_a[:-1][lane], first_a[1:][lane]
    j, stop_b = first_b[:-1][lane], first_b[1:][lane]
    step = np.ones(len(lane), np.int64)
    while len(i):
        n = np.minimum(step, np.minimum(stop_a - i, stop_b - j))
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum()))
        at_a, at_b = place + np.repeat(i - before, n), place + np.repeat(j - before, n)
        differs = np.flatnonzero(ends_a[at_a] != ends_b[at_b])
        run = n.copy()
        if len(differs):
            of = np.searchsorted(before, differs, "right") - 1
            run[of[::-1]] = (differs - before[of])[::-1]  # the first of each lane is written last
        same = place < np.repeat(before + run, n)
        cut_a[at_a[same]] = True
        cut_b[at_b[same]] = True
        i, j = i + run, j + run
        broken = np.flatnonzero(run < n)
        step = step * 2
        step[broken] = 1
        x, y = i[broken], j[broken]
        open_ = np.arange(len(broken))
        while len(open_):
            end_a, end_b = ends_a[x[open_]], ends_b[y[open_]]
            x[open_] += end_a < end_b
            y[open_] += end_b < end_a
            open_ = open_[end_a != end_b]
        cut_a[x] = True
        cut_b[y] = True
        i[broken], j[broken] = x + 1, y + 1
        live = i < stop_a
        if not live.all():
            i, j, stop_a, stop_b, step = i[live], j[live], stop_a[live], stop_b[live], step[live]
    return cut_a, cut_b


def _digits(n: int) -> np.ndarray:
    """Decimal digits of the numbers below n as bytes, 0 in front of short ones, and a column for a separator."""
    width = len(str(max(n - 1, 0)))
    return np.array([list(str(k).rjust(width, "\0").encode()) + [0] for k in range(n)], np.uint8)


class _Piece:
    """Some texts with their tokens, aligned."""

    def __init__(self, encoders: Encoders, texts: pa.Array):
        found = encoders.encode_column(texts)
        self.ids = [ids for ids, _ in found]
        self.first = [np.concatenate([[0], np.cumsum(lengths)]) for _, lengths in found]
        self.ends = [np.cumsum(codec.sizes[x]) for codec, x in zip(encoders.codecs, self.ids)]
        self.cut = aligned(*self.ends, *self.first)

    def n_groups(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.cut[0])])
        return np.diff(sums[self.first[0]])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of overlapping tokens, their ids, and their texts: one pair for each end of either side."""
        a, b = self.ids
        over = np.searchsorted(self.ends[1], self.ends[0])  # token of b that covers the last byte of each token of a
        inner = np.flatnonzero(~self.cut[1])
        under = np.searchsorted(self.ends[0], self.ends[1][inner])
        text_of = np.repeat(np.arange(len(self.first[0]) - 1), np.diff(self.first[0]))
        return (np.concatenate([a, a[under]]).astype(np.int64), np.concatenate([b[over], b[inner]]).astype(np.int64),
                np.concatenate([text_of, text_of[under]]))

    def spelt(self, digits: list[np.ndarray]) -> list[bytes]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        a, b = self.ids
        group_end_a, group_end_b = np.flatnonzero(self.cut[0]) + 1, np.flatnonzero(self.cut[1]) + 1
        # In each group come the tokens of a, then those of b.
        group_a = np.cumsum(self.cut[0]) - self.cut[0]
        group_b = np.cumsum(self.cut[1]) - self.cut[1]
        place_a = np.arange(len(a)) + np.concatenate([[0], group_end_b])[group_a]
        place_b = np.arange(len(b)) + group_end_a[group_b]
        width = max(d.shape[1] for d in digits)
        text = np.zeros((len(a) + len(b), width), np.uint8)
        text[place_a, width - digits[0].shape[1]:] = digits[0][a]
        text[place_b, width - digits[1].shape[1]:] = digits[1][b]
        text[place_a, -1] = np.where(self.cut[0], ord("|"), ord(","))
        text[place_b, -1] = np.where(self.cut[1], ord(";"), ord(","))
        flat = text.reshape(-1)
        used = flat != 0
        sizes = np.concatenate([[0], np.cumsum(used.reshape(-1, width).sum(axis=1))])
        data = flat[used].tobytes()
        cuts = sizes[self.first[0] + self.first[1]].tolist()
        return [data[i:j - 1] if j > i else b"" for i, j in zip(cuts[:-1], cuts[1:])]


_written_digits: dict[int, np.ndarray] = {}


def _digits_of(n: int) -> np.ndarray:
    if n not in _written_digits:
        _written_digits[n] = _digits(n)
    return _written_digits[n]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class _Block:
    """Texts up to the size of a block: what is known of each, and which pair is linked in which text how often."""

    def __init__(self):
        self.ids: list = []
        self.rows: list[tuple] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list, encoders: Encoders, texts: pa.Array) -> None:
        piece = _Piece(encoders, texts)
        n_a, n_b, n_groups = np.diff(piece.first[0]), np.diff(piece.first[1]), piece.n_groups()
        spelt = piece.spelt([_digits_of(len(c.sizes)) for c in encoders.codecs])
        for row in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), spelt):
            self.rows.append((*row[:3], hashlib.sha256(row[3]).hexdigest() if row[0] else ""))
        a, b, of = piece.links()
        n_b, n_texts = len(encoders.codecs[1].sizes), len(ids)  # a pair and a text as one number: far below 2 ** 63 for any vocabulary
        found, times = np.unique((a * n_b + b) * n_texts + of, return_counts=True)
        pairs = found // n_texts
        self.pairs.append(((pairs // n_b << 32 | pairs % n_b), (found % n_texts + len(self.ids)).astype("<u4"), times.astype("<u4")))
        self.ids += ids

    def closed(self) -> tuple[tuple, np.ndarray, np.ndarray]:
        """The block's row; its distinct pairs, ascending, and how many texts hold each."""
        pairs, of, times = (np.concatenate(x) for x in zip(*self.pairs))
        order = np.argsort(pairs, kind="stable")
        pairs, of, times = pairs[order], of[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        held = np.diff(np.append(starts, len(pairs))).astype("<u4")
        rows = list(zip(*self.rows))
        return (self.ids, *rows, _pack(held), _pack(of), _pack(times)), pairs[starts], held


_BLOCK = "n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, held binary, texts binary, times binary"


def blocks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Two tables, written in one pass: a block's texts with their links, and the distinct pairs of each block."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, name, block, id_type = Encoders.shared(tokenizer_a, tokenizer_b), TaskContext.get().partitionId() << 32, _Block(), None
        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal name, block
            row, pairs, held = block.closed()
            types = [pa.list_(id_type), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), *[pa.binary()] * 3]
            names = ["doc_ids", *[f.split()[0] for f in _BLOCK.split(", ")]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.array([x], t) for x, t in zip(row, types)]],
                names=["block", "pair", "n", *names])
            for k in range(0, len(pairs), 1 << 16):
                part = pairs[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), name)), pa.array(part), pa.array(held[k:k + (1 << 16)].astype(np.int64)),
                     *[pa.nulls(len(part), t) for t in types]], names=["block", "pair", "n", *names])
            name, block = name + 1, _Block()

        ids, texts, size = [], [], 0

        def added() -> None:
            nonlocal ids, texts, size
            block.add(ids, encoders, pa.concat_arrays(texts))
            block.size += size
            ids, texts, size = [], [], 0

        for batch in batches:
            id_type, offsets = batch.column(0).type, utf8(batch.column(1))[1]
            for i, j in spans_of(offsets, PIECE_BYTES):
                ids += batch.column(0)[i:j].to_pylist()
                texts.append(batch.column(1)[i:j])
                size += int(offsets[j] - offsets[i])
                if size >= PIECE_BYTES or len(ids) >= PIECE_TEXTS:
                    added()
                    if block.size >= block_bytes:
                        yield from closed()
        if ids:
            added()
        if block.ids:
            yield from closed()

    found = narrow.mapInArrow(run, f"block long, pair long, n long, doc_ids array<{kind}>, {_BLOCK}")
    texts, pairs = written_kinds(found, F.col("pair").isNull(), "align-blocks")
    return texts.drop("pair", "n"), pairs.select("block", "pair", "n")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair (a << 32 | b), count (texts that link it), best (no other pair of its a counts more)."""
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts").withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def report(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    `tokenizer_a` and `tokenizer_b` are files that each worker can read: byte-level ones of the tokenizers library (.json) over
    a space and the text, or of sentencepiece (.model), which puts the space itself. NULL and empty texts, and those that a
    tokenizer changes (whose token bytes are not the text), have no tokens: zeros and an empty digest. A text is never
    cut for the tokenizers, and its links are one entry per distinct pair. Equal rows, and rows of one id, are
    texts each. A pair's count is the number of texts that link it at least once. An empty table gives no rows.
    """
    table, pairs = blocks(docs, tokenizer_a, tokenizer_b, id_col, text_col, block_bytes)
    answers = pairs.select("block", "pair").join(pair_counts(pairs), "pair")
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(sums: pa.Table, texts: pa.Table) -> pa.Table:
        row = texts.select(["doc_ids", *[f.split()[0] for f in _BLOCK.split(", ")]]).combine_chunks()
        get = {c: row.column(c)[0] for c in row.column_names}
        n = len(get["doc_ids"])
        order = np.argsort(sums.column("pair").to_numpy())
        held, of, times = (_unpack(get[c].as_py(), "<u4").astype(np.int64) for c in ("held", "texts", "times"))
        count, best = sums.column("count").to_numpy()[order], sums.column("best").to_numpy()[order]
        # Sums of counts can be long: whole numbers, not the doubles of a weighted bincount.
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(n + 1))

        def per_text(values: np.ndarray) -> np.ndarray:
            sums_ = np.concatenate([[0], np.cumsum((np.repeat(values, held) * times)[order])])
            return np.diff(sums_[starts])

        n_links = per_text(np.ones(len(held), np.int64))
        return pa.table([get["doc_ids"].values, get["n_a"].values, get["n_b"].values, get["n_groups"].values, pa.array(n_links),
                         pa.array(per_text(best.astype(np.int64))), pa.array(per_text(count)), get["groups_sha256"].values],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return (answers.groupBy("block").cogroup(table.groupBy("block"))
            .applyInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
