"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over all texts.

Words are runs of ASCII letters and digits and all other bytes above 0x7F, lower-cased. A text is read once
per block of the benchmark: words that no benchmark item has cannot be in a window, so only
runs of known words are hashed, looked up, and compared word by word before they count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, spans_of, utf8
from ledgerloom.llm.tokens import NOT_ALPHANUMERIC, Words, mix, split_words

WINDOW_WORDS = 10
BLOCK_BYTES = 8 << 20  # benchmark text broadcast at a time
ITEMS_AT_ONCE = 2000
TEXT_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of the windows of n words that begin at the given words."""
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * _STEP + hashes[at + k]
    return mix(total)


class WindowSet:
    """All windows of some benchmark items, in flat arrays: the items' words, a vocabulary, and per window length the windows by hash.

    A window is kept as the number of its first word and the number of its item: about 40 bytes for each word of the benchmark.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items = [item for item, _ in items]
        parts, hashes, before = [], [np.zeros(0, np.uint64)], 0
        for at in range(0, len(items), ITEMS_AT_ONCE):  # the hashes of words need much memory for a moment
            texts = [text.encode() for _, text in items[at:at + ITEMS_AT_ONCE]]
            words = split_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), NOT_ALPHANUMERIC)
            hashes.append(words.hashes())
            parts.append((words.data, words.begin + before, words.end + before, np.diff(words.first)))
            before += len(words.data)
        data, begin, end, n_words = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (list(zip(*parts)) or [()] * 4))
        self.words = Words(data.astype(np.uint8), begin, end, np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64))
        hashes = np.concatenate(hashes)
        self.vocabulary = np.unique(hashes)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.minimum(n_words, window)
        for n in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == n)
            count = n_words[own] - n + 1
            at = np.repeat(self.words.first[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            found = _window_hashes(hashes, at, n)
            order = np.argsort(found, kind="stable")
            self.windows[n] = found[order], at[order], np.repeat(own, count)[order]

    def _items_of(self, n: int, first: int, last: int, text: bytes) -> set[str]:
        """Items of the windows with a hash that are this text, word by word."""
        _, at, item = self.windows[n]
        return {self.items[item[k]] for k in range(first, last) if self.words.joined(at[k], at[k] + n) == text}

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """First word, length and items of each window of the set within each of the texts."""
        if not len(self.vocabulary) or not len(words):
            return
        hashes = words.hashes()
        known = _contains(self.vocabulary, hashes)
        runs = np.concatenate([[0], np.cumsum(known)])
        text_end = np.repeat(words.first[1:], np.diff(words.first))
        seen: dict[bytes, set[str]] = {}
        for n, (wanted, _, _) in self.windows.items():
            at = np.arange(len(hashes) - n + 1)
            at = at[(runs[n:] - runs[:-n] == n) & (at + n <= text_end[:len(at)])] if len(at) else at
            mine = _window_hashes(hashes, at, n)
            hit = _contains(wanted, mine)
            at, mine = at[hit], mine[hit]
            for i, first, last in zip(at.tolist(), np.searchsorted(wanted, mine).tolist(), np.searchsorted(wanted, mine, "right").tolist()):
                text = words.joined(i, i + n)
                if text not in seen:
                    seen[text] = self._items_of(n, first, last, text)
                if seen[text]:
                    yield i, n, seen[text]


def _contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def window_sets(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[WindowSet]:
    """The benchmark in blocks of about `block_bytes` of text, so that none is too large to broadcast."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield WindowSet([(r.item if r.item is not None else "", r.text) for r in block.collect()], window)


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         benchmark_text_col: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
         marks: str = "__leak") -> DataFrame:
    """`docs` with a column `marks`: n_words, runs of hit words (begin, end) and the ids (as text) of items found.

    Rows stay where they are read: there is no shuffle and no join. NULL and empty texts have no words; an
    item without words matches nothing, one of fewer words than the window is one window. Items with equal
    windows are all found; overlapping hits are one run. Repeated rows are marked each. An empty benchmark
    marks nothing. `marks` must not be a column of `docs`.
    """
    small_batches(docs.sparkSession)
    kind = "struct<n_words: bigint, runs: array<struct<begin: bigint, end: bigint>>, items: array<string>>"
    out = docs.withColumn(marks, F.lit(None).cast(kind))
    index = docs.columns.index(text_col)
    for windows in window_sets(benchmark, item_col, benchmark_text_col, window, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _marked(batch, index, shared.value)], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out


def _marked(batch: pa.RecordBatch, index: int, windows: WindowSet) -> pa.Array:
    data, offsets = utf8(batch.column(index))
    before, result = batch.column(batch.num_columns - 1).to_pylist(), []
    for i, j in spans_of(offsets, TEXT_BYTES):
        words = split_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], NOT_ALPHANUMERIC)
        hit, items = np.zeros(len(words) + 1, bool), {}
        for at, n, found in windows.occurrences(words):
            hit[at:at + n] = True
            items.setdefault(int(np.searchsorted(words.first, at, side="right")) - 1, set()).update(found)
        for k in range(j - i):
            first, last = int(words.first[k]), int(words.first[k + 1])
            own, old = items.get(k, set()), before[i + k]
            for r in old["runs"] if old else ():
                hit[first + r["begin"]:first + r["end"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[first:last].view(np.int8), [0]]))) if own or old else []
            result.append({"n_words": last - first, "runs": [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])],
                           "items": sorted(own.union(old["items"] if old else ()))})
    return pa.array(result, batch.schema.field(batch.num_columns - 1).type)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as text) for every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = F.aggregate("__leak.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    return mark(narrow, benchmark, "text", **options).select(
        "doc_id", F.col("__leak.n_words").alias("n_words"), hits.alias("n_hit"), F.col("__leak.items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_hit_share: float = 0.0,
                      **options) -> DataFrame:
    """The rows of `docs` of whose words at most `max_hit_share` are hit, with their own columns."""
    hits = F.aggregate("__leak.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    marked = mark(docs, benchmark, text_col, **options)
    return marked.where(hits <= F.col("__leak.n_words") * max_hit_share).drop("__leak")


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of `docs` with the hit words, and what stands between them, cut out of the text."""
    marked, index = mark(docs, benchmark, text_col, **options), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column(index).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for k, found in enumerate(marks):
                if found["runs"]:
                    raw = texts[k].encode()
                    words = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_ALPHANUMERIC)
                    kept, at = [], 0
                    for r in found["runs"]:
                        kept.append(raw[at:int(words.begin[r["begin"]])])
                        at = int(words.end[r["end"] - 1])
                    texts[k] = b"".join([*kept, raw[at:]]).decode()
            columns = list(batch.columns[:-1])
            columns[index] = pa.array(texts, columns[index].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return marked.mapInArrow(run, docs.schema)
