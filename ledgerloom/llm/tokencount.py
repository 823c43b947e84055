"""Token counts of texts of any length, huge ones by overlap resynchronisation.

A text of up to a chunk is encoded as it is. A longer one is cut into chunks that overlap, which are encoded in different tasks, with
offsets. A tokenizer splits a text into pieces from left to right, looking a few characters ahead, and encodes each piece by itself. So
where in two neighbouring chunks a piece ends at the same place, well inside their overlap, both go on alike from there: the left
one is right up to that place and the right one from it on, and the counts are spliced there. A text with an overlap without such a place is
cut again with chunks and overlaps WIDER times as long, at last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import small_batches, spans_of, utf8, written, written_kinds
from ledgerloom.llm.tokens import range_hashes
from ledgerloom.llm.vocabulary import SentencePiece

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
WIDER = 8
GUARD = 64  # characters at both ends of an overlap in which no place counts: names of special tokens and lookaheads are shorter
JOINED_UNITS = 2048
CACHED_UNITS = 2_000_000  # units of one cache generation; two are kept
LIBRARY_BATCH = 64
TEXT_BYTES = 4 << 20

# Bytes that texts of plain Latin characters and spaces do not have; those of two bytes begin with 0xC2 (from U+00A1 on) to 0xC9 (to U+024F).
_ODD = np.ones(256, bool)
_ODD[[0x0A, 0x20]] = False
_ODD[0x21:0x7F] = _ODD[0x80:0xC0] = _ODD[0xC2:0xCA] = False


class JsonCounter:
    """Counts with a file of the tokenizers library; units of plain text seen before come from a cache.

    A unit is white space and what follows it up to the next: pieces never go on from a letter into white space. Units are told apart by
    64-bit hashes: two of ten million are mistaken for each other in one of 400,000 runs.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.longest = max([len(t.content) for t in added], default=0)
        self.cuttable = not any(t.lstrip or t.rstrip or any(c in t.content for c in " \n") for t in added)
        self.young, self.old = _Counts(), _Counts()

    def _whole(self, texts: list[str]) -> list[int]:
        out = []
        for k in range(0, len(texts), LIBRARY_BATCH):
            out += map(len, self.tokenizer.encode_batch_fast(texts[k:k + LIBRARY_BATCH], add_special_tokens=False))
        return out

    def _learn(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit."""
        out = np.zeros(len(units), np.int64)
        alone = np.array([u[0] not in " \n" or u[-1] in " \n" for u in units], bool)  # would run into the unit beside it
        out[alone] = self._whole([units[k] for k in np.flatnonzero(alone).tolist()])
        joined = np.flatnonzero(~alone)
        for k in range(0, len(joined), JOINED_UNITS):
            part = [units[i] for i in joined[k:k + JOINED_UNITS].tolist()]
            starts = np.cumsum([0, *map(len, part)])
            found = self.tokenizer.encode("".join(part), add_special_tokens=False)
            # A token may begin before or behind the space of its word; it ends in its unit in any case.
            ends = np.array([end for _, end in found.offsets], np.int64)
            out[joined[k:k + JOINED_UNITS]] = np.diff(np.searchsorted(ends, starts, "right"))
        return out

    def _tokens(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the units from begin to end - 1."""
        hashes, where, unit = np.unique(range_hashes(data, begin, end), return_index=True, return_inverse=True)
        missing = np.flatnonzero(~self.young.find(hashes)[1])
        if len(missing) and len(self.young.keys) + len(missing) > CACHED_UNITS:
            self.old, self.young, missing = self.young, _Counts(), np.arange(len(hashes))
        at, kept = self.old.find(hashes[missing])
        self.young.add(hashes[missing[kept]], self.old.counts[at[kept]])
        missing = missing[~kept]
        if len(missing):
            raw = data.tobytes()
            units = [raw[a:b].decode() for a, b in zip(begin[where[missing]].tolist(), end[where[missing]].tolist())]
            self.young.add(hashes[missing], self._learn(units))
        return self.young.counts[self.young.find(hashes)[0]][unit]

    @staticmethod
    def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of each unit; which texts are plain."""
        first, last = offsets[:-1], offsets[1:]
        after = np.append(data[1:], np.uint8(0))
        odd = _ODD[data] | ((data == 0xC2) & (after < 0xA1)) | ((data == 0xC9) & (after > 0x8F))
        counts = np.concatenate([[0], np.cumsum(odd)])
        blank = (data == 32) | (data == 10)
        starts = np.zeros(len(data), bool)
        starts[1:] = blank[1:] & ~blank[:-1]
        starts[first[first < last]] = True
        begin = np.flatnonzero(starts)
        return begin, np.append(begin[1:], len(data)), np.searchsorted(last, begin, side="right"), counts[last] == counts[first]

    def counts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        data, offsets = utf8(column)
        for i, j in spans_of(offsets, TEXT_BYTES):
            part, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            begin, end, text_of, plain = self._units(part, cuts)
            plain &= self.cuttable
            kept = plain[text_of]
            n = self._tokens(part, begin[kept], end[kept])
            out[i:j] = np.bincount(text_of[kept], weights=n, minlength=j - i)
            whole = np.flatnonzero(~plain)
            out[i + whole] = self._whole([part[cuts[k]:cuts[k + 1]].tobytes().decode() for k in whole.tolist()])
        return out

    def pieces(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text its number of tokens; places in it where a piece ends, and how many tokens lie before each.

        Of plain text these are the ends of its units.
        """
        data, offsets = utf8(column)
        for i, j in spans_of(offsets, TEXT_BYTES):
            part, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            begin, end, text_of, plain = self._units(part, cuts)
            plain &= self.cuttable
            kept = plain[text_of]
            end, text_of, n = end[kept], text_of[kept], self._tokens(part, begin[kept], end[kept])
            own = np.searchsorted(text_of, np.arange(j - i + 1))
            characters = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            for k in range(j - i):
                if plain[k]:
                    before = np.concatenate([[0], np.cumsum(n[own[k]:own[k + 1]])])
                    yield int(before[-1]), characters[end[own[k]:own[k + 1]][:-1]] - characters[cuts[k]], before[1:-1]
                else:
                    yield self._pieces(part[cuts[k]:cuts[k + 1]].tobytes().decode())

    def _pieces(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        end = np.array([e for _, e in found.offsets], np.int64)
        word = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        new = np.flatnonzero((word[1:] != word[:-1]) | (word[1:] < 0)) + 1
        return len(end), end[new - 1], new


class _Counts:
    """Tokens of units, by sorted hashes."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Hashes that are not there yet, ascending."""
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.counts = np.insert(self.keys, at, hashes), np.insert(self.counts, at, counts)


class PieceCounter:
    """Counts with a file of the sentencepiece library whose pieces have spaces only in front."""

    longest = 0

    def __init__(self, path: str):
        self.codec = SentencePiece(path)

    def counts(self, column: pa.Array) -> np.ndarray:
        return np.array([len(ids) for ids in self.codec.model.encode(column.to_pylist(), num_threads=1)], np.int64)

    def pieces(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        return map(self._pieces, column.to_pylist())

    def _pieces(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """As in JsonCounter; a piece ends before a run of spaces, as no token goes on from another character into one."""
        ids, spelt = self.codec.encode([text])[0], (" " + text).encode()
        none = np.zeros(0, np.int64)
        if not self.codec.cuttable or b"".join([self.codec.token_bytes[i] for i in ids.tolist()]) != spelt:
            return len(ids), none, none
        raw = np.frombuffer(spelt, np.uint8)
        sizes = self.codec.sizes[ids]
        begin = np.cumsum(sizes) - sizes
        new = np.flatnonzero((begin > 1) & (raw[begin] == 32) & (raw[begin - 1] != 32))
        characters = np.cumsum((raw & 0xC0) != 0x80)  # up to and with the one that each byte belongs to
        return len(ids), characters[begin[new]] - 2, new


_opened: dict[str, JsonCounter | PieceCounter] = {}


def counter(path: str) -> JsonCounter | PieceCounter:
    """The worker's counter of a file, with what earlier tasks of the worker have put in its cache."""
    if path not in _opened:
        _opened[path] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _opened[path]


def _cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str, bool]]:
    """number, begin, text with the overlap behind it, whether it is the last."""
    for k, begin in enumerate(range(0, len(text), chunk)):
        last = begin + chunk + overlap >= len(text)
        yield k, begin, text[begin:] if last else text[begin:begin + chunk + overlap], last
        if last:
            return


_CHUNK = "key long, k int, begin long, part string, last boolean"


def _first_pass(docs: DataFrame, tokenizer: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """A row per text (key, doc_id, n_bytes, n_tokens of short ones) and a row per chunk of a long one, written in one pass."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = counter(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            long = pc.greater(pc.utf8_length(batch.column(1)), chunk + overlap)
            n, is_long = batch.num_rows, long.to_numpy(zero_copy_only=False)
            found = np.zeros(n, np.int64)
            found[~is_long] = own.counts(batch.column(1).filter(pc.invert(long)))
            keys = list(range(key, key + n))
            key += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), batch.column(0), batch.column(2), pa.array(found, mask=is_long),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())],
                names=["key", "doc_id", "n_bytes", "n_tokens", "k", "begin", "part", "last"])
            for at in np.flatnonzero(is_long).tolist():
                name = keys[at]
                for k, begin, part, last in _cut(batch.column(1)[at].as_py(), chunk, overlap):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.int64()), pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                         pa.array([k], pa.int32()), pa.array([begin], pa.int64()), pa.array([part], pa.string()), pa.array([last])],
                        names=["key", "doc_id", "n_bytes", "n_tokens", "k", "begin", "part", "last"])

    found = docs.mapInArrow(run, f"key long, doc_id {kind}, n_bytes long, n_tokens long, k int, begin long, part string, last boolean")
    rows, chunks = written_kinds(found, F.col("k").isNull(), "token-chunks")
    return rows.select("key", "doc_id", "n_bytes", "n_tokens"), chunks.drop("doc_id", "n_bytes", "n_tokens")


def _encoded(chunks: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """key, k, last, n, and where pieces end in the overlap before and behind: `heads` and `tails` (place, tokens before it), written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        guard = max(GUARD, own.longest)
        kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            rows = []
            names = (batch.column(c).to_pylist() for c in (0, 1, 2, 4))
            for key, k, begin, last, (n, places, before) in zip(*names, own.pieces(batch.column(3))):

                def inside(left: int) -> list[dict]:
                    i, j = np.searchsorted(places, [left + guard, left + overlap - guard])
                    return [{"at": begin + a, "before": b} for a, b in zip(places[i:j].tolist(), before[i:j].tolist())]

                rows.append((key, k, last, n, inside(0) if k else [], [] if last else inside(chunk)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [
                pa.int64(), pa.int32(), pa.bool_(), pa.int64(), kind, kind])], names=["key", "k", "last", "n", "heads", "tails"])

    marks = "array<struct<at: bigint, before: bigint>>"
    found = (chunks.select("key", "k", "begin", "part", "last").hint("rebalance")
             .mapInArrow(run, f"key long, k int, last boolean, n long, heads {marks}, tails {marks}"))
    return written(found, "token-chunk-counts")


def _spliced(parts: DataFrame) -> DataFrame:
    """key, n_tokens: NULL if two neighbouring chunks of the text end no piece at the same place in their overlap."""
    right = parts.where("k > 0").select("key", (F.col("k") - 1).alias("k"), "heads")
    seams = parts.drop("heads").join(right, ["key", "k"], "left")
    common = F.array_intersect(F.transform("tails", lambda t: t["at"]), F.transform("heads", lambda t: t["at"]))
    seams = seams.withColumn("at", F.try_element_at(common, F.lit(1)))

    def before(marks: str):
        return F.filter(marks, lambda t: t["at"] == F.col("at"))[0]["before"]

    # The chunk's tokens up to the place, less those that the right chunk has before it.
    part = F.when(F.col("last"), F.col("n")).otherwise(F.when(F.col("at").isNotNull(), before("tails") - before("heads")))
    return (seams.select("key", part.alias("part")).groupBy("key")
            .agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens")))


def _wider(chunks: DataFrame, keys: DataFrame, old_chunk: int, chunk: int, overlap: int) -> DataFrame:
    """The texts of some keys, cut again into longer chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(key, *row) for row in _cut(text, chunk, overlap)]
                for i in range(0, len(rows), 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 16]), [
                        pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()])], names=["key", "k", "begin", "part", "last"])

    own = F.when(F.col("last"), F.col("part")).otherwise(F.substring("part", 1, old_chunk))
    texts = (chunks.join(keys, "key", "left_semi").select("key", F.struct("k", own.alias("own")).alias("p"))
             .groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["own"]), "").alias("text")))
    return written(texts.mapInArrow(run, _CHUNK), "token-chunks")


def report(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of `docs`.

    `tokenizer` is a file that each worker can read, of the tokenizers library (.json) or of sentencepiece (.model); no begin,
    end or other special tokens are put in, names of special tokens in a text are read as the library does, and nothing is
    truncated. NULL and empty texts have no tokens. Repeated rows and ids are counted each. The chunks of a huge text go to different
    tasks; one without a place to splice at is put together again, which needs the memory of a cell. An empty table gives no rows.
    """
    if overlap_chars <= 2 * GUARD or overlap_chars > chunk_chars // 2:
        raise ValueError(f"an overlap must have more than {2 * GUARD} characters, and at most half of a chunk")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, chunks = _first_pass(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")),
                               tokenizer, chunk_chars, overlap_chars)
    chunk, overlap, done = chunk_chars, overlap_chars, None
    while True:
        found = written(_spliced(_encoded(chunks, tokenizer, chunk, overlap)), "token-spliced")
        good = found.where("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = found.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        chunks = _wider(chunks, failed, chunk, chunk * WIDER, overlap * WIDER)
        chunk, overlap = chunk * WIDER, overlap * WIDER
    short = rows.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens")
    long = rows.where("n_tokens IS NULL").select("key", "doc_id", "n_bytes").join(done, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
