"""Token ids in binary files, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned and sorted by id, encoded, and gathered into shards of about a million ids. In each
shard, frequent pairs of neighbouring ids are replaced by new symbols, round by round, until no pair is frequent. A round takes many
pairs at once: no symbol may be both a left and a right end of its pairs, so their occurrences cannot overlap; a pair
of equal symbols stands alone, and in a run of them every second occurrence is replaced. The file
holds the rules, the expansion length of each symbol, the remaining sequence and the ids per document;
a range of ids is read by expanding only the symbols that cover it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ledgerloom.llm.common import new_path, small_batches, spans_of, utf8
from ledgerloom.llm.tokens import range_hashes
from ledgerloom.llm.vocabulary import ByteLevel

END_ID = 0
SHARD_IDS = 1 << 20
MIN_COUNT = 16  # occurrences of a pair in a shard that make a rule; a pair of equal symbols counts its overlaps
CACHED_UNITS = 2_000_000  # units of one cache generation; two are kept
POOL_IDS = 1 << 24  # ids that a generation holds before a new one begins
JOINED_UNITS = 2048  # units that the library encodes as one text
TEXT_BYTES = 4 << 20  # of text encoded at once
LIBRARY_BATCH = 64  # whole texts that the library encodes at once: its results are large
MAGIC = b"RPG1"

_BLANK = np.zeros(256, bool)
_BLANK[list(b" \n\r\t")] = True
# Bytes that texts of plain Latin characters do not have; those of two bytes begin with 0xC2 (from U+00A1 on) to 0xC9 (to U+024F).
_ODD = np.ones(256, bool)
_ODD[list(b" \n\r\t")] = False
_ODD[0x21:0x7F] = _ODD[0x80:0xC0] = _ODD[0xC2:0xCA] = False


_encoders: dict[str, "Encoder"] = {}


class _Generation:
    """Ids of units by their hash: sorted hashes, and where the ids of each lie in the pool."""

    def __init__(self):
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def put(self, ids: np.ndarray) -> int:
        """Where the pool now has these ids."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(self.pool), len(ids)), "<u4")])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Hashes that it does not have yet, in any order."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.begin, self.size = (np.insert(x, at, y[order]) for x, y in (
            (self.keys, hashes), (self.begin, begin), (self.size, size)))


class Encoder:
    """Encodes texts with a byte-level tokenizer file of the tokenizers library; units seen before come from a cache.

    A unit is white space and what follows it up to the next: the tokenizer begins a new piece at each run of white space. Only texts of
    plain Latin characters are cut into units here; any other text, and one in which the name of a special token
    may stand, is encoded by the library as a whole. New units are encoded as one joined text and cut again by the byte lengths of
    their tokens. Units are told apart by 64-bit hashes: two of ten million are mistaken for each other in one of 400,000 runs.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sizes = ByteLevel(path).sizes
        self.young, self.old = _Generation(), _Generation()

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        """The worker's encoder of a file, with what earlier tasks of the worker have put in its cache."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), LIBRARY_BATCH):
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[i:i + LIBRARY_BATCH], add_special_tokens=False)]
        return out

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Ids of units (bytes begin to end - 1 of data) that no generation has."""
        raw = data.tobytes()
        alone = ~_BLANK[data[begin]] | _BLANK[data[end - 1]]  # would run into the unit beside it
        at, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        lone = np.flatnonzero(alone)
        for k, ids in zip(lone.tolist(), self._whole([raw[a:b].decode() for a, b in zip(begin[lone].tolist(), end[lone].tolist())])):
            at[k], size[k] = self.young.put(ids), len(ids)
        joined = np.flatnonzero(~alone)
        for k in range(0, len(joined), JOINED_UNITS):
            part = joined[k:k + JOINED_UNITS]
            text = b"".join([raw[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist())])
            ids = self._whole([text.decode()])[0]
            cuts = np.concatenate([[0], np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(end[part] - begin[part])) + 1])
            at[part], size[part] = self.young.put(ids) + cuts[:-1], np.diff(cuts)
        self.young.add(hashes, at, size)

    def _know(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Have distinct units in the younger generation; the older one is what was in use before it was full."""
        missing = np.flatnonzero(~self.young.find(hashes)[1])
        if len(missing) and len(self.young.keys) + len(missing) > CACHED_UNITS:
            self.old, self.young, missing = self.young, _Generation(), np.arange(len(hashes))
        at, kept = self.old.find(hashes[missing])
        at, again = at[kept], missing[kept]
        if len(again):
            size = self.old.size[at]
            place = np.repeat(self.old.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            start = self.young.put(self.old.pool[place])
            self.young.add(hashes[again], start + np.cumsum(size) - size, size)
        missing = missing[~kept]
        if len(missing):
            self._learn(data, begin[missing], end[missing], hashes[missing])

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, each with `end_id` after it if there is one, and how many each text has."""
        data, offsets = utf8(column)
        n, first, last = len(offsets) - 1, offsets[:-1], offsets[1:]
        after = np.append(data[1:], np.uint8(0))
        odd = _ODD[data] | ((data == 0xC2) & (after < 0xA1)) | ((data == 0xC9) & (after > 0x8F))
        counts = np.concatenate([[0], np.cumsum(odd)])
        whole = counts[last] > counts[first]
        raw = data.tobytes() if len(data) else b""
        for name in self.special:
            at = raw.find(name)
            while at >= 0:  # also one that reaches over two texts: both are encoded whole
                whole[np.searchsorted(last, [at, at + len(name) - 1], side="right").clip(0, max(n - 1, 0))] = True
                at = raw.find(name, at + 1)
        blank = _BLANK[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = blank[1:] & ~blank[:-1]
        starts[first[first < last]] = True
        begin = np.flatnonzero(starts[:-1])
        text_of = np.searchsorted(last, begin, side="right")
        end = np.append(begin[1:], len(data))
        plain = ~whole[text_of]
        begin, end, text_of = begin[plain], end[plain], text_of[plain]
        hashes = range_hashes(data, begin, end)
        distinct, where, unit = np.unique(hashes, return_index=True, return_inverse=True)
        self._know(data, begin[where], end[where], distinct)
        young = self.young
        slot = young.find(distinct)[0]
        at, size = young.begin[slot][unit], young.size[slot][unit]
        extra_at, extra_size, extra_of = [], [], []
        lone = np.flatnonzero(whole)
        for k, ids in zip(lone.tolist(), self._whole([raw[a:b].decode() for a, b in zip(first[lone].tolist(), last[lone].tolist())])):
            extra_at.append(young.put(ids))
            extra_size.append(len(ids))
            extra_of.append(k)
        if end_id is not None:
            extra_at += [young.put(np.array([end_id], "<u4"))] * n
            extra_size += [1] * n
            extra_of += range(n)
        at, size = np.concatenate([at, np.array(extra_at, np.int64)]), np.concatenate([size, np.array(extra_size, np.int64)])
        text_of = np.concatenate([text_of, np.array(extra_of, np.int64)])
        order = np.argsort(text_of, kind="stable")
        at, size, text_of = at[order], size[order], text_of[order]
        place = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ids, lengths = young.pool[place], np.bincount(text_of, weights=size, minlength=n).astype(np.int64)
        if young.used > POOL_IDS:  # whole texts and end ids stay in the pool: begin anew now and then
            self.old, self.young = self.young, _Generation()
        return ids, lengths

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        ids, lengths = self.encode_column(pa.array(texts, pa.string()))
        cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _pair_keys(seq: np.ndarray, n_symbols: int) -> tuple[np.ndarray, int]:
    """Each pair of neighbours as one number, as narrow as the symbols allow, and the bits of its right end."""
    bits, kind = (16, np.uint32) if n_symbols <= 1 << 16 else (32, np.uint64)
    return seq[:-1].astype(kind) << kind(bits) | seq[1:].astype(kind), bits


def _chosen_pairs(seq: np.ndarray, n_symbols: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs to replace in a round, most frequent first: keys in order, and which symbols are left and right ends."""
    left, right = np.zeros(n_symbols, bool), np.zeros(n_symbols, bool)
    every, bits = _pair_keys(seq, n_symbols)
    ordered = np.sort(every)
    keys = np.unique(ordered[min_count - 1:][ordered[min_count - 1:] == ordered[:len(ordered) - min_count + 1]]) if len(ordered) >= min_count else ordered[:0]
    counts = np.searchsorted(ordered, keys, "right") - np.searchsorted(ordered, keys)
    mask = (1 << bits) - 1
    kept = []
    for key in keys[np.argsort(-counts, kind="stable")].tolist():
        a, b = key >> bits, key & mask
        if a != b and not right[a] and not left[b] or a == b and not left[a] and not right[a]:
            left[a] = right[b] = True
            kept.append(key)
    return np.array(sorted(kept), every.dtype), left, right


def _apart(at: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which occurrences to replace: of those of a pair of equal symbols, which overlap in a run, every second one."""
    first = np.ones(len(at), bool)
    first[1:] = ~equal[1:] | ~equal[:-1] | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(first)
    return (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0


def compress(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[int, np.ndarray, np.ndarray]:
    """First new symbol, rules (left, right) in order of their symbols, and the remaining sequence, in which no pair occurs `min_count` times."""
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    n = base
    while len(seq) > 1:
        keys, left, right = _chosen_pairs(seq, n, min_count)
        if not len(keys):
            break
        at = np.flatnonzero(left[seq[:-1]] & right[seq[1:]])
        every, bits = _pair_keys(seq, n)
        pair = every[at]
        rule = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[rule] == pair
        at, rule = at[hit], rule[hit]
        hit = _apart(at, seq[at] == seq[at + 1])
        at, rule = at[hit], rule[hit]
        seq[at] = (n + rule).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([keys >> keys.dtype.type(bits), keys & keys.dtype.type((1 << bits) - 1)], axis=1).astype("<u4"))
        n += len(keys)
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), "<u4"), seq


def to_file(ids: np.ndarray, lengths: np.ndarray, **options) -> bytes:
    """The content of one shard file: ids of its documents one behind the other, and how many each has."""
    base, rules, seq = compress(ids, **options)
    expansion = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        expansion[base + k] = expansion[a] + expansion[b]
    narrow = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    parts = [rules.astype("<u4"), expansion[base:].astype("<u4"), seq.astype(narrow), lengths.astype("<u4")]
    packed = [zstandard.compress(p.tobytes(), 1) for p in parts]
    head = struct.pack("<4sIIIQ", MAGIC, len(lengths), base, int(narrow[-1]), len(ids))
    return b"".join([head, struct.pack("<4I", *map(len, packed)), *packed])


class ShardFile:
    """A shard file opened for reading."""

    def __init__(self, content: bytes):
        magic, self.n_docs, self.base, width, self.n_ids = struct.unpack_from("<4sIIIQ", content)
        if magic != MAGIC:
            raise ValueError("not a shard file of token ids")
        sizes, at, parts = struct.unpack_from("<4I", content, 24), 40, []
        for size, kind in zip(sizes, ("<u4", "<u4", f"<u{width}", "<u4")):
            parts.append(np.frombuffer(zstandard.decompress(content[at:at + size]), kind))
            at += size
        self.rules, expansion, seq, self.lengths = parts[0].reshape(-1, 2), parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(expansion)])
        self.flat, self.flat_start = np.zeros(starts[-1], "<u4"), starts[:-1]
        for k, pair in enumerate(self.rules.tolist()):
            at = starts[k]
            for s in pair:
                if s < self.base:
                    self.flat[at] = s
                    at += 1
                else:
                    i, n = starts[s - self.base], expansion[s - self.base]
                    self.flat[at:at + n] = self.flat[i:i + n]
                    at += n
        self.seq = seq
        self.size = np.ones(len(seq), np.int64)
        new = seq >= self.base
        self.size[new] = expansion[seq[new] - self.base]
        self.start = np.cumsum(self.size) - self.size

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from begin to end - 1, from the symbols that cover them."""
        end = self.n_ids if end is None else end
        if end <= begin:
            return np.zeros(0, "<u4")
        i, j = int(np.searchsorted(self.start, begin, "right")) - 1, int(np.searchsorted(self.start, end, "left"))
        seq, size = self.seq[i:j], self.size[i:j]
        place = self.start[i:j] - self.start[i]
        out = np.empty(int(size.sum()), "<u4")
        new = seq >= self.base
        out[place[~new]] = seq[~new]
        n = size[new]
        source = np.repeat(self.flat_start[seq[new] - self.base] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        target = np.repeat(place[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[target] = self.flat[source]
        return out[begin - self.start[i]:end - self.start[i]]

    def document(self, k: int) -> np.ndarray:
        before = int(self.lengths[:k].sum())
        return self.ids(before, before + int(self.lengths[k]))


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          shard_ids: int = SHARD_IDS, **options) -> None:
    """The ids of all texts, `end_id` after each, as the shard table at `path`: part, shard, doc_ids, n_ids, content.

    Parts and the shards in them are in ascending order of the document ids (NULL first, equal ids by text). NULL
    and empty texts are the end id alone. `tokenizer` is a file of the tokenizers library that each worker can read.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard, id_type = Encoder.shared(tokenizer), TaskContext.get().partitionId(), 0, None
        names, ids, lengths, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            content = to_file(np.concatenate(ids), np.concatenate(lengths), **options)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([names], pa.list_(id_type)),
                pa.array([size], pa.int64()), pa.array([content], pa.binary())], names=["part", "shard", "doc_ids", "n_ids", "content"])

        for batch in batches:
            id_type, offsets = batch.column(0).type, utf8(batch.column(1))[1]
            for i, j in spans_of(offsets, TEXT_BYTES):
                found, each = encoder.encode_column(batch.column(1)[i:j], end_id)
                ends, begin = np.cumsum(each), 0
                while begin < j - i:  # up to the document with which the shard is full
                    before = int(ends[begin - 1]) if begin else 0
                    stop = min(j - i, int(np.searchsorted(ends, before + shard_ids - size)) + 1)
                    names += batch.column(0)[i + begin:i + stop].to_pylist()
                    ids.append(found[before:int(ends[stop - 1])])
                    lengths.append(each[begin:stop])
                    size += len(ids[-1])
                    begin = stop
                    if size >= shard_ids:
                        yield closed()
                        names, ids, lengths, size, shard = [], [], [], 0, shard + 1
        if names:
            yield closed()

    ordered.mapInArrow(run, f"part int, shard int, doc_ids array<{kind}>, n_ids long, content binary").write.parquet(path)


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the shard table."""
    narrow = shards.select("part", "shard", "n_ids")
    # Sums inside each part and over the parts, which are as many as the writing job had tasks.
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = narrow.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("part_start"))
    starts = narrow.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, names, content in zip(*batch.columns):
                file = ShardFile(content.as_py())
                ids, n = file.ids(), len(file.lengths)
                cuts = np.concatenate([[0], np.cumsum(file.lengths)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, shard.as_py(), np.int32)), names.values,
                    pa.array(cuts[:-1]), pa.array(file.lengths), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "own", "n_tokens", "ids_crc32"])

    found = shards.select("part", "shard", "doc_ids", "content").mapInArrow(
        run, f"part int, shard int, doc_id {kind}, own long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def written_ids(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of all texts to a new shard table in the shared folder and read them back."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, **options)
    return read(spark.read.parquet(path))
