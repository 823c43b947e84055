"""SimHash near-duplicates: 64-bit fingerprints, partitioned by distance to vantage points, linked exactly.

Two fingerprints within `radius` bits of each other agree on all of at least `bands - radius` of `bands` bit
bands, and so have equal Hamming distances to any vantage point over those bands. Each distinct
fingerprint therefore goes once per choice of bands to the partition that its distances to a few vantage points
name, and no partner is elsewhere. (Over all 64 bits the distances of unrelated fingerprints lie within
a few bits of 32, so that a plain vantage split with the full radius keeps three quarters of the points on
both sides.) Inside a partition, a vantage-point tree over the whole fingerprint finds the pairs: a
branch is left out if the triangle bound rules it out, the overlap at its boundary is compared.

A fingerprint may have several 64-bit words; partners within the radius over all words are so over the first alone.

`drop_near_duplicates` links rows by their fingerprints in the same way, and an exact check of the texts follows: rows are linked if
the sets of their shingles have a Jaccard similarity of 0.8 or more. No fingerprint of fixed size keeps to that limit, so what the
radius does not find is found by bands of minima of the set (`minima_of`): pairs that agree on one band are counted, and their chance to meet
depends on nothing but their similarity and is below 1 by 1.3 in ten million at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, spans_of, utf8, written
from ledgerloom.llm.tokens import WHITE_SPACE, mix, split_words, xxh64

BITS = 64
LEAF = 2048  # fingerprints that a partition should hold
PIECE = 8192  # fingerprints above which a partition is compared piece by piece, in several tasks
TEXT_BYTES = 1 << 20
SIMILARITY = (4, 5)  # near copies share at least this part of all their distinct shingles
# Sets of similarity s agree on one band with probability s^5, so 40 bands miss a pair at 0.8 with (1 - 0.8^5)^40 = 1.3e-7.
BANDS, BAND_MINIMA = 40, 5
NEAR_RADIUS = 4  # bits in which fingerprints of pairs to be counted may differ
PIECE_KEYS, PIECE_SHINGLES = 1024, 1 << 21  # of a bucket, compared in one task with as many others
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts (bytes between two offsets), texts that have any, where the hashes of each of them start."""
    words = split_words(data, offsets, WHITE_SPACE)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    blank = WHITE_SPACE[words.data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.cumsum(keep)
    text = np.where(blank, np.uint8(0x20), words.data)[keep]
    begin, end = place[words.begin] - 1, place[words.end - 1]
    size = np.diff(words.first)
    n = np.where(size > 0, np.maximum(size - shingle_words + 1, 1), 0)
    full = np.flatnonzero(n)
    n_full = n[full]
    start = np.concatenate([[0], np.cumsum(n_full)])
    at = np.arange(start[-1]) - np.repeat(start[:-1] - words.first[:-1][full], n_full)
    last = np.minimum(at + shingle_words - 1, np.repeat(words.first[1:][full] - 1, n_full))
    return xxh64(text, begin[at], end[last]), full, start


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle_words: int, n_words: int = 1) -> np.ndarray:
    """SimHash of each text (bytes between two offsets), n_words x 64 bits; no words: 0."""
    out = np.zeros((len(offsets) - 1, n_words), np.uint64)
    hashes, full, start = shingles_of(data, offsets, shingle_words)
    if not len(full):
        return out
    out[full] = _fingerprints_of_sets(hashes, start, n_words)
    return out


def _fingerprints_of_sets(hashes: np.ndarray, start: np.ndarray, n_words: int = 1) -> np.ndarray:
    """SimHash of each run of hashes, n_words x 64 bits."""
    out = np.zeros((len(start) - 1, n_words), np.uint64)
    n_full = np.diff(start)
    # Bits are counted in runs of at most 255 shingles, eight one-byte counters in each 64-bit word.
    runs = -(-n_full // 255)
    run_start = np.concatenate([[0], np.cumsum(runs)])
    cut = np.repeat(start[:-1], runs) + 255 * (np.arange(run_start[-1]) - np.repeat(run_start[:-1], runs))
    for k in range(n_words):
        lanes = (hashes if k == 0 else mix(hashes + np.uint64(k))).view(np.uint8).reshape(-1, 8)
        counts = np.stack([np.add.reduceat(_SPREAD[lanes[:, j]], cut) for j in range(8)], axis=1)
        counts = np.add.reduceat(counts.view(np.uint8).reshape(-1, BITS).astype(np.int64), run_start[:-1], axis=0)
        out[:, k] = np.packbits(counts * 2 > n_full[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                 n_words: int = 1) -> DataFrame:
    """doc_id and fp0, fp1, ... (long, the words of the fingerprint) for every row; NULL is an empty text, of fingerprint 0."""
    small_batches(docs.sparkSession)
    names = [f"fp{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [fingerprints_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shingle_words, n_words)
                     for i, j in spans_of(offsets, TEXT_BYTES)]
            fp = np.concatenate([np.zeros((0, n_words), np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fp[:, k]) for k in range(n_words))], names=["doc_id", *names])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))


def sure_bands(radius: int, n: int) -> list[tuple[int, int]]:
    """(word, bit mask), one of which any two one-word fingerprints within `radius` agree on; longer masks for more of them."""
    equal = 1 if n < 1 << 24 else 2 if n < 1 << 32 else 3
    bands = radius + equal
    if bands > BITS:
        raise ValueError(f"bands of {BITS} bits cannot find all partners within {radius} bits")
    cuts = [BITS * k // bands for k in range(bands + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [(0, sum(chosen)) for chosen in combinations(single, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vantage_address(fp: Column, mask: Column, vantages: list[int]) -> Column:
    """The distances to all vantage points over the bits of a mask, as one number."""
    digits = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(v))).bitwiseAND(mask)).cast("long") for v in vantages]
    return reduce(lambda a, d: a * F.lit(BITS + 1) + d, digits)


class Linker:
    """Finds pairs within the radius by a vantage-point tree and joins their ends into classes."""

    def __init__(self, points: np.ndarray, radius: int):
        self.points, self.radius = points, radius
        self.label = np.arange(len(points))

    def among(self, rows: np.ndarray) -> None:
        todo = [rows]
        while todo:
            rows = todo.pop()
            points = self.points[rows]
            distance = self._distance(points, points[0])
            distance = self._distance(points, points[distance.argmax()])
            middle = int(np.median(distance))
            near = distance <= middle
            edge_in, edge_out = near & (distance > middle - self.radius), ~near & (distance <= middle + self.radius)
            if len(rows) <= 256 or near.all() or edge_in.sum() * edge_out.sum() > len(rows) ** 2 // 8:
                self.between(rows, rows)
                continue
            todo += [rows[near], rows[~near]]
            self.between(rows[edge_in], rows[edge_out])

    @staticmethod
    def _distance(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.bitwise_count(points ^ vantage).sum(axis=1, dtype=np.int64)

    def between(self, left: np.ndarray, right: np.ndarray) -> None:
        """Compare all of two sets, a bounded block at a time."""
        if not len(left) or not len(right):
            return
        others = np.ascontiguousarray(self.points[right].T)
        step = max(1, (1 << 18) // len(right))
        for i in range(0, len(left), step):
            block = left[i:i + step]
            close = np.bitwise_count(self.points[block, 0][:, None] ^ others[0][None, :]) <= self.radius
            at, to = np.nonzero(close)
            if len(others) > 1:
                far = np.zeros(len(at), np.int64)
                for k in range(len(others)):
                    far += np.bitwise_count(self.points[block[at], k] ^ others[k][to])
                at, to = at[far <= self.radius], to[far <= self.radius]
            for k in np.flatnonzero(np.bincount(at[block[at] != right[to]], minlength=len(block))).tolist():
                mine = self.label[block[k]]
                a, b = np.searchsorted(at, [k, k + 1])
                for other in np.unique(self.label[right[to[a:b]]]).tolist():
                    if other != mine:
                        self.label[self.label == other] = mine


def links(distinct: DataFrame, radius: int, n_words: int = 1) -> DataFrame:
    """a, b (a > b): links that join the representatives of fingerprints within the radius into the right classes.

    `distinct` has one row per fingerprint: fp0, ..., rep. Of the pairs in a partition a spanning set is returned,
    fewer than its fingerprints, so that many near copies give no more rows than there are copies.
    """
    n = distinct.count()
    levels = min(12, max(1, math.ceil(math.log2(max(n / LEAF, 1)) / 1.5) + 1))
    vantages = [int(v) for v in mix(np.arange(1, levels + 1, dtype=np.uint64))]
    bands = sure_bands(radius, n)
    names = [f"fp{k}" for k in range(n_words)]
    choices = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(word).alias("word"), F.lit(_signed(mask)).alias("mask"))
                        for k, (word, mask) in enumerate(bands)])
    spread = distinct.select(*names, "rep", F.explode(choices).alias("of")).select(
        *names, "rep", F.col("of.band").alias("band"),
        vantage_address(F.get(F.array(*names), F.col("of.word")), F.col("of.mask"), vantages).alias("address"))
    large = (spread.groupBy("band", "address").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE)
             .select("band", "address", F.ceil(F.col("n") / PIECE).alias("pieces")))
    piece = F.pmod(F.xxhash64(*names), F.col("pieces"))
    tasks = (spread.join(large, ["band", "address"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
             .withColumn("piece", piece)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
             .select(*names, "rep", "band", "address", "piece", F.least("piece", "other").alias("low"),
                     F.greatest("piece", "other").alias("high")))
    kind = distinct.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        linker = Linker(np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], axis=1), radius)
        side = table.column("piece").to_numpy()
        if low == high:
            linker.among(np.arange(len(side)))
        else:
            linker.between(np.flatnonzero(side == low), np.flatnonzero(side == high))
        sizes = np.bincount(linker.label, minlength=len(side))
        found: dict[int, list] = {}
        for k in np.flatnonzero(sizes[linker.label] > 1).tolist():
            found.setdefault(int(linker.label[k]), []).append(table.column("rep")[k].as_py())
        pairs = [(r, min(group)) for group in found.values() for r in group]
        pairs = [(a, b) for a, b in pairs if a != b]
        return pa.table([pa.array([a for a, _ in pairs], table.schema.field("rep").type),
                         pa.array([b for _, b in pairs], table.schema.field("rep").type)], names=["a", "b"])

    return tasks.groupBy("band", "address", "low", "high").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """a, b: each node that has links with the smallest node of its component, by alternating large and small stars.

    Each round is a written table, so lineage stays short; the number of rounds grows with the logarithm of the
    longest path. Minima are aggregated before their shuffle; a node with very many links is a skewed join key, which
    adaptive execution splits.
    """
    edges, before = written(edges, "star"), None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
                 .where("a <> b").distinct())
        large = written(large, "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = written(small, "star")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
               radius: int = 4, n_words: int = 1) -> DataFrame:
    """doc_id, fp0, ..., component_id for every row: the smallest id that links of at most `radius` bits lead to.

    Equal fingerprints, also those of empty and NULL texts, are linked like any other. Repeated
    rows get the same class. Rows without an id never name a class others belong to. An empty table gives no rows.
    All links are found.
    """
    points = written(fingerprints(docs, id_col, text_col, shingle_words, n_words), "simhash-points")
    names = points.columns[1:]
    distinct = written(points.groupBy(*names).agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    joined = stars(links(distinct.where("rep IS NOT NULL"), radius, n_words))
    classes = (distinct.join(joined, distinct["rep"] == joined["a"], "left")
               .select(*names, F.coalesce("b", "rep").alias("component_id")))
    return points.join(classes, names).select("doc_id", *names, "component_id")


def minima_of(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each set of hashes BANDS numbers, each made of BAND_MINIMA minima of the set under as many orders."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        orders = mix(np.arange(1, 2 * BANDS * BAND_MINIMA + 1, dtype=np.uint64)).astype(np.uint32).reshape(-1, 2)
        out = np.empty((len(start) - 1, BANDS), np.uint64)
        for band in range(BANDS):
            found = np.full(len(start) - 1, band + 1, np.uint64)
            for flip, factor in orders[band * BAND_MINIMA:(band + 1) * BAND_MINIMA]:
                found = mix(found ^ np.minimum.reduceat((low ^ flip) * (factor | np.uint32(1)), start[:-1]))
            out[:, band] = found
    return out


def _with_shingles(rows: DataFrame, shingle_words: int, schema: str, run_set) -> DataFrame:
    """doc_id, h, key of every row, and what `run_set` makes of the sets; the key names the shingles of a text and how often each occurs."""
    small_batches(rows.sparkSession)
    names = [f.split()[0] for f in ("key binary, " + schema).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in spans_of(offsets, TEXT_BYTES):
                hashes, full, start = shingles_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shingle_words)
                key = np.zeros((j - i, 2), np.uint64)
                for k in range(2 if len(full) else 0):
                    key[full, k] = np.add.reduceat(mix(hashes ^ np.uint64((k + 1) << 40)), start[:-1])
                keys = pa.Array.from_buffers(pa.binary(), j - i, [
                    None, pa.py_buffer(np.arange(0, 16 * (j - i) + 1, 16, dtype=np.int32)), pa.py_buffer(key)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], keys, *run_set(hashes, full, start, j - i)], names=["doc_id", "h", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, h long, key binary, {schema}")


def _lists(values: np.ndarray, full: np.ndarray, sizes: np.ndarray, n: int) -> pa.Array:
    all_sizes = np.zeros(n, np.int64)
    all_sizes[full] = sizes
    ends = np.concatenate([[0], np.cumsum(all_sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))


def _bands(hashes: np.ndarray, full: np.ndarray, start: np.ndarray, n: int) -> list[pa.Array]:
    found = minima_of(hashes, start) if len(full) else np.zeros((0, BANDS), np.uint64)
    fp = np.zeros(n, np.uint64)
    if len(full):
        fp[full] = _fingerprints_of_sets(hashes, start)[:, 0]
    return [_lists(found, full, np.full(len(full), BANDS), n), pa.array(fp.view(np.int64))]


def _sets(hashes: np.ndarray, full: np.ndarray, start: np.ndarray, n: int) -> list[pa.Array]:
    sets = [np.unique(hashes[a:b]) for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
    return [_lists(np.concatenate([np.zeros(0, np.uint64), *sets]), full, np.array([len(x) for x in sets], np.int64), n)]


def _within_radius(nodes: DataFrame) -> DataFrame:
    """a, b (a > b): pairs of keys whose fingerprints lead to each other, each fingerprint's keys by its smallest one."""
    same = nodes.groupBy("fp0").agg(F.min("key").alias("rep"))
    same = written(same, "near-fingerprints")
    equal = nodes.join(same, "fp0").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    return equal.unionByName(links(same, NEAR_RADIUS))


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a, b of keys those whose sets of shingles have the wanted similarity, counted exactly."""
    share, of = SIMILARITY
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared")))
    return both.where(F.col("shared").cast("long") * of >= (F.col("n").cast("long") - F.col("shared")) * share).select("a", "b")


def _like_sizes(n: Column, m: Column) -> Column:
    """Sets whose sizes differ more cannot have the wanted similarity."""
    share, of = SIMILARITY
    return F.least(n, m) * of >= F.greatest(n, m) * share


def links_of_sets(sets: list[np.ndarray], bands: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all similar pairs between two lists of sorted sets into the right classes, fewer than there are sets.

    Counted are pairs of unlike labels that agree on a band, have like sizes, and could share enough if they shared all
    that is in more than one of the sets here. Labels are merged as links are found.
    """
    share, of = SIMILARITY
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.add.reduceat(np.append(times[place] > 1, False).astype(np.int64), np.cumsum(size) - size) * (size > 0)
    found = []
    for i in left.tolist():
        others = right[right > i] if left is right else right
        others = others[(label[others] != label[i]) & ((bands[others] == bands[i]).sum(axis=1) >= 1)]
        n = size[others] + size[i]
        others = others[(np.minimum(size[others], size[i]) * of >= np.maximum(size[others], size[i]) * share)
                        & (np.minimum(common[others], common[i]) * (of + share) >= n * share)]
        if not len(others):
            continue
        mine = sets[i]
        theirs = np.concatenate([sets[j] for j in others.tolist()])
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(size[others]) - size[others])
        for j in others[shared * of >= (size[others] + size[i] - shared) * share].tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _linked_inside(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links inside buckets (bucket, key, class, n) that hold several classes; a bucket of many or long sets in pieces, in several tasks."""
    large = (open_.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(PIECE_KEYS)), F.ceil(F.sum("n") / F.lit(PIECE_SHINGLES))).alias("pieces")))
    tasks = (open_.join(large, "bucket").withColumn("piece", F.pmod(F.xxhash64("key"), "pieces"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
             .select("bucket", "key", "class", "piece", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high")))

    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        keys, side = table.column("key").to_pylist(), table.column("piece").to_numpy()
        sets_, bands = ([x.values.to_numpy().view(np.uint64) for x in table.column(c)] for c in ("shingles", "bands"))
        _, label = np.unique(np.array(table.column("class").to_pylist(), object), return_inverse=True)
        left = np.flatnonzero(side == low)
        pairs = links_of_sets(sets_, np.array(bands), label, left, left if low == high else np.flatnonzero(side == high)) if len(keys) > 1 else []
        return pa.table([pa.array([keys[i] for i, _ in pairs], pa.binary()), pa.array([keys[j] for _, j in pairs], pa.binary())], names=["a", "b"])

    return tasks.join(sets.drop("n"), "key").groupBy("bucket", "low", "high").applyInArrow(run, "a binary, b binary").distinct()


def _several_classes(met: DataFrame, links_: DataFrame) -> DataFrame:
    """The buckets (bucket, key, n, class) whose keys are not all in one class yet."""
    label = links_.select(F.col("a").alias("key"), F.col("b").alias("class"))
    now = met.join(label, "key", "left").withColumn("class", F.coalesce("class", "key"))
    several = now.groupBy("bucket").agg(F.min("class").alias("c"), F.max("class").alias("d")).where("c <> d").select("bucket")
    return now.join(several, "bucket", "left_semi")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """doc_id, h (xxhash64 of the text), component_id of every row with an id: the smallest id that links of similarity 0.8 or more lead to.

    Texts with equal shingles, also those without words, are linked. Keys whose fingerprints lie within the radius are counted first. Then each
    key is compared with the first key of one of its buckets, the one it shares most bands with; then with the firsts of its other buckets
    that are of another class still. Buckets with several classes after that are compared inside, in tasks that hold each set once.
    So a group of near copies costs about two pairs for each of them, and no pair that met is left out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    points = written(_with_shingles(texts.where("doc_id IS NOT NULL"), shingle_words, "bands array<bigint>, fp0 long", _bands), "near-points")
    nodes = written(points.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("bands").alias("bands"), F.first("fp0").alias("fp0")), "near-nodes")
    near = written(_within_radius(nodes.select("key", "fp0")), "near-radius")
    met = nodes.select(F.explode("bands").alias("bucket"), "key")
    first = met.groupBy("bucket").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = written(met.join(first, "bucket").select("bucket", "key", "b", "members"), "near-met")
    asked = met.select("key").union(near.select("a")).union(near.select("b")).distinct()
    wanted = nodes.join(asked, "key", "left_semi")
    rows = wanted.select("rep.doc_id", "rep.h").distinct()
    sets = (_with_shingles(texts.join(rows, ["doc_id", "h"], "left_semi"), shingle_words, "shingles array<bigint>", _sets)
            .select("key", "shingles").dropDuplicates(["key"]))
    sets = written(sets.join(wanted.select("key", "bands"), "key").withColumn("n", F.size("shingles").cast("long")), "near-sets")

    sizes = sets.select("key", "n")
    met = written(met.join(sizes, "key"), "near-sized")
    agreeing = (met.where("key <> b").groupBy(F.col("key").alias("a"), "b").agg(F.count(F.lit(1)).alias("bands"), F.first("n").alias("n"))
                .join(sizes.select(F.col("key").alias("b"), F.col("n").alias("m")), "b").where(_like_sizes(F.col("n"), F.col("m"))))
    agreeing = written(agreeing.select("a", "b", "bands"), "near-agreeing")
    best = agreeing.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b"))
    found = written(_similar_pairs(near, sets).unionByName(_similar_pairs(best, sets)).distinct(), "near-links")
    label = stars(found)
    a_class, b_class = (label.select(F.col("a").alias(c), F.col("b").alias(f"{c}_class")) for c in ("a", "b"))
    unlike = (agreeing.join(best.withColumn("done", F.lit(True)), ["a", "b"], "left").where("done IS NULL").select("a", "b")
              .join(a_class, "a", "left").join(b_class, "b", "left")
              .where(F.coalesce("a_class", "a") != F.coalesce("b_class", "b")).select("a", "b"))
    found = written(found.unionByName(_similar_pairs(unlike, sets)), "near-links")
    open_ = written(_several_classes(met.where("members > 2"), stars(found)).select("bucket", "key", "class", "n"), "near-open")
    classes = stars(found.unionByName(_linked_inside(open_, sets)))
    roots = nodes.join(classes, nodes["key"] == classes["a"], "left").select("key", "rep", F.coalesce("b", "key").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    return points.join(roots.join(least, "root").select("key", "component_id"), "key").select("doc_id", "h", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its class of near copies (rows without an id all stay), with their own columns."""
    gone = (near_copies(docs, id_col, text_col, **options).where("doc_id <> component_id")
            .select(F.col("doc_id").alias("__gone"), F.col("h").alias("__h")).distinct())
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__h"]), "left_anti")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
