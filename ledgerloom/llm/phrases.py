"""Phrases that occur together more often than their parts, from a weighted de Bruijn graph of the words.

Edges are runs of four words, between the nodes of their first and last three. A phrase needs `min_count` occurrences, and so do
its words and word pairs: rarer words, then rarer pairs, are walls like the ends of pieces, which loses no phrase. Both are counted
over the corpus, and each block of texts gets back which of its own are frequent; nothing is broadcast.

Each block builds the graph of what is left and compacts it: nodes with one way in and one way out, at which no piece begins or
ends, lie inside a unary path, and a path is sent as its words and a weight, not as one row for each edge.
Paths are cut into edges where they are added up. A node's count is the flow out of it plus the pieces that end in
it; the count of a pair is the sum over the nodes that begin with it plus the pieces that end in the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import small_batches, spans_of, utf8, written, written_kinds
from ledgerloom.llm.tokens import Words, mix, split_words

MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
SHARE = (80, 100)  # a phrase goes if a longer one has this share of its occurrences
BLOCK_BYTES = 16 << 20  # text of one block
PIECE_BYTES = 1 << 20
PART_ENTRIES = 1 << 16  # occurrences of a word whose successors are counted in one place
GROUP_WORDS, LEAST_GROUPS = 64, 1024  # first words whose pairs a block sends as one row
NUMBER_BITS = 31  # of a frequent word's number, so that two of them are one long
ROWS = 1 << 15
NO_LANGUAGE = "und"

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEPARATORS = PIECE_ENDS.copy()
_SEPARATORS[list(b" \t")] = True


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: type = np.int64) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(kind)))


def _begins(words: Words) -> np.ndarray:
    """Whether each word is the first of its piece."""
    out = np.zeros(len(words), bool)
    if len(words):
        ends = np.cumsum(PIECE_ENDS[words.data])
        out[1:] = ends[words.begin[1:]] != ends[words.end[:-1] - 1]
        out[words.first[words.first < len(words)]] = True
    return out


class _Block:
    """Words of texts of one language, up to the size of a block."""

    def __init__(self):
        self.hashes, self.begins, self.names, self.size = [], [], {}, 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words = split_words(data, offsets, _SEPARATORS)
        hashes = words.hashes()
        self.hashes.append(hashes)
        self.begins.append(_begins(words))
        distinct, at = np.unique(hashes, return_index=True)
        for h, a, b in zip(distinct.tolist(), words.begin[at].tolist(), words.end[at].tolist()):
            if h not in self.names:
                self.names[h] = words.data[a:b].tobytes()
        self.size += len(data)

    def rows(self, name: int, lang: str) -> Iterator[pa.RecordBatch]:
        distinct, ids, counts = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        names = ["block", "lang", "local", "word", "n", "ids", "begins"]
        yield pa.RecordBatch.from_arrays([
            pa.array([name], pa.int64()), pa.array([lang], pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
            pa.array([_pack(ids.astype("<u4"))], pa.binary()), pa.array([_pack(np.concatenate(self.begins))], pa.binary())], names=names)
        words = [self.names[h] for h in distinct.tolist()]
        for k in range(0, len(words), ROWS):
            n = len(words[k:k + ROWS])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, name)), pa.array([lang] * n, pa.string()), pa.array(np.arange(k, k + n)), pa.array(words[k:k + ROWS], pa.binary()),
                pa.array(counts[k:k + ROWS].astype(np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)


def blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Two tables, written in one pass: a row per block with its texts as numbers of words, and a row per distinct word of a block."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_ = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                data, offsets = utf8(batch.column(1).filter(pa.array(langs == lang)))
                for i, j in spans_of(offsets, PIECE_BYTES):
                    open_.setdefault(lang, _Block()).add(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    while sum(b.size for b in open_.values()) >= block_bytes:
                        full = max(open_, key=lambda x: open_[x].size)
                        yield from open_.pop(full).rows(name, full)
                        name += 1
        for lang, block in open_.items():
            yield from block.rows(name, lang)
            name += 1

    found = narrow.mapInArrow(run, "block long, lang string, local long, word binary, n long, ids binary, begins binary")
    texts, words = written_kinds(found, F.col("local").isNull(), "phrase-blocks")
    return texts.select("block", "ids", "begins"), words.drop("ids", "begins")


def _numbered(words: DataFrame) -> DataFrame:
    """The words with numbers from 1, common ones first, written: what the rows of all partitions before a row's own come to, plus its place there."""
    rows = written(words.sort(F.desc("n"), "word", "lang").withColumn("place", F.monotonically_increasing_id()), "phrase-places")
    rows = rows.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes, before, offsets = sorted(rows.groupBy("part").count().collect()), 1, []
    for part, n in sizes:  # one row per partition
        offsets.append((part, before))
        before += n
    if before >= 1 << NUMBER_BITS:
        raise ValueError(f"{before} frequent words do not fit into {NUMBER_BITS} bits: raise min_count")
    starts = words.sparkSession.createDataFrame(offsets, "part long, before long")
    return written(rows.join(starts, "part").select("lang", "word", "n", (F.col("before") + F.col("place")).alias("id")), "phrase-frequent")


def _marked(texts: DataFrame, words: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each block with its frequent words numbered from 1 (0: a wall) and their numbers in the corpus and counts, written."""
    mine = words.drop("n").join(frequent, ["lang", "word"]).select("block", "local", "id", "n")

    def run(words: pa.Table, block: pa.Table) -> pa.Table:
        row = block.select(["ids", "begins"]).to_pylist()
        if not row or not len(words):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))],
                            names=["block", "seq", "begins", "ids", "counts"])
        local, ids, counts = (words.column(c).to_numpy() for c in ("local", "id", "n"))
        order = np.argsort(ids)
        local, ids, counts = local[order], ids[order], counts[order]
        seq = _unpack(row[0]["ids"], "<u4")
        number = np.zeros(max(int(local.max()), int(seq.max(initial=0))) + 1, "<u4")
        number[local] = np.arange(1, len(local) + 1)
        one = [pa.array([block.column("block")[0].as_py()], pa.int64()), pa.array([_pack(number[seq])], pa.binary()),
               pa.array([row[0]["begins"]], pa.binary()), _lists(ids, np.array([len(ids)])), _lists(counts, np.array([len(ids)]))]
        return pa.table(one, names=["block", "seq", "begins", "ids", "counts"])

    found = (mine.groupBy("block").cogroup(texts.groupBy("block"))
             .applyInArrow(run, "block long, seq binary, begins binary, ids array<long>, counts array<long>"))
    return written(found, "phrase-marked")


def _pairs_at(seq: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair of frequent words of one piece begins, and its two numbers as one."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0) & ~begins[1:])
    return at, seq[at].astype(np.int64) * (n + 1) + seq[at + 1]


def _frequent_pairs(marked: DataFrame, groups: int, min_count: int) -> DataFrame:
    """block, pairs (list of w1 << 31 | w2): the pairs of each block that are frequent in the corpus.

    Blocks send their distinct pairs to groups of first words, which add up and answer. The successors of a common word go to several
    parts, as many as its count asks for, so a group holds at most GROUP_WORDS * PART_ENTRIES pairs or so, at any size of the corpus.
    """
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq, begins, ids, counts in zip(*batch.columns):
                ids, counts = ids.values.to_numpy(), counts.values.to_numpy()
                _, both = _pairs_at(_unpack(seq.as_py(), "<u4"), _unpack(begins.as_py(), "?"), len(ids))
                both, n = np.unique(both, return_counts=True)
                first, second = both // (len(ids) + 1) - 1, ids[both % (len(ids) + 1) - 1]
                group = (mix(ids[first].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
                part = (mix(second.astype(np.uint64)) % (counts[first] // PART_ENTRIES + 1).astype(np.uint64)).astype(np.int64)
                first = ids[first]
                order = np.lexsort((second, first, part, group))
                group, part, first, second, n = group[order], part[order], first[order], second[order], n[order]
                starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])])) if len(n) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(n))
                for k in range(0, len(starts), 1 << 8):
                    some, last = starts[k:k + (1 << 8)], ends[k:k + (1 << 8)]
                    a, b, sizes = some[0], last[-1], last - some
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some), name.as_py())), pa.array(group[some]), pa.array(part[some]),
                        *(_lists(x[a:b], sizes, np.int32) for x in (first, second, n))], names=["block", "group", "part", "w1", "w2", "n"])

    def answered(table: pa.Table) -> pa.Table:
        first, second, n = (table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("w1", "w2", "n"))
        sizes = np.diff(table.column("w1").combine_chunks().offsets.to_numpy())
        pair = first << NUMBER_BITS | second
        distinct, place = np.unique(pair, return_inverse=True)
        enough = (np.bincount(place, weights=n, minlength=len(distinct)) >= min_count)[place]
        kept = np.add.reduceat(np.append(enough, False).astype(np.int64), np.cumsum(sizes) - sizes)
        return pa.table([table.column("block").combine_chunks().filter(pa.array(kept > 0)), _lists(pair[enough], kept[kept > 0])], names=["block", "pairs"])

    rows = marked.mapInArrow(sent, "block long, group long, part long, w1 array<int>, w2 array<int>, n array<int>")
    return rows.groupBy("group", "part").applyInArrow(answered, "block long, pairs array<long>")


def compacted(seq: np.ndarray, at: np.ndarray, pair: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary paths and piece ends of the graph: where each begins in `seq`, how many words it has, its weight.

    `at` are the places where a frequent pair begins, `pair` the pair's number.
    """
    linked = np.full(len(seq) + 2, -1, np.int64)
    linked[at] = pair
    node_at = at[linked[at + 1] >= 0]
    _, node, seen = np.unique(linked[node_at] * n_pairs + linked[node_at + 1], return_inverse=True, return_counts=True)
    n_nodes = len(seen)
    of = np.full(len(seq) + 2, -1, np.int64)
    of[node_at] = node
    edge_at = node_at[of[node_at + 1] >= 0]
    source, target = of[edge_at], of[edge_at + 1]
    edges, first, edge, weight = np.unique(source * max(n_nodes, 1) + target, return_index=True, return_inverse=True, return_counts=True)
    ways_out = np.bincount(edges // max(n_nodes, 1), minlength=n_nodes)
    ways_in = np.bincount(edges % max(n_nodes, 1), minlength=n_nodes)
    inner = ((ways_out == 1) & (ways_in == 1) & (np.bincount(source, minlength=n_nodes) == seen)
             & (np.bincount(target, minlength=n_nodes) == seen))
    heads = np.flatnonzero(~inner[edges // max(n_nodes, 1)])  # edges that a path begins with
    begin = edge_at[first[heads]]
    stops = edge_at[~inner[target]]
    stop = stops[np.searchsorted(stops, begin)] if len(begin) else begin
    # A node without an edge behind it, and a pair without a node: the last three and two words before a wall.
    last_node = node_at[of[node_at + 1] < 0]
    kinds, node_first, node_times = np.unique(of[last_node], return_index=True, return_counts=True)
    last_pair = at[linked[at + 1] < 0]
    kinds, pair_first, pair_times = np.unique(linked[last_pair], return_index=True, return_counts=True)
    return (np.concatenate([begin, last_node[node_first], last_pair[pair_first]]),
            np.concatenate([stop - begin + 4, np.full(len(node_first), 3), np.full(len(pair_first), 2)]).astype(np.int64),
            np.concatenate([weight[heads], node_times, pair_times]).astype(np.int64))


def paths(marked: DataFrame, frequent_pairs: DataFrame) -> DataFrame:
    """words (list of word numbers), parts (list), n: the compacted graphs of all blocks.

    `parts` says for each place how many parts the grams that begin there are dealt to, by what their first pair can count at most.
    """
    def run(pairs: pa.Table, block: pa.Table) -> pa.Table:
        names = ["words", "parts", "n"]
        row = block.select(["seq", "begins", "ids", "counts"]).combine_chunks()
        if not len(row) or not len(pairs):
            return pa.table([pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int64())), pa.array([], pa.int64())], names=names)
        ids, counts = (row.column(c).chunk(0).values.to_numpy() for c in ("ids", "counts"))
        seq, begins = _unpack(row.column("seq")[0].as_py(), "<u4"), _unpack(row.column("begins")[0].as_py(), "?")
        both = pairs.column("pairs").combine_chunks().flatten().to_numpy()
        known = np.sort((np.searchsorted(ids, both >> NUMBER_BITS) + 1) * (len(ids) + 1) + np.searchsorted(ids, both & ((1 << NUMBER_BITS) - 1)) + 1)
        at, both = _pairs_at(seq, begins, len(ids))
        pair = np.minimum(np.searchsorted(known, both), len(known) - 1)
        hit = known[pair] == both
        begin, size, weight = compacted(seq, at[hit], pair[hit], len(known))
        word = seq[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].astype(np.int64) - 1
        most = counts[word]
        most[:-1] = np.minimum(most[:-1], most[1:])
        return pa.table([_lists(ids[word], size), _lists(most // PART_ENTRIES + 1, size), pa.array(weight)], names=names)

    return frequent_pairs.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(run, "words array<long>, parts array<long>, n long")


def gram_counts(found: DataFrame, min_count: int) -> DataFrame:
    """words (2 to 4 word numbers), n: counts of at least `min_count` from node flow and piece ends, written.

    Paths are cut into edges, and edges and piece ends are shuffled once, by their first two words and a part by the third;
    what flows out of a node and out of a pair is summed where they are.
    """
    def word(i: Column, k: int) -> Column:
        return F.coalesce(F.get("words", i + k), F.lit(0).cast("long"))

    last = F.greatest(F.size("words") - 4, F.lit(0))
    grams = found.select("n", "words", "parts", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(
        "n", (F.shiftleft(word(F.col("i"), 0), NUMBER_BITS).bitwiseOR(word(F.col("i"), 1))).alias("pair"),
        (F.shiftleft(word(F.col("i"), 2), NUMBER_BITS).bitwiseOR(word(F.col("i"), 3))).alias("rest"),
        F.pmod(F.xxhash64(word(F.col("i"), 2)), F.get("parts", F.col("i"))).alias("part"))
    mask = (1 << NUMBER_BITS) - 1
    enough, fourth = F.col("n") >= min_count, F.col("rest").bitwiseAND(mask)
    edges = grams.repartition("pair", "part").groupBy("pair", "part", "rest").agg(F.sum("n").alias("n"))
    # Lists hold frequent edges and nodes only, which are few in any group.
    nodes = edges.groupBy("pair", "part", F.shiftright("rest", NUMBER_BITS).alias("third")).agg(
        F.collect_list(F.when(enough & (fourth != 0), F.struct(fourth.alias("fourth"), "n"))).alias("edges"), F.sum("n").alias("n"))
    pairs = nodes.groupBy("pair", "part").agg(
        F.collect_list(F.when(enough & (F.col("third") != 0), F.struct("third", "n", "edges"))).alias("nodes"), F.sum("n").alias("n"))
    flows = written(pairs, "phrase-flows")
    two = [F.shiftright("pair", NUMBER_BITS), F.col("pair").bitwiseAND(mask)]
    node = flows.select("pair", F.explode("nodes").alias("x")).select("pair", "x.*")
    edge = node.select("pair", "third", F.explode("edges").alias("x")).select(F.array(*two, "third", "x.fourth").alias("words"), "x.n")
    every = (edge.unionByName(node.select(F.array(*two, "third").alias("words"), "n"))
             .unionByName(flows.groupBy("pair").agg(F.sum("n").alias("n")).where(enough).select(F.array(*two).alias("words"), "n")))
    return written(every, "phrase-grams")


def _exact_score(a: Column, parts: Column) -> Column:
    whole = "decimal(38,0)"
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(27,0)"), parts.cast(whole))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    A phrase is 2 to 4 words of one piece (pieces end at `.,;:!?` and line ends, A-Z lower-cased) with a >= min_count occurrences. l and r
    are the counts of its two parts where floor(2000000 a / (l + r)) is lowest, ties to the shortest first part; n counts
    the words of the language. Phrases inside a longer one with 80 % of their occurrences go. Ties are ordered by a, then by the
    phrase's bytes. NULL and empty texts have no words, NULL languages are `und`; repeated rows count each. Words of a block are told
    apart by 64-bit hashes, those of the corpus by their bytes. An empty table gives no rows.
    """
    texts, each = blocks(docs, text_col, lang_col, block_bytes)
    sizes = each.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    frequent = _numbered(each.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    groups = max(LEAST_GROUPS, -(-frequent.count() // GROUP_WORDS))
    marked = _marked(texts, each, frequent)
    grams = gram_counts(paths(marked, _frequent_pairs(marked, groups, min_count)), min_count)

    longer = (grams.where(F.size("words") > 2).select(F.explode(F.array(
        F.expr("slice(words, 1, size(words) - 1)"), F.slice("words", 2, 3))).alias("words"), F.col("n").alias("longer"))
        .groupBy("words").agg(F.max("longer").alias("longer")))
    share, of = SHARE
    kept = (grams.join(longer, "words", "left").where(F.col("longer").isNull() | (F.col("longer") * of < F.col("n") * share))
            .select("words", F.col("n").alias("a")))
    counts = grams.unionByName(frequent.select(F.array("id").alias("words"), "n"))
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.expr("slice(words, k + 1, 4)").alias("rest"))
    scored = (cuts.join(counts.select(F.col("words").alias("head"), F.col("n").alias("l")), "head")
              .join(counts.select(F.col("words").alias("rest"), F.col("n").alias("r")), "rest")
              .withColumn("score", _exact_score(F.col("a"), F.col("l") + F.col("r")))
              .groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    scored = written(scored, "phrase-scored")
    named = (scored.select("words", F.posexplode("words").alias("k", "id")).join(frequent.select("id", "lang", "word"), "id")
             .groupBy("words").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("k", F.col("word").cast("string").alias("word")))).alias("w"))
             .select("words", "lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.select("words", "a", "cut.*").join(named, "words").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_lang").alias("n"),
                                        F.col("score").cast("long").alias("score")))
