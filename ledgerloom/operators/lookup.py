"""Lookup joins: documents with cached answers, and texts with a table of hints.

A few hints are compiled into one expression. Many are found by an inverted index of q-grams. A text is cut into blocks of q
characters; a pattern of 2q - 1 characters or more that occurs in it covers one of these blocks as a whole, and that block is one of q grams
of the pattern, whichever way it lies. The grams of the least common stretch of each pattern are its index entries, so
an equi join of blocks with entries finds all texts that may hold a pattern, and `contains` decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import Sql, let, quote

# A hint table up to this many rows is compiled into one expression; a larger one is searched for by its q-grams.
MAX_INLINE_HINTS = 500
GRAM_SIZES = (4, 2, 1)  # the largest q for which a pattern has 2q - 1 characters
_HINT_TYPE = "STRUCT<pos: BIGINT, vendor: STRING, pattern: STRING>"


def cache_lookup(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Every document with an `answer` struct, NULL where the cache has none.

    Left to the planner: a small cache is broadcast once its size is known, a
    large one is shuffled by hash, with hot hashes split by the skew join.
    """
    cached = F.col("cached") if "cached" in cache.columns else F.lit(True)
    answers = cache.select(
        F.col("file_hash").alias("__hash"),
        F.struct("vendor", "date", "category", "confidence", "reasoning",
                 cached.alias("cached")).alias("answer"),
    )
    return docs.join(answers, docs["sha1"] == F.col("__hash"), "left").drop("__hash")


def cache_misses(docs: DataFrame, cache: DataFrame) -> DataFrame:
    return docs.join(cache.select(F.col("file_hash").alias("sha1")), "sha1", "left_anti")


@dataclass(frozen=True)
class Hint:
    """A pattern, lower-cased by Spark, and what it stands for."""

    pos: int
    pattern: str
    vendor: str | None


def first_hint(texts: DataFrame, hints: DataFrame, key: str, text: str = "text", inline_limit: int = MAX_INLINE_HINTS) -> DataFrame:
    """(key, pos, vendor) of the first hint found in each row's text, NULLs where none occurs.

    `hints` has (pos, pattern, vendor). Case is ignored as Spark's `lower` does. An empty
    pattern is in every text but NULL, a NULL pattern in none. Of equal positions
    the pattern that sorts first wins. Every row is answered by itself, whatever its key.
    `inline_limit` chooses the plan only, never the result.
    """
    found = with_first_hint(texts.select(key, F.col(text).alias("__text")), hints, "__text", "__hint", inline_limit)
    return found.select(key, "__hint.pos", "__hint.vendor")


def with_first_hint(rows: DataFrame, hints: DataFrame, text: str, name: str, inline_limit: int = MAX_INLINE_HINTS) -> DataFrame:
    """`rows` with a struct (pos, vendor) under `name`.

    A few hints go to the texts, without a shuffle. More than `inline_limit` meet them by q-grams: what is exchanged are
    grams and hashes of texts, then each text with the hints it may hold.
    """
    known = hints.where("pattern IS NOT NULL").selectExpr("CAST(pos AS BIGINT) AS pos", "lower(pattern) AS pattern", "vendor")
    few = known.limit(inline_limit + 1).collect()
    if len(few) <= inline_limit:
        ordered = sorted((Hint(*r) for r in few), key=lambda h: (h.pos, h.pattern))
        return rows.selectExpr("*", f"{_compiled(ordered, text)} AS {name}")
    first = known.groupBy("pattern").agg(F.min(F.struct("pos", F.col("vendor").isNull().alias("none"), "vendor")).alias("h")).select(
        "pattern", "h.pos", "h.vendor")
    held = may_hold(rows.select(F.lower(F.col(text)).alias("low")).where("low IS NOT NULL"), first)
    everywhere = first.where("pattern = ''").select(F.struct("pos", "vendor", "pattern").alias("__everywhere"))
    low = rows.withColumn("__low", F.lower(F.col(text)))
    met = low.join(held, F.xxhash64("__low") == F.col("__text_hash"), "left").drop("__text_hash")
    inside = F.array_min(F.filter("__held", lambda h: F.contains(F.col("__low"), h["pattern"])))
    for h in everywhere.collect():  # one row at most
        e = h["__everywhere"]
        inside = F.least(inside, F.when(F.col("__low").isNotNull(), F.expr(
            f"named_struct('pos', {e.pos}L, 'pattern', '', 'vendor', {quote(e.vendor)})")))
    found = F.expr(f"IF(__found IS NULL, NULL, named_struct('pos', __found.pos, 'vendor', __found.vendor, 'pattern', __found.pattern))")
    return met.withColumn("__found", inside).withColumn(name, found).drop("__low", "__held", "__found")


def _compiled(hints: list[Hint], text: str) -> Sql:
    if not hints:
        return f"CAST(NULL AS {_HINT_TYPE})"
    tests = " ".join(
        f"WHEN contains(low, {quote(h.pattern)}) "
        f"THEN named_struct('pos', {h.pos}L, 'vendor', {quote(h.vendor)}, 'pattern', {quote(h.pattern)})" for h in hints)
    return let("low", f"lower({text})", f"CASE {tests} END")


def _gram_size() -> Sql:
    tests = " ".join(f"WHEN length(pattern) >= {2 * n - 1} THEN {n}" for n in GRAM_SIZES)
    return f"CASE {tests} END"


def _entries(hints: DataFrame) -> DataFrame:
    """q, gram, hint: the q grams of the stretch of 2q - 1 characters of each pattern whose most common gram is least common."""
    sized = hints.where("pattern <> ''").withColumn("q", F.expr(_gram_size()))
    grams = sized.select("q", "pattern", "pos", "vendor", F.posexplode(F.expr(
        "transform(sequence(1, length(pattern) - q + 1), i -> substring(pattern, i, q))")).alias("at", "gram"))
    common = grams.groupBy("q", "gram").agg(F.count(F.lit(1)).alias("n"))
    listed = grams.join(common, ["q", "gram"]).groupBy("q", "pattern", "pos", "vendor").agg(
        F.array_sort(F.collect_list(F.struct("at", "gram", "n"))).alias("g"))
    stretches = F.expr("transform(sequence(1, size(g) - q + 1), i -> named_struct('most', array_max(transform(slice(g, i, q), x -> x.n)), 'at', i))")
    best = listed.withColumn("at", F.array_min(stretches)["at"])
    return best.select("q", F.explode(F.expr("array_distinct(transform(slice(g, at, q), x -> x.gram))")).alias("gram"),
                       F.struct("pos", "pattern", "vendor").alias("hint"))


def may_hold(texts: DataFrame, hints: DataFrame) -> DataFrame:
    """(__text_hash, __held): the hints that texts of a hash may hold. Equal texts are met once; equal hashes only add candidates."""
    sizes = sorted(r[0] for r in hints.where("pattern <> ''").select(F.expr(_gram_size())).distinct().collect())  # of GRAM_SIZES
    every = ", ".join(f"transform(array_distinct(regexp_extract_all(low, '(?s).{{{n}}}', 0)), g -> named_struct('q', {n}, 'gram', g))" for n in sizes)
    blocks = F.expr(f"explode(concat({every}))" if sizes else "explode(array(named_struct('q', 0, 'gram', '')))")
    met = texts.select(F.xxhash64("low").alias("__text_hash"), blocks.alias("b")).select("__text_hash", "b.q", "b.gram").join(_entries(hints), ["q", "gram"])
    return met.groupBy("__text_hash").agg(F.collect_set("hint").alias("__held"))
