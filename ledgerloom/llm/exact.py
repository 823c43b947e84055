"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by the length of their normalised text, then by a hash of its prefix, then by the
SHA-256 of the whole. Each step passes on only keys that several rows share, so the full content of a
row is hashed and compared only while it may still have a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of at least two rows with equal normalised text: text_sha256, keep_id, group_size.

    keep_id is the smallest id of the group (ids of NULL lose to any other). NULL and empty texts are
    equal. Repeated rows, also with one id, are members each and count in group_size. An empty
    table has no groups. Other columns of `docs` are not read, so their names may be anything.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    length, prefix = F.octet_length("body").alias("n"), F.xxhash64(F.left("body", F.lit(prefix_chars))).alias("p")
    sketch = written(rows.select(length, prefix), "exact-sketch")
    # Counting before the shuffle leaves one row per key and task, however many copies there are.
    lengths = sketch.groupBy("n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("n")
    prefixes = (sketch.join(lengths, "n", "left_semi").groupBy("n", "p")
                .agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("n", "p"))
    survivors = rows.select("id", "body", length, prefix).join(prefixes, ["n", "p"], "left_semi")
    return (survivors.select("id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
            .groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs`, one row of each group of equal texts: that with the smallest id.

    Of repeated rows with that same id all stay; `dropDuplicates` removes them beforehand if wanted.
    """
    groups = duplicate_groups(docs, id_col, text_col).select(
        F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"))
    tagged = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    return (tagged.join(groups, "__sha", "left")
            .where(F.col("__keep").isNull() | F.col("__keep").eqNullSafe(F.col(id_col)))
            .select(*docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    The texts stay where they are read: only id and digest are joined to the groups.
    """
    digests = docs.select(F.col(id_col).alias("doc_id"),
                          F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"))
    groups = duplicate_groups(docs, id_col, text_col)
    keep = F.coalesce("keep_id", "doc_id")
    return digests.join(groups, "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
