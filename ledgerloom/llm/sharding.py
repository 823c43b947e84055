"""Shards of bounded size by extendible hashing, in DataFrame operations only.

A row's hash is 60 bits of the SHA-256 of its key. The directory is indexed by the first D bits; a bucket
is the set of directory entries that share its (shorter) prefix. Starting from one bucket, only buckets above
the byte limit are split on their next bit. Splits depend on byte sums per prefix alone, so the
histogram of the D-bit prefixes, aggregated before its shuffle, is all that is needed to find them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import ROW_KEY, keyed, written

HASH_BITS = 60
EXTRA_BITS = 3  # directory bits beyond an even split, so that one histogram is normally enough
MAX_BYTES = 64 << 20
SALT_SHARDS, SALT_ROWS = 64, 1 << 20


def key_hash(key: Column) -> Column:
    """60 bits of the SHA-256 of the key as text; NULL hashes like the empty text."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def directory(sizes: DataFrame, depth: int, max_bytes: int, least_depth: int = 0) -> DataFrame:
    """entry (of `depth` bits), local depth of its bucket (NULL if even one entry is above the limit), bytes.

    `sizes` has columns h (hash) and n_bytes. Buckets are at least `least_depth` bits deep.
    """
    leaves = sizes.groupBy(_prefix(F.col("h"), depth).alias("entry")).agg(F.sum("n_bytes").alias("n_bytes"))
    each = leaves.select("entry", "n_bytes", F.explode(F.sequence(F.lit(least_depth), F.lit(depth))).alias("d")).withColumn(
        "bucket", F.expr(f"shiftright(entry, cast({depth} - d as int))"))
    fitting = (each.groupBy("d", "bucket").agg(F.sum("n_bytes").alias("bucket_bytes"))
               .where(F.col("bucket_bytes") <= max_bytes))
    # The shallowest prefix that fits is where splitting stops: all shorter ones were above the limit.
    return (each.drop("n_bytes").join(fitting, ["d", "bucket"], "left").groupBy("entry")
            .agg(F.min(F.when(F.col("bucket_bytes").isNotNull(), F.struct("d", "bucket_bytes"))).alias("b"))
            .select("entry", F.col("b.d").alias("depth"), F.col("b.bucket_bytes").alias("shard_bytes")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES,
           keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, and the columns `keep` of docs: one row per row of `docs`.

    The shard is named `b` plus its hash prefix in bits, so sorting by name is hash order; NULL or empty
    texts have 0 bytes. Rows of one key cannot be told apart by its hash: where they alone exceed
    the limit, all 60 bits are used up and they go to numbered overflow shards (`b<bits>.<n>`), in
    the order of a hash of their text; very many of them are dealt out by a hash of the row first (`b<bits>.<salt>.<n>`).
    A row above the limit has an overflow shard of its own. An empty table gives no rows.
    """
    keep = keep or []
    rows = docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col)).alias("h"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.xxhash64(F.col(text_col)).alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), *keep)
    rows = written(rows, "shard-sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, done, least = min(HASH_BITS, max(1, math.ceil(math.log2(max(total / max_bytes, 1))) + EXTRA_BITS)), [], 0
    while True:
        entries = written(directory(rows, depth, max_bytes, least), "shard-directory")
        mapped = rows.withColumn("entry", _prefix(F.col("h"), depth)).join(entries, "entry")
        done.append(mapped.where("depth IS NOT NULL").select(
            "doc_id", "n_bytes",
            F.concat(F.lit("b"), F.when(F.col("depth") > 0, F.expr(
                f"left(lpad(conv(entry, 10, 2), {depth}, '0'), depth)")).otherwise("")).alias("shard"),
            F.col("depth").cast("int").alias("depth"), "shard_bytes", *keep))
        over = entries.where("depth IS NULL").select("entry")
        if over.isEmpty():
            break
        rows = rows.withColumn("entry", _prefix(F.col("h"), depth)).join(over, "entry", "left_semi").drop("entry")
        if depth == HASH_BITS:
            done.append(_overflow(rows, max_bytes, keep))
            break
        least, depth = depth + 1, min(HASH_BITS, depth + 8)
    return reduce(DataFrame.unionByName, done)


def _overflow(rows: DataFrame, max_bytes: int, keep: list[str]) -> DataFrame:
    """Rows of equal hashes in shards cut at multiples of half the limit; a row above that half stands alone.

    A window orders about SALT_SHARDS shards or SALT_ROWS rows: more of one hash are dealt to several windows first.
    """
    half = max(1, max_bytes // 2)
    salts = rows.groupBy("h").agg(F.greatest(F.ceil(F.sum("n_bytes") / F.lit(max_bytes * SALT_SHARDS)), F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS))).alias("salts"))
    rows = rows.join(salts, "h").withColumn("salt", F.pmod("salt", "salts")).withColumn("large", F.col("n_bytes") > half)
    ordered = Window.partitionBy("h", "salt", "large").orderBy("tie", "doc_id")
    before = F.coalesce(F.sum("n_bytes").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("piece", F.when(F.col("large"), F.row_number().over(ordered)).otherwise(F.floor(before / half)))
    named = cut.withColumn("shard", F.concat(
        F.lit("b"), F.lpad(F.conv(F.col("h").cast("string"), 10, 2), HASH_BITS, "0"), F.lit("."),
        F.when(F.col("salts") > 1, F.concat(F.col("salt").cast("string"), F.lit("."))).otherwise(F.lit("")),
        F.when(F.col("large"), F.lit("r")).otherwise(F.lit("")), F.col("piece").cast("string")))
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return named.join(sums, "shard").select("doc_id", "n_bytes", "shard", F.lit(HASH_BITS).alias("depth"), "shard_bytes", *keep)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> None:
    """The rows of `docs` as Parquet, one folder per shard; each row once, also those of one id or without."""
    rows = keyed(docs)
    names = assign(rows, id_col, text_col, max_bytes, ROW_KEY).select(*[F.col(c).alias(f"__of{c}") for c in ROW_KEY], F.col("shard").alias("__shard"))
    same = [rows[c] == names[f"__of{c}"] for c in ROW_KEY]
    (rows.join(names, same).select(*[rows[c] for c in docs.columns], "__shard")
     .repartition("__shard").write.partitionBy("__shard").parquet(path))
