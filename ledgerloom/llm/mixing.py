"""Mixing sources to target weights along a time-varying curriculum.

A source's target is its share of all words by weight, at most `max_epochs` times its own words. Its documents, in
the order of a hash, form a stream that is repeated until the target is met. Its weight schedule w(t) over training
time 0..1 is integrated; the word at which a share u of the source's demand is met is placed at the time
t where the integral reaches the share u of its total. Sorting by that time gives the training order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.llm.common import ROW_KEY, keyed, written

MAX_EPOCHS = 3
BUCKET_ROWS = 50_000  # documents of a source whose sizes are summed in one window
FULL_BUCKET_ROWS = 4 * BUCKET_ROWS
Schedule = list[tuple[float, float]]  # (time, weight), from time 0 to time 1, linear in between
FLAT: Schedule = [(0.0, 1.0), (1.0, 1.0)]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    """60 bits that order the documents of a source: from a SHA-256 of the id, which every SQL engine has."""
    digest = F.sha2(F.concat(F.lit("mix "), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: dict, weights: dict, max_epochs: float = MAX_EPOCHS) -> dict:
    """Words per source: shares of the total by weight; what a source above its limit cannot take is shared again."""
    open_, found, rest = dict(sizes), {}, float(sum(sizes.values()))
    while open_:
        unit = rest / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * unit > max_epochs * sizes[s]]
        if not full:
            return found | {s: weights[s] * unit for s in open_}
        for s in full:
            found[s] = float(max_epochs * open_.pop(s))
            rest -= found[s]
    return found


def _segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(share of demand met before, time, weight, slope, total area) of each linear piece."""
    area = sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]))
    if area <= 0:
        return _segments(FLAT)
    out, met = [], 0.0
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        if b > a and v + w > 0:
            out.append((met / area, float(a), float(v), (w - v) / (b - a), area))
            met += (b - a) * (v + w) / 2
    return out


def _time_at(share: Column) -> Column:
    """Inverse of the integrated schedule: the time at which a share of the source's demand is met."""
    piece = F.element_at(F.filter("segments", lambda s: s["met"] <= share), -1)
    due = (share - piece["met"]) * piece["area"]
    root = F.sqrt(F.greatest(piece["weight"] * piece["weight"] + 2 * piece["slope"] * due, F.lit(0.0)))
    return F.least(piece["time"] + F.when(due > 0, 2 * due / (piece["weight"] + root)).otherwise(0.0), F.lit(1.0))


def plan(docs: DataFrame, weights: Callable[[list], dict], schedules: Callable[[list], dict] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = MAX_EPOCHS,
         keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and the columns `keep` of docs: one row per row of `docs`.

    `copies` lists (epoch, words, position): how many words of the document an epoch takes and when, as training time.
    All but the last epoch take whole documents; the last ends inside the document in which the target is met, so each
    source gives exactly its target, rounded. NULL is a source like any other and comes last; NULL, empty and blank
    texts have no words, and no copy takes any. Equal rows, and rows of one id or without, are documents each. `weights` and
    `schedules` get the list of source names, by code point, and return a value per name: like them, the
    table of source sizes is kept by the driver, one row per source. An empty table gives no rows.
    """
    spark, keep = docs.sparkSession, keep or []
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *keep)
                    .withColumns({"h": _place(F.col("doc_id")), "tie": F.xxhash64(F.monotonically_increasing_id())}), "mix-sizes")
    # Python orders by code point; the byte order of UTF-8 in Spark is the same.
    totals = sorted(sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect(),
                    key=lambda r: (r.source is None, r.source or ""))
    names = [r.source for r in totals]
    size_of = {r.source: r["size"] for r in totals}
    target_of = targets(size_of, weights(names), max_epochs)
    schedule_of = schedules(names) if schedules else {}
    per_source = spark.createDataFrame(
        [(r.source, size_of[r.source], target_of[r.source], int(math.floor(target_of[r.source] + 0.5)),
          max(1, -(-r.n // BUCKET_ROWS)), _segments(schedule_of.get(r.source, FLAT))) for r in totals],
        T.StructType.fromDDL("source string, source_size long, target double, words long, buckets long, segments array<struct<"
                             "met: double, time: double, weight: double, slope: double, area: double>>"))
    # Sums run inside hash buckets of a source and over the totals of the buckets: a source of any size is split. A bucket that
    # many rows of one id fill is split again, by a hash of the row.
    rows = sizes.join(per_source, sizes["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    rows = rows.withColumn("bucket", F.floor(F.shiftright("h", 28) * F.col("buckets") / F.lit(1 << 32)).cast("long"))
    full = (rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FULL_BUCKET_ROWS)
            .select(F.col("source").alias("fs"), F.col("bucket").alias("fb"), F.ceil(F.col("n") / BUCKET_ROWS).alias("pieces")))
    rows = (rows.join(full, F.col("source").eqNullSafe(F.col("fs")) & (F.col("bucket") == F.col("fb")), "left").drop("fs", "fb")
            .withColumn("piece", F.coalesce(F.pmod("tie", "pieces"), F.lit(0).cast("long"))))
    inside = Window.partitionBy("source", "bucket", "piece").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket", "piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = (rows.groupBy("source", "bucket", "piece").agg(F.sum("size").alias("bucket_size"))
              .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("piece").alias("p"),
                      F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("begin")))
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        begins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("piece") == F.col("p")))
    at = F.col("begin") + F.col("inside")
    epochs = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)
    left = F.col("words") - epochs * F.col("source_size")

    def copy(epoch: Column) -> Column:
        words = F.when(epoch < epochs, F.col("size")).otherwise(F.least(F.greatest(left - at, F.lit(0)), F.col("size")))
        share = F.when(F.col("words") > 0, (epoch * F.col("source_size") + at) / F.col("words")).otherwise(0.0)
        return F.struct(epoch.alias("epoch"), words.cast("long").alias("words"), _time_at(F.least(share, F.lit(1.0))).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), epochs.cast("long")), copy), lambda c: c["words"] > 0)
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *keep)


def report(docs: DataFrame, weights: Callable[[list], dict], schedules: Callable[[list], dict] | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position (NULL: not taken) for every row."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return plan(docs, weights, schedules, **options).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.try_element_at("copies", F.lit(1))["position"].alias("first_position"))


def mixed(docs: DataFrame, weights: Callable[[list], dict], schedules: Callable[[list], dict] | None = None,
          id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix with their own columns, repeated per copy, range-sorted by training position.

    Documents stay whole: the copy in which a source's target is met counts if at least half of its words do. Each row has
    the copies that were planned for it, whatever its id: rows are told apart by where they lie in their table.
    """
    rows = keyed(docs)
    chosen = plan(rows, weights, schedules, id_col, text_col, keep=ROW_KEY, **options)
    copies = (chosen.select(*[F.col(c).alias(f"__copy{c}") for c in ROW_KEY], "size", F.explode("copies").alias("c"))
              .where(F.col("c.words") * 2 >= F.col("size")).select(*[f"__copy{c}" for c in ROW_KEY], F.col("c.position").alias("__position")))
    same = [rows[c] == copies[f"__copy{c}"] for c in ROW_KEY]
    return rows.join(copies, same).sort("__position", id_col, *ROW_KEY).select(*[rows[c] for c in docs.columns])
