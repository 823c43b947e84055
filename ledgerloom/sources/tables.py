"""Keyed state tables: the answer cache, the fingerprint registry, the export table and others.

A table is a folder of Parquet segments plus a commit log. A commit writes only its own rows; a later row replaces an earlier
one with the same key when the table is read, and a row marked as deleted removes its key. Whenever FANOUT neighbouring
segments of one level have gathered, they are merged to one of the next level, so a table of n commits has few
segments and each row is rewritten a few times only.

A segment of up to BUCKET_ROWS rows is one folder. A larger one is split by the first bits of the key's hash, as many as its rows
need, so folders keep their size while the table grows. Segments above FILTER_ROWS rows have a Bloom filter: rows of 4 KB bitmaps,
each for a range of the hash. A read by keys joins the keys with the filters and opens only the folders that may hold one of them.

Each commit carries a batch id and is done once, unless a later one takes back what it wrote: after a delete of a
range of the span column (the week), batches with rows of that range can be written again, and the other way round.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.keyed import keep_first, keep_latest
from ledgerloom.schemas import (
    ANSWERS_SCHEMA, CACHE_SCHEMA, DUPLICATES_SCHEMA, EXPORT_SCHEMA, LEDGER_SCHEMA, REGISTRY_SCHEMA, REJECTS_SCHEMA,
)
from ledgerloom.sources.commits import CHECKPOINT, Commit, CommitLog, Segment

BUCKET_ROWS = 1 << 17
FILTER_ROWS = 1 << 14
FILTER_SLOT_ROWS = 1 << 11  # keys per bitmap of 32768 bits with two bits a key: about 1.4 % of absent keys look present
FANOUT = 8
WRITE_TRIES = 10
FEW_KEYS = 200_000  # keys that are sent to the rows of a table; for more of them both are shuffled
_BASE = 1 << 20  # level of a segment that holds everything before it
_BITMAP_BITS = 1 << 15


def sent_if_few(keys: DataFrame) -> DataFrame:
    """Keys to look up in a table, marked to be broadcast if they are few, so that the table need not be shuffled."""
    return F.broadcast(keys) if are_few(keys) else keys


def are_few(keys: DataFrame) -> bool:
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


@dataclass(frozen=True)
class StateTable:
    """`hashed` are the key columns that segments are split by (default: the first key); `span` is a column whose range is kept per segment.

    `by_file` says that a key is the place of a file, which many rows of one write never share: such rows are shuffled once, to
    the folder of their key, and repeats are looked for there.
    """

    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    hashed: tuple[str, ...] = ()
    span: str | None = None
    by_file: bool = False
    fanout: int = FANOUT
    bucket_rows: int = BUCKET_ROWS
    filter_rows: int = FILTER_ROWS
    checkpoint: int = CHECKPOINT

    @cached_property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root, self.checkpoint)

    @cached_property
    def _types(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema)

    def has_batch(self, batch_id: str) -> bool:
        return self.log.find(batch_id) is not None

    def batch(self, batch_id: str) -> DataFrame:
        """The rows one commit wrote: all of them as long as its segment is there, later those that are still in the table."""
        done = self.log.find(batch_id)
        if done is None:
            raise KeyError(f"batch {batch_id} is not in {self.root}")
        if done.own is None:
            return self._scan({}).drop("deleted")
        if self.log.store.exists(f"segments/segment={done.own}"):
            return self._scan({done.own: None}).filter(~F.col("deleted")).drop("deleted")
        return self.read().filter(F.col("version") == done.version)

    def replaced(self, batch_id: str) -> DataFrame:
        """The rows that were live before a commit and that it replaced or deleted."""
        done = self.log.find(batch_id)
        before = [c for c in self.log.recent() if done is not None and c.version == done.version - 1]
        if done is None or not before and done.version > 1:
            raise KeyError(f"{self.root} has no log of batch {batch_id} any more")
        if done.own is None or not before:
            return self._scan({}).drop("deleted")
        keys = sent_if_few(self._scan({done.own: None}).select(*self.keys))
        rows = self._scan(self._folders(list(before[0].live), keys)).join(keys, list(self.keys), "left_semi")
        return keep_latest(rows, list(self.keys), ["version", *self.order]).filter(~F.col("deleted")).drop("deleted")

    # --- segments ---

    def _hash(self) -> Column:
        return F.xxhash64(*(self.hashed or self.keys[:1]))

    @staticmethod
    def _first_bits(h: Column, bits: int) -> Column:
        return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")

    def _scan(self, folders: dict[str, list[int] | None]) -> DataFrame:
        """Rows of segments, of some of their folders or (None) all."""
        full = f"{self.schema}, deleted boolean, version bigint"
        base = f"{self.root}/segments"
        paths = [f"{base}/segment={s}" + ("" if b is None else f"/bucket={b}") for s, of in folders.items() for b in ([None] if of is None else of)]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(f"{full}, segment string, bucket int").option("basePath", base).parquet(*paths).drop("segment", "bucket")

    def _write(self, rows: DataFrame, version: int, level: int, expected: int | None = None, repeats: bool = False) -> Segment:
        """A new segment. Without an expected number of rows it is written as one folder first, and split if it is large.

        With `repeats` only the latest row of each key is kept. Rows that are not yet counted are written as they come then, with no shuffle.
        """
        name = f"{version:010d}-{uuid.uuid4().hex}"
        bits = max(0, math.ceil(math.log2(max(expected or 0, 1) / self.bucket_rows)))
        folder, seen = f"{self.root}/segments/segment={name}", Observation()
        span = F.col(self.span).cast("string") if self.span else F.lit(None).cast("string")
        measures = F.count(F.lit(1)).alias("rows"), F.min(span).alias("low"), F.max(span).alias("high")
        bucket = self._first_bits(self._hash(), bits).cast("int")
        order = list(self.order or self.keys)
        if bits and repeats:
            gathered = rows.withColumn("bucket", bucket).repartition("bucket")
            keep_latest(gathered, ["bucket", *self.keys], order).observe(seen, *measures).write.partitionBy("bucket").parquet(folder)
        elif bits:
            found = rows.observe(seen, *measures).withColumn("bucket", bucket).hint("rebalance", "bucket")
            found.sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(folder)
        else:
            kept = keep_latest(rows, list(self.keys), order) if repeats and expected is not None else rows
            kept.observe(seen, *measures).write.parquet(f"{folder}/bucket=0")
        n = seen.get["rows"]
        left = repeats and expected is None and n > 1
        if left or n > self.bucket_rows << bits and (expected or 0) < n:
            split = self._write(self._scan({name: None}), version, level, n, left)
            self.log.store.remove(f"segments/segment={name}")
            return split
        segment = Segment(name, level, version, n, bits, n > self.filter_rows, seen.get["low"], seen.get["high"])
        if segment.filtered:
            self._write_filter(segment)
        return segment

    def _write_filter(self, segment: Segment) -> None:
        """slot (first `depth` bits of the hash), bucket, bits: which of two positions per key are taken in a slot's bitmap."""
        depth = max(segment.bits, math.ceil(math.log2(segment.rows / FILTER_SLOT_ROWS)), 1)
        hashes = self._scan({segment.name: None}).select(self._hash().alias("h"))
        (hashes.select(self._first_bits(F.col("h"), depth).alias("slot"), F.explode(F.array(*self._positions(F.col("h")))).alias("p"))
         .groupBy("slot").agg(F.bitmap_construct_agg("p").alias("bits"))
         .select("slot", "bits", F.lit(depth).alias("depth"), F.shiftright("slot", depth - segment.bits).cast("int").alias("bucket"))
         .write.parquet(f"{self.root}/filters/segment={segment.name}"))

    @staticmethod
    def _positions(h: Column) -> list[Column]:
        return [h.bitwiseAND(_BITMAP_BITS - 1), F.shiftrightunsigned(h, 15).bitwiseAND(_BITMAP_BITS - 1)]

    def _folders(self, live: list[Segment], keys: DataFrame | None = None) -> dict[str, list[int] | None]:
        """Where rows with some of the keys can be, by the filters of the segments that have one."""
        filtered = [s for s in live if s.filtered]
        hashed = self.hashed or self.keys[:1]
        if keys is None or not filtered or not set(hashed) <= set(keys.columns):
            return {s.name: None for s in live}
        base = f"{self.root}/filters"
        filters = self.spark.read.schema("slot bigint, bits binary, depth int, bucket int, segment string").option("basePath", base).parquet(
            *(f"{base}/segment={s.name}" for s in filtered))
        depths = [max(s.bits, math.ceil(math.log2(s.rows / FILTER_SLOT_ROWS)), 1) for s in filtered]
        wanted = keys.select(self._hash().alias("h")).distinct()
        by_depth = wanted.select("h", F.explode(F.array(*[
            F.struct(F.lit(d).alias("depth"), self._first_bits(F.col("h"), d).alias("slot")) for d in sorted(set(depths))])).alias("at")).select("h", "at.*")
        taken = [F.conv(F.hex(F.substring("bits", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(
            F.pow(F.lit(2), p % 8).cast("int")) > 0 for p in self._positions(F.col("h"))]
        hits = filters.join(by_depth, ["depth", "slot"]).where(taken[0] & taken[1]).select("segment", "bucket").distinct().collect()
        found: dict[str, list[int] | None] = {s.name: None for s in live if not s.filtered}
        for r in hits:  # no more than there are folders
            found.setdefault(r.segment, []).append(r.bucket)
        return found

    # --- reading ---

    def _history(self, keys: DataFrame | None = None) -> DataFrame:
        rows = self._scan(self._folders(list(self.log.newest().live), keys))
        return rows if keys is None else rows.join(keys, keys.columns, "left_semi")

    def read(self, matching: DataFrame | None = None) -> DataFrame:
        """Live rows, with the `version` of the commit that wrote them.

        `matching` holds some of the key columns; only rows with those keys are read
        on, from the folders that may hold them. The kept rows are spread by the whole key, so
        that one hot part of it (such as the fingerprint of empty receipts) does not gather in one task.
        """
        history = self._history(matching)
        if matching is not None:
            history = history.repartition(*self.keys)
        newest = keep_latest(history, list(self.keys), ["version", *self.order])
        return newest.filter(~F.col("deleted")).drop("deleted")

    def _where(self, condition: Column, within: tuple[str, str] | None = None) -> DataFrame:
        """Live rows that meet a condition. Only keys that ever met it, in segments whose span reaches `within`, are looked at again."""
        live = [s for s in self.log.newest().live if within is None or s.may_hold(*within)]
        keys = self._scan({s.name: None for s in live}).filter(condition).select(*self.keys).distinct()
        return self.read(sent_if_few(keys)).filter(condition)

    def having(self, values: DataFrame) -> DataFrame:
        """Live rows with one of some values of other columns. If those are few, only keys that ever had one are looked at again."""
        if not are_few(values):
            return self.read().join(values, values.columns, "left_semi")
        few = F.broadcast(values)
        keys = self._scan({s.name: None for s in self.log.newest().live}).join(few, values.columns, "left_semi").select(*self.keys).distinct()
        return self.read(sent_if_few(keys)).join(few, values.columns, "left_semi")

    @property
    def rows_written(self) -> int:
        """Rows of all segments: at least as many as there are live ones."""
        return sum(s.rows for s in self.log.newest().live)

    # --- writing ---

    def _typed(self, rows: DataFrame, *more: Column) -> DataFrame:
        """The table's columns in its types; a value that has no counterpart there fails with the name of its column."""
        missing = [f.name for f in self._types if f.name not in rows.columns]
        if missing:
            raise ValueError(f"columns {missing} are missing for {self.root}")

        def typed(f: T.StructField) -> Column:
            value, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
            if rows.schema[f.name].dataType == f.dataType:
                return value
            if kind.startswith("decimal") and rows.schema[f.name].dataType.typeName() == "decimal":
                return value.cast(kind).alias(f.name)
            cast = value.try_cast(kind)
            refuse = F.raise_error(F.concat(F.lit(f"column {f.name} of {self.root} takes {kind}, not "), value.cast("string")))
            return F.when(value.isNotNull() & cast.isNull(), refuse.cast(kind)).otherwise(cast).alias(f.name)

        return rows.select(*[typed(f) for f in self._types], *more)

    def _commit(self, make: Callable[[], DataFrame], batch_id: str, kind: str = "put", within: tuple[str, str] | None = None,
                expected: int | None = None, repeats: bool = False) -> None:
        """Write what `make` gives on top of the newest version; if another writer was faster, make it anew on top of that."""
        for _ in range(WRITE_TRIES):
            if self.has_batch(batch_id):
                return
            before = self.log.newest()
            version = before.version + 1
            own = self._write(make().withColumn("version", F.lit(version).cast("bigint")), version, 0, expected, repeats)
            low, high = within or (own.low, own.high)
            live = (*before.live, own) if own.rows else before.live
            if self.log.append(Commit(version, kind, live, batch_id, own.name if own.rows else None, low, high)):
                self._merge_tail()
                return
            self._forget(own)
        raise RuntimeError(f"{self.root}: other writers were faster {WRITE_TRIES} times")

    def _forget(self, segment: Segment) -> None:
        self.log.store.remove(f"segments/segment={segment.name}")
        self.log.store.remove(f"filters/segment={segment.name}")

    def _merge_tail(self) -> None:
        """Merge the newest segments while FANOUT of one level stand at the end."""
        while True:
            before = self.log.newest()
            tail = [s for s in before.live[-self.fanout:] if s.level == before.live[-1].level] if before.live else []
            if len(tail) < self.fanout:
                return
            self._merge(before, len(before.live) - len(tail), tail[0].level + 1)

    def _merge(self, before: Commit, first: int, level: int) -> bool:
        """One segment in place of those from `first` on; marks of deletion are needed while older rows exist."""
        old = before.live[first:]
        rows = keep_latest(self._scan({s.name: None for s in old}), list(self.keys), ["version", *self.order])
        if not first:
            rows = rows.filter(~F.col("deleted"))
        new = replace(self._write(rows, before.version + 1, level, sum(s.rows for s in old)), version=old[-1].version)
        live = (*before.live[:first], new) if new.rows else before.live[:first]
        done = self.log.append(Commit(before.version + 1, "merge", live, gone=tuple(s.name for s in old)))
        if not done:  # another writer went on; it merges, or the next commit does
            self._forget(new)
        return done

    def rows_of(self, batch_id: str) -> int | None:
        """How many rows a commit wrote, as long as its segment is in the log."""
        done = self.log.find(batch_id)
        return None if done is None else next((s.rows for c in self.log.recent() for s in c.live if s.name == done.own), None)

    def upsert(self, rows: DataFrame, batch_id: str, expected: int | None = None) -> None:
        """Insert or replace. The same batch id is written once only. With an expected number of rows they need not be written to be counted."""
        typed = self._typed(rows)
        kept = typed if self.by_file else keep_latest(typed, list(self.keys), list(self.order or self.keys))
        self._commit(lambda: kept.withColumn("deleted", F.lit(False)), batch_id, expected=expected, repeats=self.by_file)

    def apply(self, rows: DataFrame, batch_id: str) -> None:
        """Insert or replace rows, or delete the keys of those whose column `deleted` is true, in one commit."""
        marked = self._typed(rows, F.col("deleted"))
        kept = keep_latest(marked, list(self.keys), list(self.order or self.keys))
        self._commit(lambda: kept, batch_id)

    def merge(self, delta: DataFrame, sums: list[str], batch_id: str) -> None:
        """Add the columns `sums` of `delta` to the live rows of the same keys; rows without a live one are inserted."""
        typed = self._typed(delta)

        def added() -> DataFrame:
            both = typed.unionByName(self.read(typed.select(*self.keys)).select(*self._types.names))
            total = both.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in sums])
            return self._typed(total).withColumn("deleted", F.lit(False))

        self._commit(added, batch_id)

    def insert_ignore(self, rows: DataFrame, batch_id: str, expected: int | None = None) -> None:
        """Insert rows whose key is new; the first row of a key wins."""
        typed = self._typed(rows)

        def new() -> DataFrame:
            fresh = typed
            if self.log.newest().live:
                known = self.read(sent_if_few(typed.select(*self.keys))).select(*self.keys)
                fresh = typed.join(known, list(self.keys), "left_anti")
            return keep_first(fresh, list(self.keys), list(self.order or self.keys)).withColumn("deleted", F.lit(False))

        self._commit(new, batch_id, expected=expected)

    def replace_where(self, rows: DataFrame, condition: Column, batch_id: str) -> None:
        """Put `rows` in the place of all live rows that meet the condition, in one commit."""
        keys = list(self.keys)
        kept = keep_latest(self._typed(rows), keys, list(self.order or self.keys))

        def both() -> DataFrame:
            gone = self._where(condition).select(*self._types.names).join(kept.select(*keys), keys, "left_anti")
            return kept.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)))

        self._commit(both, batch_id)

    def delete(self, condition: Column, batch_id: str, within: tuple[str, str] | None = None) -> int:
        """Delete the live rows that meet the condition; returns how many there were.

        `within` is the range of the span column that the condition lies in: other segments are not read, and
        batches with rows of that range can be written again.
        """
        if within is not None and self.span is None:
            raise ValueError(f"{self.root} keeps no ranges")
        self._commit(lambda: self._where(condition, within).select(*self._types.names).withColumn("deleted", F.lit(True)), batch_id, "delete", within)
        done = self.log.find(batch_id)
        if done.own is None:
            return 0
        if self.log.store.exists(f"segments/segment={done.own}"):
            return self._scan({done.own: None}).count()
        return self._history().filter(F.col("deleted") & (F.col("version") == done.version)).count()

    def compact(self, batch_id: str) -> None:
        """Write the live rows as one new segment; rows keep the version they were written with. Any batch id: nothing is written twice."""
        for _ in range(WRITE_TRIES):
            before = self.log.newest()
            if not before.live or len(before.live) == 1 and before.live[0].level == _BASE or self._merge(before, 0, _BASE):
                return
        raise RuntimeError(f"{self.root}: other writers were faster {WRITE_TRIES} times")

    def vacuum(self) -> int:
        """Delete the segments that no version in the log lists; returns how many. Not while jobs still read old rows."""
        listed = {s.name for c in self.log.recent() for s in c.live} | {c.own for c in self.log.recent()}
        stray = [n for n in self.log.store.names("segments") if n.removeprefix("segment=") not in listed]
        newest = self.log.newest().version
        stray = [n for n in stray if int(n.removeprefix("segment=").split("-")[0]) <= newest]  # later ones are being written
        for name in stray:
            self.log.store.remove(f"segments/{name}")
            self.log.store.remove(f"filters/{name}")
        return len(stray)


def answer_cache(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/answer_cache", CACHE_SCHEMA, ("file_hash",), ("cached_at",))


def registry(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/registry", REGISTRY_SCHEMA, ("fingerprint", "file_hash"), ("week_id", "seq"), span="week_id")


def export_table(spark: SparkSession, root: str) -> StateTable:
    """Each week has an export of its own, in which a file stands once."""
    return StateTable(spark, f"{root}/receipts", EXPORT_SCHEMA, ("week_id", "sha1"), ("seq",), hashed=("sha1",), span="week_id")


def ledger(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/ledger", LEDGER_SCHEMA, ("week_id", "seq"), ("sha1",), hashed=("week_id", "seq"), span="week_id", by_file=True)


def raw_answers(spark: SparkSession, root: str) -> StateTable:
    """Answers as the provider gave them, so that a repeated step asks nothing again."""
    return StateTable(spark, f"{root}/raw_answers", ANSWERS_SCHEMA, ("file_hash",))


def rejects(spark: SparkSession, root: str) -> StateTable:
    """Answers that could not be used, and why."""
    return StateTable(spark, f"{root}/rejects", REJECTS_SCHEMA, ("file_hash", "batch_id"))


def duplicates(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/duplicates", DUPLICATES_SCHEMA, ("week_id", "seq", "kind"), hashed=("week_id", "seq"), span="week_id", by_file=True)


REGISTRY_ORDER = ["version", "week_id", "seq", "file_hash"]
