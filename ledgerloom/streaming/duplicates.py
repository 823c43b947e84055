"""Duplicate flags on a stream: each receipt against the one before with its fingerprint, whenever either arrives.

The receipts of every fingerprint are kept in order in a keyed table between micro-batches. A micro-batch is put between those of
its fingerprints; flags are found anew for its rows and for the rows that now follow one of them, so a late receipt
takes over the flag of its successor: the old flag is retracted or replaced. Previous rows come from the ordered
scan, which splits hot fingerprints, so no single task has to follow a key through the whole stream.

`close` ends a time: what is older goes but for the last receipt of each fingerprint, which later ones are compared with.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.keyed import keep_latest
from ledgerloom.operators.ordered import ROWS_PER_TASK, Ordering, with_previous
from ledgerloom.sources.tables import StateTable

STATE_SCHEMA = "fingerprint string, event_id bigint, ts timestamp, sha1 string"
FLAGS_SCHEMA = "event_id bigint, ts timestamp, fingerprint string, sha1 string, previous_id bigint, previous_sha1 string"


def state_table(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/seen", STATE_SCHEMA, ("fingerprint", "event_id"), ("ts",))


def flags_table(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/flags", FLAGS_SCHEMA, ("event_id",))


def late_table(spark: SparkSession, root: str) -> StateTable:
    """Receipts that came after their time was closed; they get no flag and give none."""
    return StateTable(spark, f"{root}/late", STATE_SCHEMA, ("fingerprint", "event_id"), ("ts",))


def closed_table(spark: SparkSession, root: str) -> StateTable:
    return StateTable(spark, f"{root}/closed", "id int, before timestamp", ("id",))


def flag_changes(rows: DataFrame, known: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Flags of new rows and of those that follow one; `deleted` marks rows that are no duplicate (any more).

    `known` are the receipts seen before of the same fingerprints. A row is a duplicate if the one before it is another file.
    """
    by = Ordering(("fingerprint",), ("ts", "event_id"), rows_per_task)
    new = rows.select("fingerprint", "event_id", "ts", "sha1").withColumn("__new", F.lit(True))
    old = known.select("fingerprint", "event_id", "ts", "sha1").join(rows.select("fingerprint", "event_id"), ["fingerprint", "event_id"], "left_anti")
    seen = with_previous(new.unionByName(old.withColumn("__new", F.lit(False))), by, ["event_id", "sha1", "__new"], "__previous")
    return (
        seen.filter(F.col("__new") | F.coalesce("__previous.__new", F.lit(False)))
        .select("event_id", "ts", "fingerprint", "sha1", F.col("__previous.event_id").alias("previous_id"),
                F.col("__previous.sha1").alias("previous_sha1"),
                (F.col("__previous").isNull() | F.col("__previous.sha1").eqNullSafe(F.col("sha1"))).alias("deleted"), "__new")
        .filter(~F.col("deleted") | ~F.col("__new")).drop("__new")
    )


def batch_step(spark: SparkSession, root: str, stream: str,
               rows_per_task: int = ROWS_PER_TASK) -> Callable[[DataFrame, int], None]:
    def step(rows: DataFrame, number: int) -> None:
        batch_id = f"{stream}-{number}"
        state, flags, closed = state_table(spark, root), flags_table(spark, root), closed_table(spark, root).read().first()
        once = keep_latest(rows, ["fingerprint", "event_id"], ["ts"])
        if closed:
            late_table(spark, root).upsert(once.filter(F.col("ts") < F.lit(closed["before"])), batch_id)
            once = once.filter(F.col("ts") >= F.lit(closed["before"]))
        if not flags.has_batch(batch_id):
            flags.apply(flag_changes(once, state.read(once.select("fingerprint")), rows_per_task), batch_id)
        # The state moves on only after the flags are stored.
        state.upsert(once, batch_id)

    return step


def close(spark: SparkSession, root: str, before: datetime, batch_id: str) -> None:
    """End the time before a moment: of each fingerprint only the last receipt before it is kept. A time once closed stays so."""
    closed, state = closed_table(spark, root), state_table(spark, root)
    now = closed.read().first()
    if now and now["before"] >= before:
        return
    closed.upsert(spark.createDataFrame([(1, before)], "id int, before timestamp"), batch_id)
    older = state.read().filter(F.col("ts") < F.lit(before)).drop("version")
    last = older.groupBy("fingerprint").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    state.apply(older.join(last, ["fingerprint", "event_id"], "left_anti").withColumn("deleted", F.lit(True)), batch_id)


def start(rows: DataFrame, root: str, checkpoint: str, stream: str = "receipts") -> StreamingQuery:
    """`rows` streams (event_id, ts, fingerprint, sha1)."""
    return (
        rows.writeStream.foreachBatch(batch_step(rows.sparkSession, root, stream))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
