"""Streams give the batch result for any split into micro-batches, and survive a repeat."""

from datetime import datetime

import pytest

from ledgerloom.plans.weekly import WeeklyLedger
from ledgerloom.sources.documents import keep_documents
from ledgerloom.streaming import duplicates, ingest
from workload import tables as T

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def _docs(orders):
    return keep_documents(T.receipts_from_orders(orders)).select("week_id", "file_name", "seq", "sha1", "text")


def test_ingest(spark, tmp_path):
    orders = T.load(spark, SF, "orders").filter("o_orderkey < 200")
    batch = WeeklyLedger(spark, str(tmp_path / "batch"), T.rules())
    ingest.batch_step(batch, "all")(_docs(orders), 0)

    job = WeeklyLedger(spark, str(tmp_path / "job"), T.rules())
    for part in ("o_orderkey < 70", "o_orderkey >= 70"):
        orders.filter(part).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.start(_docs(stream), job, str(tmp_path / "check")).awaitTermination()
    for name in ("ledger", "registry", "exports"):
        columns = [c for c in getattr(batch, name).read().columns if c not in ("version", "first_seen_timestamp")]
        assert rows_of(getattr(job, name).read(), *columns) == rows_of(getattr(batch, name).read(), *columns)
    pairs = job.duplicates.read()
    assert pairs.count() == 10

    # A batch that comes again changes nothing.
    before = rows_of(job.registry.read(), "fingerprint", "file_hash", "version")
    ingest.batch_step(job, "documents")(_docs(orders.filter("o_orderkey < 70")), 0)
    assert rows_of(job.registry.read(), "fingerprint", "file_hash", "version") == before
    assert job.duplicates.read().count() == 10


@pytest.mark.parametrize("rows_per_task", [1_000_000, 20])
def test_duplicate_flags(spark, tmp_path, rows_per_task):
    rows = T.purchases_from_events(T.load(spark, SF, "events")).selectExpr(
        "event_id", "ts", "IF(event_id % 3 = 0, 'hot', fingerprint) AS fingerprint", "IF(event_id % 5 = 0, 'same', sha1) AS sha1")
    step = duplicates.batch_step(spark, str(tmp_path), "s", rows_per_task)
    for number, part in enumerate(("day(ts) < 9", "day(ts) BETWEEN 9 AND 21", "day(ts) > 21")):
        step(rows.filter(part), number)
        step(rows.filter(part), number)
    got = rows_of(duplicates.flags_table(spark, str(tmp_path)).read(), "event_id", "previous_id")
    want = rows_of(spark.sql(
        """SELECT event_id, previous_id FROM (
             SELECT event_id, sha1, lag(event_id) OVER w AS previous_id, lag(sha1) OVER w AS previous_sha1
             FROM {rows} WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, event_id))
           WHERE previous_sha1 <> sha1""", rows=rows), "event_id", "previous_id")
    assert got == want and len(got) > 50


def _flags(spark, rows):
    return rows_of(spark.sql(
        """SELECT event_id, previous_id FROM (
             SELECT event_id, sha1, lag(event_id) OVER w AS previous_id, lag(sha1) OVER w AS previous_sha1
             FROM {rows} WINDOW w AS (PARTITION BY fingerprint ORDER BY ts, event_id))
           WHERE previous_sha1 <> sha1""", rows=rows), "event_id", "previous_id")


def test_late_receipts_take_over_flags(spark, tmp_path):
    """After each micro-batch the flags are those of everything seen so far, in any order of arrival."""
    rows = spark.createDataFrame([(n, f"2024-01-{1 + n % 28:02d} 00:00:00", "hot" if n % 2 else f"f{n % 3}", f"s{n % 4 // 2}") for n in range(60)],
                                 "event_id bigint, t string, fingerprint string, sha1 string").selectExpr(
        "event_id", "CAST(t AS TIMESTAMP) AS ts", "fingerprint", "sha1").cache()
    step = duplicates.batch_step(spark, str(tmp_path), "s", 10)
    for number, lot in enumerate((3, 0, 2, 1)):
        step(rows.filter(f"pmod(event_id * 7, 4) = {lot}"), number)
        so_far = rows.filter(f"pmod(event_id * 7, 4) IN ({', '.join(map(str, (3, 0, 2, 1)[:number + 1]))})")
        assert rows_of(duplicates.flags_table(spark, str(tmp_path)).read(), "event_id", "previous_id") == _flags(spark, so_far)


def test_closed_times(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame([(n, datetime(2024, 1, day), "f", sha) for n, day, sha in items], "event_id bigint, ts timestamp, fingerprint string, sha1 string")

    root = str(tmp_path)
    step = duplicates.batch_step(spark, root, "s")
    step(rows((1, 1, "a"), (2, 2, "b"), (3, 3, "a"), (4, 9, "b")), 0)
    duplicates.close(spark, root, datetime(2024, 1, 5), "close")
    assert rows_of(duplicates.state_table(spark, root).read(), "event_id") == [(3,), (4,)]
    step(rows((5, 2, "z"), (6, 6, "c")), 1)
    assert rows_of(duplicates.late_table(spark, root).read(), "event_id") == [(5,)]
    assert rows_of(duplicates.flags_table(spark, root).read(), "event_id", "previous_id") == [(2, 1), (3, 2), (4, 6), (6, 3)]


def test_many_batches_read_a_flat_number_of_files(spark, tmp_path):
    """Fifty micro-batches: the files that a keyed read opens stay few."""
    events = T.purchases_from_events(T.load(spark, SF, "events")).limit(200).cache()
    step = duplicates.batch_step(spark, str(tmp_path), "s")
    opened = []
    for number in range(50):
        rows = events.filter(f"event_id % 50 = {number}")
        state = duplicates.state_table(spark, str(tmp_path))
        opened.append(len(state.log.newest().live))
        step(rows, number)
    assert max(opened) <= 2 * state.fanout
