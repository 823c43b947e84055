"""Keyed tables, duplicates, routing, undo and the weekly job."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, routing
from ledgerloom.operators.extract import Limits
from ledgerloom.plans.weekly import WeeklyLedger
from ledgerloom.rules import Rules
from ledgerloom.sources import tables
from ledgerloom.sources.documents import scan_folders
from ledgerloom.sources.tables import StateTable


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, v int, seq string", ("k",), ("seq",))

    def put(rows, batch):
        table.upsert(spark.createDataFrame(rows, "k string, v int, seq string"), batch)

    assert table.read().count() == 0
    put([("a", 1, "1"), ("a", 2, "2"), ("b", 3, "1")], "one")
    put([("a", 9, "0"), ("c", 4, "1")], "two")
    put([("x", 0, "0")], "two")
    assert rows_of(table.read(), "k", "v") == [("a", 9), ("b", 3), ("c", 4)]
    assert rows_of(table.batch("two"), "k", "v") == [("a", 9), ("c", 4)]
    table.insert_ignore(spark.createDataFrame([("a", 0, "1"), ("d", 6, "2"), ("d", 5, "1")], "k string, v int, seq string"), "three")
    assert table.delete(F.col("k") == "b", "four") == 1
    assert table.delete(F.col("k") == "b", "four") == 1
    want = [("a", 9, 2), ("c", 4, 2), ("d", 5, 3)]
    assert rows_of(table.read(), "k", "v", "version") == want
    table.compact("pack")
    assert rows_of(table.read(), "k", "v", "version") == want
    put([("b", 7, "1")], "five")
    table.replace_where(spark.createDataFrame([("e", 1, "1")], "k string, v int, seq string"), F.col("v") >= 7, "six")
    assert rows_of(table.read(), "k", "v") == [("c", 4), ("d", 5), ("e", 1)]
    wanted = spark.createDataFrame([("e",), ("c",), ("c",), ("b",), ("none",)], "k string")
    assert rows_of(table.read(wanted), "k", "v") == [("c", 4), ("e", 1)]


def test_deleted_rows_do_not_come_back(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, week string", ("k",))
    table.upsert(spark.createDataFrame([("a", "w1")], "k string, week string"), "1")
    table.upsert(spark.createDataFrame([("a", "w2")], "k string, week string"), "2")
    assert table.delete(F.col("week") == "w1", "3") == 0
    assert table.delete(F.col("week") == "w2", "4") == 1
    assert table.read().count() == 0


def test_many_commits_leave_few_segments(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, v int", ("k",), fanout=3, bucket_rows=4, checkpoint=4)
    for n in range(14):
        table.upsert(spark.createDataFrame([(f"k{n % 5}", n), (f"only{n}", n)], "k string, v int"), str(n))
    assert len(table.log.newest().live) <= 5
    want = [(f"k{k}", 10 + k if k < 4 else 9) for k in range(5)] + [(f"only{n}", n) for n in range(14)]
    assert rows_of(table.read(), "k", "v") == sorted(want, key=str)
    assert table.has_batch("3") and rows_of(table.batch("3"), "k", "v") == [("k3", 3), ("only3", 3)]
    assert table.delete(F.col("v") == 13, "gone") == 2
    for n in range(3):
        table.upsert(spark.createDataFrame([("x", n)], "k string, v int"), f"later{n}")
    want = sorted([w for w in want if w[1] != 13] + [("x", 2)], key=str)
    assert rows_of(table.read(), "k", "v") == want
    assert table.vacuum() > 0
    assert rows_of(table.read(), "k", "v") == want and rows_of(table.batch("later2"), "k", "v") == [("x", 2)]


def test_log_stays_short_and_remembers_batches(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, week string", ("k",), span="week", checkpoint=5, fanout=4)
    for n in range(18):
        table.upsert(spark.createDataFrame([(f"k{n}", f"w{n % 3}")], "k string, week string"), str(n))
    assert len(table.log.store.names("log")) <= 5 + 8 + 1 and len(table.log.store.names("batches")) <= 2
    assert all(table.has_batch(str(n)) for n in range(18)) and not table.has_batch("18")
    table.upsert(spark.createDataFrame([("other", "w1")], "k string, week string"), "0")
    assert table.read().count() == 18
    assert table.delete(F.col("week") == "w0", "undo", ("w0", "w0")) == 6
    assert [table.has_batch(str(n)) for n in range(4)] == [False, True, True, False] and table.log.times_undone("0") == 1
    table.upsert(spark.createDataFrame([("k0", "w0")], "k string, week string"), "0")
    assert table.has_batch("0") and not table.has_batch("undo") and table.read().count() == 13
    # A batch whose segment was merged and vacuumed still gives its rows.
    for n in range(20, 30):
        table.upsert(spark.createDataFrame([(f"k{n}", "w9")], "k string, week string"), str(n))
    table.vacuum()
    assert rows_of(table.batch("5"), "k") == [("k5",)]


def test_two_writers_of_one_version(spark, tmp_path):
    one = StateTable(spark, str(tmp_path / "t"), "k string, v int", ("k",))
    two = StateTable(spark, str(tmp_path / "t"), "k string, v int", ("k",))
    one.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), "1")
    write, tried = StateTable._write, []

    def slow(self, rows, *args):
        if not tried:  # the other writer commits the same key while the first one writes
            tried.append(1)
            two.insert_ignore(spark.createDataFrame([("b", 2)], "k string, v int"), "2")
        return write(self, rows, *args)

    StateTable._write = slow
    try:
        one.insert_ignore(spark.createDataFrame([("b", 3), ("c", 3)], "k string, v int"), "3")
    finally:
        StateTable._write = write
    assert rows_of(one.read(), "k", "v", "version") == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3)]


def test_types_are_checked_before_anything_is_written(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, v int", ("k",))
    table.upsert(spark.createDataFrame([(7, 1)], "k bigint, v bigint"), "1")
    assert rows_of(table.read(), "k", "v") == [("7", 1)]
    with pytest.raises(Exception, match="column v of .* takes int, not 99999999999"):
        table.upsert(spark.createDataFrame([(8, 99999999999)], "k bigint, v bigint"), "2")
    with pytest.raises(ValueError, match="columns \\['v'\\] are missing"):
        table.upsert(spark.createDataFrame([("x",)], "k string"), "3")
    assert rows_of(table.read(), "k", "v") == [("7", 1)] and not table.has_batch("2")


def test_reads_open_only_folders_that_may_hold_their_keys(spark, tmp_path):
    """10 million rows in 77 folders or more: keys that are new open next to nothing, known keys one folder each."""
    table = StateTable(spark, str(tmp_path / "t"), "k string, v int", ("k",))
    table.upsert(spark.range(10_000_000).selectExpr("CAST(id AS STRING) AS k", "CAST(id % 1000 AS INT) AS v"), "1")
    [segment] = table.log.newest().live
    assert segment.bits >= 6 and segment.rows == 10_000_000
    table.upsert(spark.range(5).selectExpr("concat('late', id) AS k", "0 AS v"), "2")
    every = len(table._scan({s.name: None for s in table.log.newest().live}).inputFiles())

    def opened(keys):
        return len(table._history(keys).inputFiles())

    new = spark.range(1000).selectExpr("concat('new', id) AS k")
    known = spark.createDataFrame([("7",), ("77",), ("late3",)], "k string")
    assert every >= 65 and opened(new) <= 1000 * 0.05 + 2 and opened(known) <= 2 + 3 + 1
    assert rows_of(table.read(known), "k", "v") == [("7", 7), ("77", 77), ("late3", 0)] and table.read(new).count() == 0


def test_small_folders_split_and_keep_all_keys(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, v int", ("k",), fanout=3, bucket_rows=50, filter_rows=20)
    for n in range(4):
        table.upsert(spark.range(n * 100, n * 100 + 200).selectExpr("CAST(id AS STRING) AS k", f"{n} AS v"), str(n))
    assert max(s.bits for s in table.log.newest().live) >= 2
    keys = spark.range(0, 600, 7).selectExpr("CAST(id AS STRING) AS k")
    want = sorted(((str(k), min(k // 100, 3)) for k in range(0, 500, 7)), key=str)
    assert rows_of(table.read(keys), "k", "v") == want


def test_delete_reads_only_segments_whose_span_reaches_it(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k string, week string", ("k",), span="week")
    for n in range(3):
        table.upsert(spark.range(100).selectExpr(f"concat('{n}-', id) AS k", f"'w{n}' AS week"), str(n))
    where = table._where(F.col("week") == "w1", ("w1", "w1"))
    assert "LeftSemi" in where._jdf.queryExecution().optimizedPlan().toString()
    assert {f for f in where.inputFiles()} == {f for f in table._scan({s.name: None for s in table.log.newest().live}).inputFiles()}
    assert table.delete(F.col("week") == "w1", "gone", ("w1", "w1")) == 100 and table.read().count() == 200
    with pytest.raises(ValueError, match="ranges"):
        StateTable(spark, str(tmp_path / "u"), "k string", ("k",)).delete(F.lit(True), "x", ("a", "b"))


BATCH = "week_id string, seq string, date string, vendor string, amount double, source_file string, sha1 string"


def _batch(spark, rows):
    return dedup.with_fingerprint(spark.createDataFrame(rows, BATCH))


@pytest.mark.parametrize("rows_per_task", [1_000, 2])
def test_duplicates_in_a_batch_compare_with_the_row_before(spark, rows_per_task):
    batch = _batch(spark, [
        ("w1", str(i), "2024-01-01", v, 5.0, f"{i}.pdf", h)
        for i, (v, h) in enumerate([("A", "x"), ("a ", "y"), ("A", "y"), ("A", "x"), ("B", "z")])
    ] + [("w2", "9", "2024-01-01", "A", 5.0, "9.pdf", "q")])
    got = dedup.in_batch(batch, ["seq"], rows_per_task)
    assert rows_of(got, "source_file", "original_file") == [("1.pdf", "0.pdf"), ("3.pdf", "2.pdf")]


def test_rows_without_any_value_are_alike(spark):
    batch = _batch(spark, [("w", "1", None, None, None, "1.pdf", "x"), ("w", "2", "", " ", None, "2.pdf", "y")])
    assert dedup.in_batch(batch, ["seq"]).count() == 1
    assert dedup.in_batch(batch, ["seq"], ignore_empty=True).count() == 0


def test_registry_matches(spark):
    batch = _batch(spark, [("w3", "1", "d", "V", 1.0, "now.pdf", "h2"), ("w3", "2", "d", "V", 1.0, "new.pdf", "h9")])
    known = _batch(spark, [("w1", "1", "d", "V", 1.0, "one.pdf", "h1"), ("w2", "2", "d", "V", 1.0, "two.pdf", "h2")])
    known = known.withColumnRenamed("sha1", "file_hash")
    shown = ["source_file", "original_file", "original_week"]
    assert rows_of(dedup.across_weeks(batch, known, ["seq"]), *shown) == [("new.pdf", "two.pdf", "w2")]
    assert rows_of(dedup.across_weeks(batch, known, ["seq"], match="any"), *shown) == [
        ("new.pdf", "two.pdf", "w2"), ("now.pdf", "one.pdf", "w1")]
    both = dedup.report(batch, known, ["seq"], ["seq"])
    assert rows_of(both, "source_file", "kind", "seen_in") == [
        ("new.pdf", "batch", "same week"), ("new.pdf", "registry", "week w2")]


def test_routing(spark):
    files = spark.createDataFrame([
        ("w", "a.pdf", "Food/Grocery", "1111111111", "incoming", None, "1"),
        ("w", "a.pdf", "Food/Grocery", "2222222222", "processed", "other", "2"),
        ("w", "b.pdf", "Food/Grocery", "3333333333", "processed", "food-grocery", "3"),
        ("w", "b.pdf", "Food/Grocery", "4444444444", "incoming", None, "4"),
        ("w", "c.tar.gz", "Hotel", "5555555555", "incoming", None, "5"),
    ], "week_id string, file_name string, category string, sha1 string, origin string, folder string, seq string")
    taken = spark.createDataFrame([("w", "hotel", "c.tar.gz")], "week_id string, category_slug string, file_name string")
    assert rows_of(routing.routing_plan(files, taken), "seq", "action", "target_name") == [
        ("1", "move", "a.pdf"), ("2", "reroute", "a_22222222.pdf"), ("3", "stay", "b.pdf"),
        ("4", "move", "b_44444444.pdf"), ("5", "move", "c.tar_55555555.gz")]


def test_undo_plan(spark):
    schema = "week_id string, file_name string, seq string"
    processed = spark.createDataFrame([("w", "a.pdf", "1"), ("w", "a.pdf", "2"), ("w", "b.pdf", "3"), ("w", "n.txt", "4")], schema)
    incoming = spark.createDataFrame([("w", "b.pdf", "9")], schema)
    assert rows_of(routing.undo_plan(processed, incoming), "seq", "action") == [("1", "move"), ("2", "skip"), ("3", "skip")]


def test_folder_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "done" / "meals").mkdir(parents=True)
    for name in ("in/b.JPG", "in/a.txt", "in/c.pdf", "done/meals/b.JPG"):
        (tmp_path / name).write_bytes(name.encode())
    got = scan_folders(spark, "w", str(tmp_path / "in"), str(tmp_path / "done"))
    assert [tuple(r) for r in got.orderBy("seq").select("file_name", "origin", "folder").collect()] == [
        ("b.JPG", "incoming", None), ("b.JPG", "processed", "meals"), ("c.pdf", "incoming", None)]
    import hashlib
    assert hashlib.sha1(b"in/c.pdf").hexdigest() in {r["sha1"] for r in got.collect()}
    assert scan_folders(spark, "w", str(tmp_path / "in")).count() == 2


def _docs(spark, rows):
    docs = spark.createDataFrame(rows, "week_id string, file_name string, text string")
    return docs.selectExpr("*", "file_name AS seq", "sha1(text) AS sha1")


def test_weekly_job(spark, tmp_path):
    def provider():
        return lambda prompts: ['{"vendor": "Model", "category": "x", "confidence": 0.9}' if "known" in p else "?" for p in prompts]

    job = WeeklyLedger(spark, str(tmp_path / "job"), Rules(categories=("X",)), "note", provider)
    week1 = _docs(spark, [("w1", "a.jpg", "Shop One\n2024-01-01\ntotal 5.00"), ("w1", "b.pdf", "known")])
    rows = job.process(week1, "1")
    assert rows_of(rows, "source_file", "vendor", "category", "notes") == [
        ("a.pdf", "Shop One", "Uncategorized", "note"), ("b.pdf", "Model", "X", "note")]
    assert job.find_duplicates(rows).count() == 0
    job.register(rows, "1")
    job.export(rows, "1")
    assert rows_of(job.cache.read(), "vendor", "confidence") == [("Model", 0.9)]

    week2 = _docs(spark, [("w2", "c.jpg", "Shop One\n2024-01-01\ntotal 5.00\ncopy")])
    again = job.process(week2, "2")
    assert rows_of(job.find_duplicates(again), "source_file", "original_file", "seen_in") == [("c.pdf", "a.pdf", "week w1")]
    job.register(again, "2")
    before = rows_of(job.registry.read(), "fingerprint", "file_hash", "week_id")
    job.register(again, "2")
    assert rows_of(job.registry.read(), "fingerprint", "file_hash", "week_id") == before

    job.export(again, "2")
    job.duplicates.upsert(job.find_duplicates(again), "2")
    files = _docs(spark, [("w2", "c.jpg", "x"), ("w2", "d.jpg", "x")]).drop("text", "sha1")
    undone = job.undo_week("w2", "undo", files, files.filter("file_name = 'd.jpg'"))
    assert undone.removed == 1
    assert rows_of(undone.restore, "file_name", "action") == [("c.jpg", "move"), ("d.jpg", "skip")]
    assert rows_of(job.exports.read(), "week_id") == [("w1",), ("w1",)] and job.duplicates.read().count() == 0
    assert rows_of(job.registry.read(), "week_id") == [("w1",), ("w1",)]
    assert rows_of(job.ledger.read(), "week_id") == [("w1",), ("w1",)]
    assert job.cache.read().count() == 1

    replaced = job.process(_docs(spark, [("w1", "z.jpg", "Shop Two")]), "3", F.col("week_id") == "w1")
    assert rows_of(job.ledger.read(), "source_file") == rows_of(replaced, "source_file") == [("z.pdf",)]
    pages = spark.createDataFrame([("w1", "z.pdf", 3, "1")], "week_id string, source_file string, pages int, seq string")
    reports = job.reports(job.ledger.read(), pages, str(tmp_path / "csv"))
    assert rows_of(reports["links"], "list_page", "target_page") == [(1, 2)]
    assert rows_of(reports["manifest"], "start_page") == [(2,)]
    assert set(reports) == {"summary", "categories", "months", "quality", "line_items", "list_pages", "manifest", "links"}


def test_routing_of_a_processed_week(spark, tmp_path):
    job = WeeklyLedger(spark, str(tmp_path / "job"), Rules(categories=("X",)))
    docs = _docs(spark, [("w1", "a.jpg", "Shop One"), ("w1", "b.pdf", "Shop Two")])
    rows = job.process(docs, "1")
    files = docs.selectExpr("week_id", "file_name", "sha1", "'incoming' AS origin", "CAST(NULL AS STRING) AS folder", "seq")
    assert rows_of(job.routing(files, rows), "file_name", "category_slug", "action") == [
        ("a.jpg", "uncategorized", "move"), ("b.pdf", "uncategorized", "move")]


def test_a_failed_ledger_write_can_be_repeated(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider():
        def answer(prompts):
            (calls / uuid.uuid4().hex).touch()
            if any("bad" in p for p in prompts):
                raise RuntimeError("down")
            return ['{"vendor": "Model", "confidence": 0.9}' if "known" in p else '{"vendor": "Weak", "confidence": 0.1}' for p in prompts]

        return answer

    docs = _docs(spark, [("w1", "a.jpg", "known"), ("w1", "b.jpg", "Shop Two"), ("w1", "c.jpg", "bad luck")])
    job = WeeklyLedger(spark, str(tmp_path / "job"), Rules(), "", provider)
    whole = WeeklyLedger(spark, str(tmp_path / "whole"), Rules(), "", provider)
    want = rows_of(whole.process(docs, "1"), "source_file", "vendor", "matcher")

    def fails(self, rows, batch_id):
        if self.root.endswith("ledger"):
            raise OSError("disk")
        return upsert(self, rows, batch_id)

    upsert = StateTable.upsert
    monkeypatch.setattr(StateTable, "upsert", fails)
    with pytest.raises(OSError):
        job.process(docs, "1")
    monkeypatch.setattr(StateTable, "upsert", upsert)
    asked = len(list(calls.iterdir()))
    assert rows_of(job.process(docs, "1"), "source_file", "vendor", "matcher") == want
    assert len(list(calls.iterdir())) == asked
    assert rows_of(job.rejects.read(), "error", "batch_id") == [("RuntimeError: down", "1")]
    assert rows_of(job.cache.read(), "vendor") == [("Model",)]


def test_limits_reach_the_job(spark, tmp_path):
    text = "\n".join(["Shop"] + ["TOTAL: $1.00"] * 5 + ["TOTAL: $9.00"])
    docs = _docs(spark, [("w1", "a.jpg", text)])
    cut = WeeklyLedger(spark, str(tmp_path / "cut"), Rules())
    whole = WeeklyLedger(spark, str(tmp_path / "whole"), Rules(), limits=Limits(amount_candidates=None, vendor_lines=None))
    assert rows_of(cut.process(docs, "1"), "amount") == [(1.0,)]
    assert rows_of(whole.process(docs, "1"), "amount") == [(9.0,)]


def test_a_week_under_its_id_again_with_a_model_and_csv(spark, tmp_path):
    """After an undo the same id asks for what was not cached, and CSV, totals and duplicates follow."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def provider():
        def answer(prompts):
            for _ in prompts:
                (asked / uuid.uuid4().hex).touch()
            return ['{"vendor": "Model", "confidence": 0.9}' if "known" in p else '{"vendor": "Weak", "confidence": 0.1}' for p in prompts]

        return answer

    job = WeeklyLedger(spark, str(tmp_path / "job"), Rules(), "", provider, keep_totals=True)
    docs = _docs(spark, [("w1", "a.jpg", "known\nTOTAL: $5.00"), ("w1", "b.jpg", "Shop Two\nTOTAL: $7.00")])

    def whole():
        rows = job.process(docs, "w1")
        job.register(rows, "w1")
        job.export(rows, "w1")
        job.reports(rows, spark.createDataFrame([], "week_id string, source_file string, pages int, seq string"), str(tmp_path / "csv"))
        return rows_of(rows, "source_file", "vendor", "amount")

    first = whole()
    assert whole() == first and len(list(asked.iterdir())) == 2
    job.undo_week("w1", csv_path=str(tmp_path / "csv"))
    assert job.ledger.read().count() == job.exports.read().count() == job.registry.read().count() == job.totals.categories().count() == 0
    assert not [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("week_id")]
    assert whole() == first and len(list(asked.iterdir())) == 3
    assert job.ledger.read().count() == job.exports.read().count() == job.registry.read().count() == 2
    assert rows_of(job.totals.categories(), "total", "n_rows") == [(12.0, 2)]
    assert [p.name for p in (tmp_path / "csv").iterdir() if p.name.startswith("week_id")] == ["week_id=w1"]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 3])
def test_targets_are_unique_for_adversarial_names(spark, rows_per_task):
    """Names that look like the ones that are made up: own, with hashes, with numbers, taken and arriving."""
    h = "abcdef0123456789"
    names = ["a.jpg"] * 6 + ["a_abcdef01.jpg"] * 3 + ["a_abcdef01_2.jpg", "a_abcdef01_3.jpg", "a_abcdef01_2_abcdef01.jpg", "b", "b", "b", ".c", ".c", "d."]
    files = spark.createDataFrame([("w", n, "X", h, "incoming", None, f"{i:03d}") for i, n in enumerate(names)],
                                  "week_id string, file_name string, category string, sha1 string, origin string, folder string, seq string")
    taken = spark.createDataFrame([("w", "x", n) for n in ("a_abcdef01_4.jpg", "b_abcdef01_2", "a_abcdef01_abcdef01_2.jpg")],
                                  "week_id string, category_slug string, file_name string")
    found = rows_of(routing.routing_plan(files, taken, rows_per_task), "seq", "target_name")
    targets = [t for _, t in found] + [r.file_name for r in taken.collect()]
    assert len(found) == len(names) and len(set(targets)) == len(targets)
    assert dict(found)["000"] == "a.jpg" and dict(found)["012"] == "b" and {dict(found)["013"], dict(found)["014"]} == {"b_abcdef01", "b_abcdef01_3"}


_FILES = "week_id string, file_name string, category string, sha1 string, origin string, folder string, seq string"


def test_a_routing_plan_reads_its_files_twice_at_most(spark, tmp_path):
    """Once for the plan, once for numbers in use; and a file is in the plan also without a category."""
    rows = [("w", "a.jpg", c, "abcdef0123", "incoming", None, s) for c, s in (("X", "1"), ("X", "2"), ("X", "3"), (None, "4"))]
    spark.createDataFrame(rows, _FILES).write.parquet(str(tmp_path / "files"))
    plan = routing.routing_plan(spark.read.parquet(str(tmp_path / "files")))
    assert rows_of(plan, "seq", "target_name") == [("1", "a.jpg"), ("2", "a_abcdef01.jpg"), ("3", "a_abcdef01_2.jpg"), ("4", "a.jpg")]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2


def test_numbers_past_long_runs_of_taken_ones(spark):
    files = spark.createDataFrame([("w", "d.", "X", "abcdef0123", "incoming", None, f"{i:03d}") for i in range(40)], _FILES)
    used = {2, 3, 4, 7, 11, 12, 13, 30}
    taken = spark.createDataFrame([("w", "x", f"d._abcdef01_{n}") for n in used], "week_id string, category_slug string, file_name string")
    free = [n for n in range(2, 60) if n not in used][:38]
    assert [t for _, t in rows_of(routing.routing_plan(files, taken), "seq", "target_name")] == [
        "d.", "d._abcdef01", *[f"d._abcdef01_{n}" for n in free]]


def test_equal_names_in_two_weeks_have_an_order(spark, tmp_path):
    exports = tables.export_table(spark, str(tmp_path / "s"))
    columns = [f.strip() for f in tables.EXPORT_SCHEMA.split(",")]
    rows = spark.createDataFrame([("w2", "1", "h", "two"), ("w1", "1", "h", "one"), ("w1", "2", "h", "late")],
                                 "week_id string, seq string, sha1 string, vendor string")
    full = rows.selectExpr(*[c.split(" ")[0] if c.split(" ")[0] in rows.columns else f"CAST(NULL AS {c.split(' ')[1]}) AS {c.split(' ')[0]}"
                             for c in columns])
    exports.insert_ignore(full, "1")
    assert rows_of(exports.read(), "week_id", "vendor") == [("w1", "one"), ("w2", "two")]


def test_cache_keeps_the_newest_answer(spark, tmp_path):
    cache = tables.answer_cache(spark, str(tmp_path / "s"))
    for batch, vendor in (("1", "old"), ("2", "new")):
        cache.upsert(spark.createDataFrame([("h", vendor)], "file_hash string, vendor string").selectExpr(
            "*", "'' AS date", "'' AS category", "1D AS confidence", "'' AS reasoning", "current_timestamp() AS cached_at"), batch)
    assert rows_of(cache.read(), "vendor") == [("new",)]


def test_few_keys_do_not_shuffle_the_table(spark, tmp_path):
    """The rows of a week are found by keys sent to the table: no exchange lies between its scan and the join with them."""
    state = tables.ledger(spark, str(tmp_path))
    rows = spark.range(50).selectExpr(*[f"CAST(CAST(id AS STRING) AS {f.dataType.simpleString()}) AS {f.name}" for f in state._types if f.name != "week_id"],
                                      "concat('w', id % 5) AS week_id")
    state.upsert(rows, "all")
    found = state._where(F.col("week_id") == "w1")
    assert found.count() == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_an_expected_number_of_rows_is_written_once(spark, tmp_path, monkeypatch):
    written = []
    write = tables.StateTable._write
    monkeypatch.setattr(tables.StateTable, "_write", lambda self, *a: written.append(a[1:]) or write(self, *a))
    rows = spark.range(64).selectExpr("CAST(id AS STRING) AS k", "id AS v")
    state = tables.StateTable(spark, str(tmp_path / "a"), "k string, v bigint", ("k",), bucket_rows=16)
    state.upsert(rows, "all", expected=64)
    assert len(written) == 1 and state.read().count() == 64 and state.rows_of("all") == 64
    state.upsert(rows.withColumn("v", F.lit(0).cast("bigint")), "fewer expected", expected=10)
    assert len(written) == 3 and {r.v for r in state.read().collect()} == {0} and state.log.newest().live[-1].bits == 2


def _pairs(spark, path):
    spark.createDataFrame([("w1", "1", "a"), ("w1", "2", "b"), ("w2", "3", "a")], "week_id string, seq string, sha1 string").selectExpr(
        "*", "'d' AS date", "'v' AS vendor", "1D AS amount", "concat('f', seq) AS source_file").write.parquet(path)
    return dedup.with_fingerprint(spark.read.parquet(path))


def test_both_kinds_of_duplicate_take_one_reading_of_the_rows(spark, tmp_path):
    rows = _pairs(spark, str(tmp_path / "rows"))
    known = spark.createDataFrame([("b", "w0", "1")], "file_hash string, week_id string, seq string").selectExpr(
        "*", "'d' AS date", "'v' AS vendor", "1D AS amount", "'f0' AS source_file")
    found = dedup.report(rows, dedup.with_fingerprint(known), ["seq"], ["week_id", "seq"], scope="run")
    assert rows_of(found, "seq", "kind", "original_file") == [
        ("1", "registry", "f0"), ("2", "batch", "f1"), ("3", "batch", "f2"), ("3", "registry", "f0")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_rows_of_files_are_written_as_they_come_and_compared_in_their_folders(spark, tmp_path):
    rows = spark.range(64).selectExpr("concat('s', id % 60) AS k", "id AS v").repartition(4)
    for name, expected in (("counted", 64), ("not counted", None), ("too few", 10)):
        state = tables.StateTable(spark, str(tmp_path / name), "k string, v bigint", ("k",), ("v",), by_file=True, bucket_rows=8)
        state.upsert(rows, "all", expected)
        assert rows_of(state.batch("all"), "k", "v") == sorted(((f"s{i}", i + 60 if i < 4 else i) for i in range(60)), key=str)
        assert state.rows_of("all") == 60 and state.log.newest().live[-1].bits == 3
    small = tables.StateTable(spark, str(tmp_path / "small"), "k string, v bigint", ("k",), ("v",), by_file=True)
    small.upsert(rows, "all")
    assert small.batch("all").count() == small.rows_of("all") == 60


def test_rows_having_a_value_are_found_by_their_keys(spark, tmp_path):
    state = tables.StateTable(spark, str(tmp_path / "h"), "k string, v string", ("k",))
    state.upsert(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "k string, v string"), "1")
    state.upsert(spark.createDataFrame([("b", "z")], "k string, v string"), "2")
    assert rows_of(state.having(spark.createDataFrame([("x",)], "v string")), "k", "v") == [("a", "x")]
