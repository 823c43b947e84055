"""Scans against a manifest: only new and changed files are opened."""

import hashlib
import os

from pyspark.sql.readwriter import DataFrameReader

from ledgerloom.sources import documents
from workload import files, scratch


def changes(df):
    return sorted((os.path.basename(r.path), r.change, r.sha1) for r in df.collect())


def digest(text):
    return hashlib.sha1(text.encode()).hexdigest()


def test_scans(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.jpg", "b.jpg", "c.jpg"):
        (folder / name).write_text(f"text of {name}")
    seen = documents.manifest(spark, str(tmp_path / "state"))
    first = documents.scan_changes(spark, [str(folder)], seen, "1")
    assert changes(first) == [(n, "new", digest(f"text of {n}")) for n in ("a.jpg", "b.jpg", "c.jpg")]

    opened = []
    read = documents._read_content
    monkeypatch.setattr(documents, "_read_content", lambda spark, paths: opened.append(sorted(map(os.path.basename, paths))) or read(spark, paths))
    assert [c[1] for c in changes(documents.scan_changes(spark, [str(folder)], seen, "2"))] == ["same"] * 3 and opened == []

    (folder / "a.jpg").write_text("longer text of a")
    os.utime(folder / "b.jpg", (1, 1))
    os.remove(folder / "c.jpg")
    (folder / "d.jpg").write_text("d")
    want = [("a.jpg", "changed", digest("longer text of a")), ("b.jpg", "changed", digest("text of b.jpg")),
            ("c.jpg", "gone", digest("text of c.jpg")), ("d.jpg", "new", digest("d"))]
    assert changes(documents.scan_changes(spark, [str(folder)], seen, "3")) == want and opened == [["a.jpg", "b.jpg", "d.jpg"]]
    again = changes(documents.scan_changes(spark, [str(folder)], seen, "4"))
    assert [c[:2] for c in again] == [("a.jpg", "same"), ("b.jpg", "same"), ("d.jpg", "same")]
    (folder / "c.jpg").write_text("back")
    assert ("c.jpg", "new", digest("back")) in changes(documents.scan_changes(spark, [str(folder)], seen, "5"))


def test_many_fresh_files_are_hashed_without_a_list_of_their_paths(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(12):
        (folder / f"{n:02d}.jpg").write_text(f"text {n}")
    os.utime(folder / "03.jpg", (5, 5))
    monkeypatch.setattr(documents, "MAX_PATHS", 4, raising=False)
    monkeypatch.setattr(documents, "_read_content", lambda spark, paths: 1 / 0)
    seen = documents.manifest(spark, str(tmp_path / "state"))
    assert changes(documents.scan_changes(spark, [str(folder)], seen, "1")) == [(f"{n:02d}.jpg", "new", digest(f"text {n}")) for n in range(12)]
    for n in range(6):
        (folder / f"{n:02d}.jpg").write_text(f"new text {n}")
    os.remove(folder / "11.jpg")
    want = [(f"{n:02d}.jpg", "changed" if n < 6 else "gone" if n == 11 else "same", digest(f"new text {n}" if n < 6 else f"text {n}")) for n in range(12)]
    assert changes(documents.scan_changes(spark, [str(folder)], seen, "2")) == want


def test_many_folders_are_listed_and_opened_by_few_tasks(spark, tmp_path):
    for n in range(400):
        (tmp_path / "in" / f"f{n}").mkdir(parents=True)
        (tmp_path / "in" / f"f{n}" / f"{n:03d}.jpg").write_text(f"text {n}")
    settings = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(s) for s in settings]
    seen = documents.manifest(spark, str(tmp_path / "state"))
    spark.sparkContext.setJobGroup("many folders", "")
    try:
        found = changes(documents.scan_changes(spark, [str(tmp_path / "in")], seen, "1", recursive=True))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert found == [(f"{n:03d}.jpg", "new", digest(f"text {n}")) for n in range(400)]
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("many folders") for s in tracker.getJobInfo(j).stageIds}
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert max(tasks) <= 16 * spark.sparkContext.defaultParallelism < 400
    assert [spark.conf.get(s) for s in settings] == before


def test_folders_are_listed_in_parts(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    for n in range(60):
        (folder / f"f{n % 20}").mkdir(parents=True, exist_ok=True)
        (folder / f"f{n % 20}" / f"{n:02d}.jpg").write_text(f"text {n}")
    (folder / "_hidden").mkdir()
    (folder / "_hidden" / "no.jpg").write_text("not listed")
    held, load = [], DataFrameReader.load

    def loaded(self, *args, **options):
        found = load(self, *args, **options)
        held.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(DataFrameReader, "load", loaded)
    monkeypatch.setattr(documents, "MAX_PATHS", 2)
    for name, value in (("PART_FILES", 12), ("PART_FOLDERS", 2)):
        monkeypatch.setattr(documents, name, value, raising=False)
    seen = documents.manifest(spark, str(tmp_path / "state"))
    assert changes(documents.scan_changes(spark, [str(folder)], seen, "1", recursive=True)) == [(f"{n:02d}.jpg", "new", digest(f"text {n}")) for n in range(60)]
    assert max(held) <= 12 and sum(held) == 60  # hashed by the scan that lists them

    held.clear()
    for n in (3, 23, 43):
        (folder / "f3" / f"{n:02d}.jpg").write_text(f"new text {n}")
    os.remove(folder / "f5" / "05.jpg")
    want = [(f"{n:02d}.jpg", "changed" if n % 20 == 3 else "gone" if n == 5 else "same", digest(f"{'new ' if n % 20 == 3 else ''}text {n}")) for n in range(60)]
    assert changes(documents.scan_changes(spark, [str(folder)], seen, "2", recursive=True)) == want
    assert max(held) <= 12 and sum(held) <= 59 + 12  # of one part alone, files are opened


def test_documents_become_files_in_few_folders(spark, tmp_path, monkeypatch):
    texts = {n: None if n == 21 else "" if n == 70 else f"text {n} \u00e9\n" for n in range(200)}
    rows = [*texts.items(), (50, "another text of the same id"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(files, "new_folder", lambda spark, label: str(tmp_path / "root"))
    monkeypatch.setattr(scratch, "FOLDER_FILES", 20, raising=False)
    found = files.scan_manifest(spark, str(tmp_path)).collect()
    want = [(i, True, digest((t or "") + "\0"), "same" if i % 10 else "new") for i, t in rows if i is not None]
    want += [(i, False, digest((t or "") + "\0"), "gone") for i, t in rows if i is not None and i % 7 == 0]
    assert sorted((r.doc_id, r.stays, r.sha1, r.change) for r in found) == sorted(want)
    held = [os.listdir(folder) for top in ("stay", "go") for folder, _, names in os.walk(tmp_path / "root" / top) if names]
    assert sum(map(len, held)) == len(want) and len(held) < len(want) / 4 and max(map(len, held)) <= 20


def test_files_of_a_task_that_fails_are_not_there_twice(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"text {n}") for n in range(30)], "doc_id bigint, text string").coalesce(1)
    write = scratch._file_writer(str(tmp_path / "out"))

    def again(batches):  # as when a task's result is lost, with the rows in another order
        held = list(batches)
        list(write(iter(held)))
        yield from write(b.take(list(range(b.num_rows))[::-1]) for b in held)

    (tmp_path / "out").mkdir()
    named = rows.selectExpr("concat('doc_id=', doc_id) AS name", "CAST(text AS BINARY) AS content")
    assert [r.n for r in named.mapInArrow(again, "n bigint").collect()] == [30]
    names = [f for _, _, found in os.walk(tmp_path / "out") for f in found]
    assert sorted(int(n.split("=")[1]) for n in names) == list(range(30))


def test_no_documents_give_no_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(files, "new_folder", lambda spark, label: str(tmp_path / "root"))
    assert files.scan_manifest(spark, str(tmp_path)).collect() == []
