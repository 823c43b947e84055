"""Documents from files and from page tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha1

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import Sql, is_document, quote, strip
from ledgerloom.operators.routing import position, union_origins
from ledgerloom.session import ensure_checkpoint_dir, new_folder
from ledgerloom.sources.commits import Store
from ledgerloom.sources.tables import StateTable


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        .withColumn("file_name", name)
    )


def scan_folders(spark: SparkSession, week_id: str, incoming: str,
                 processed: str | None = None) -> DataFrame:
    """Documents of a week from its incoming folder and its processed category folders.

    The content hash is taken in the scan; `content` is read from disk only if a
    later step selects it or the hash.
    """
    files = _files(spark, incoming, False).withColumn("folder", F.lit(None).cast("string"))
    if processed is None:
        both = union_origins(files, files.limit(0))
    else:
        # One level of category folders below `processed`.
        sorted_files = _files(spark, f"{processed.rstrip('/')}/*/*", False).withColumn(
            "folder", F.element_at(F.split("path", "/"), -2))
        both = union_origins(files, sorted_files)
    return both.selectExpr(
        f"{quote(week_id)} AS week_id", "path", "file_name", "origin", "folder", "content",
        f"{content_hash('content')} AS sha1", f"{position('file_name', 'origin', 'path')} AS seq",
    )


MANIFEST_SCHEMA = "path string, length bigint, modified timestamp, sha1 string"


def manifest(spark: SparkSession, root: str) -> StateTable:
    """What a scan has seen of each file."""
    return StateTable(spark, f"{root}/manifest", MANIFEST_SCHEMA, ("path",))


LISTING_TASKS = 16  # per core, for any number of folders
OPEN_COST = 32 << 10  # bytes that a file counts for besides its own: some thousand small files are opened by one task
PART_FILES = 100_000  # files that the driver lists at once, about
PART_FOLDERS = 16  # folders of the first part; later ones have as many as fit
MAX_FOLDERS = 10_000  # folders that are told apart by the driver; a folder that holds more is listed at once
MAX_PATHS = 1000  # files to open that are named one by one; more are found by a scan of the folders


@contextmanager
def _many_files(spark: SparkSession) -> Iterator[None]:
    """Meanwhile very many files are listed and opened by tasks that get many of them, where Spark would begin a task for each folder or few files.

    Nor does the driver keep lists of files that no one asks for again.
    """
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": LISTING_TASKS * spark.sparkContext.defaultParallelism,
              "spark.sql.sources.parallelPartitionDiscovery.threshold": 1, "spark.sql.files.openCostInBytes": OPEN_COST,
              "spark.sql.hive.filesourcePartitionFileCacheSize": 0}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _load(spark: SparkSession, paths: list[str], recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)


def _below(spark: SparkSession, folder: str) -> list[str]:
    """The folders in a folder, if it holds nothing else that Spark would list; else itself."""
    store = Store(spark, folder)
    if any(c in folder for c in "{}[]*?\\") or not store.exists(""):
        return [folder]
    inside = store.system.listStatus(store._path(""))
    if not 1 < len(inside) <= MAX_FOLDERS:
        return [folder]
    names = {s.getPath().getName(): s.isDirectory() for s in inside}
    seen = {n: d for n, d in names.items() if not n.startswith(".") and (not n.startswith("_") or "=" in n)}
    if not all(seen.values()) or any(c in n for n in seen for c in "{}[]*?\\"):
        return [folder]
    return [f"{store.root}/{n}" for n in sorted(seen)] or [folder]


def _list_in_parts(spark: SparkSession, folders: list[str], recursive: bool, hashed: bool, to: str) -> list[list[str]]:
    """Write (path, length, modified, part, sha1) of all files, of as many folders at once as hold about PART_FILES files; returns the folders of each part."""
    units = list(dict.fromkeys(f for folder in folders for f in (_below(spark, folder) if recursive else [folder])))
    units.sort(key=lambda f: sha1(f.encode()).digest())  # names in order may be of few files first and of many later
    parts: list[list[str]] = []
    step = PART_FOLDERS if recursive else 1
    while units:
        part, units, counted = units[:step], units[step:], Observation()
        _load(spark, part, recursive).select(
            "path", "length", F.col("modificationTime").alias("modified"), F.lit(len(parts)).alias("part"),
            (F.sha1("content") if hashed else F.lit(None).cast("string")).alias("fresh_sha1"),
        ).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(to)
        parts.append(part)
        if recursive:
            step = min(2 * step, max(1, step * PART_FILES // max(1, counted.get["n"])))
    return parts


def scan_changes(spark: SparkSession, folders: list[str], seen: StateTable, scan_id: str, recursive: bool = False) -> DataFrame:
    """(path, length, modified, sha1, change) of every file below the folders, and of those that are gone since the last scan.

    The listing alone (path, length, time) is compared with the manifest `seen`; only files that are new or differ in length or
    time are hashed. Up to MAX_PATHS of them are opened by their paths. More are opened by another scan of their folders, which skips unread
    what lies outside the range of their times and lengths; all of them by the scan that lists them if the manifest is empty. Folders of folders are
    listed in parts, so that the driver holds about PART_FILES files. The manifest is brought up to date under `scan_id`.
    `change` is new, changed, same or gone.
    """
    ensure_checkpoint_dir(spark)
    work = Store(spark, new_folder(spark, "scan"))
    with _many_files(spark):
        rows = _scan_changes(spark, folders, seen, recursive, work).checkpoint()
        work.remove("")
        seen.apply(rows.where("change <> 'same'").withColumn("deleted", F.col("change") == "gone"), scan_id)
    return rows


def _scan_changes(spark: SparkSession, folders: list[str], seen: StateTable, recursive: bool, work: Store) -> DataFrame:
    nothing_known = not seen.log.newest().live
    parts = _list_in_parts(spark, folders, recursive, nothing_known, f"{work.root}/listed")
    listed = spark.read.schema("path string, length bigint, modified timestamp, part int, fresh_sha1 string").parquet(f"{work.root}/listed")
    if nothing_known:
        return listed.select("path", "length", "modified", F.col("fresh_sha1").alias("sha1"), F.lit("new").alias("change"))
    known = seen.read().drop("version")
    both = listed.drop("fresh_sha1").join(known.select("path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), "sha1"), "path", "full")
    change = F.expr("CASE WHEN length IS NULL THEN 'gone' WHEN old_length IS NULL THEN 'new' "
                    "WHEN length <> old_length OR modified <> old_modified THEN 'changed' ELSE 'same' END")
    found = both.withColumn("change", change)
    fresh = F.col("change").isin("new", "changed")
    ranges = found.where(fresh).select("part", "length", F.unix_micros("modified").alias("at")).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("length", "at") for n, f in (("min", F.min), ("max", F.max))]).collect()
    n = sum(r.n for r in ranges)
    if not n:
        hashed = listed.limit(0).select("path", "fresh_sha1")
    elif n <= MAX_PATHS:
        paths = [r.path for r in found.where(fresh).select("path").collect()]
        hashed = _read_content(spark, paths).select("path", F.sha1("content").alias("fresh_sha1"))
    else:
        for r in ranges:
            _load(spark, parts[r.part], recursive).where(
                F.col("modificationTime").between(*[F.timestamp_micros(F.lit(t)) for t in (r.min_at, r.max_at)])
                & F.col("length").between(r.min_length, r.max_length),
            ).select("path", F.sha1("content").alias("fresh_sha1")).write.mode("append").parquet(f"{work.root}/hashed")
        hashed = spark.read.schema("path string, fresh_sha1 string").parquet(f"{work.root}/hashed")
    return found.join(hashed, "path", "left").select(
        "path", F.coalesce("length", "old_length").alias("length"), F.coalesce("modified", "old_modified").alias("modified"),
        F.when(fresh, F.col("fresh_sha1")).otherwise(F.col("sha1")).alias("sha1"), "change")


def _read_content(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, for work that costs far more than reading.

    A scan of as many files as cores, as any large table is, is returned as it is, and so is one
    of few files whose parts are read by as many tasks with about equal numbers of rows.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    if rows.rdd.getNumPartitions() >= cores:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]  # of a few files: no more than their parts
        if max(sizes, default=0) * cores <= 2 * sum(sizes):
            return rows
    return rows.repartition(cores)


def content_hash(content: Sql) -> Sql:
    return f"sha1({content})"


def keep_documents(files: DataFrame) -> DataFrame:
    return files.filter(is_document("file_name"))


def assemble_pages(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """One text per document: its pages in order, joined by line feeds."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(page_no), F.col(text))))
    return pages.groupBy(doc).agg(
        F.array_join(F.transform(gathered, lambda p: p[text]), "\n", "").alias("text"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def has_text_layer(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """Whether any page of a document holds text that is not blank."""
    return pages.groupBy(doc).agg(
        F.expr(f"coalesce(bool_or(length({strip(text)}) > 0), false) AS has_text"))
