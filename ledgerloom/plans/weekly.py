"""The weekly job: documents in, ledger rows, duplicates and reports out."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import quote, source_file
from ledgerloom.operators import answers as A
from ledgerloom.operators import dedup, listing, routing, totals
from ledgerloom.operators.answers import resolve
from ledgerloom.operators.extract import Limits
from ledgerloom.plans.rollups import MaintainedTotals
from ledgerloom.rules import Rules
from ledgerloom.schemas import RECEIPT_COLUMNS
from ledgerloom.sources import tables
from ledgerloom.sources.commits import Store
from ledgerloom.sources.csv import remove_week, write_csv


def extract(docs: DataFrame, rules: Rules, limits: Limits = Limits()) -> DataFrame:
    """Resolve documents from their text alone, without any model."""
    return resolve(docs.withColumn("answer", F.expr(A.disabled_answer())), rules, limits)


def canonical_rows(resolved: DataFrame, notes: str = "") -> DataFrame:
    """The ledger columns, plus week, position and date source. Needs `file_name`."""
    return resolved.selectExpr(
        "*", f"{quote(notes)} AS notes", f"{source_file('file_name')} AS source_file",
    ).select(*RECEIPT_COLUMNS, "week_id", "seq", "date_source")


class Undone(NamedTuple):
    """Registry rows removed, and what becomes of each processed file (None if no files were given)."""

    removed: int
    restore: DataFrame | None


@dataclass
class WeeklyLedger:
    """State under one root folder, and the steps that change it.

    Documents are a DataFrame (week_id, file_name, seq, sha1, text). Each step
    takes a batch id and is done once per id, so a step that failed half way can
    be repeated.
    """

    spark: SparkSession
    root: str
    rules: Rules
    notes: str = ""
    make_provider: Callable[[], A.Provider] | None = None
    cache_all: bool = False
    limits: Limits = Limits()
    calls_per_second: float | None = None
    keep_totals: bool = False
    ledger: tables.StateTable = field(init=False)
    cache: tables.StateTable = field(init=False)
    registry: tables.StateTable = field(init=False)
    exports: tables.StateTable = field(init=False)
    answers: tables.StateTable = field(init=False)
    rejects: tables.StateTable = field(init=False)
    duplicates: tables.StateTable = field(init=False)
    totals: MaintainedTotals = field(init=False)

    def __post_init__(self) -> None:
        self.ledger = tables.ledger(self.spark, self.root)
        self.cache = tables.answer_cache(self.spark, self.root)
        self.registry = tables.registry(self.spark, self.root)
        self.exports = tables.export_table(self.spark, self.root)
        self.answers = tables.raw_answers(self.spark, self.root)
        self.rejects = tables.rejects(self.spark, self.root)
        self.duplicates = tables.duplicates(self.spark, self.root)
        self.totals = MaintainedTotals(self.spark, self.root)

    def _resolved(self, docs: DataFrame, batch_id: str) -> DataFrame:
        if self.make_provider is None:
            return extract(docs, self.rules, self.limits)
        cache = self.cache.read(docs.selectExpr("sha1 AS file_hash"))
        asked = self._asked(batch_id)
        if not self.answers.has_batch(asked):
            spool = f"spool/{hashlib.sha1(asked.encode()).hexdigest()}"
            wanted = A.requests(docs, cache, self.rules, self.limits.prompt_chars)
            self.answers.upsert(A.ask_in_waves(wanted, self.make_provider, f"{self.root}/{spool}", calls_per_second=self.calls_per_second), asked)
            Store(self.spark, self.root).remove(spool)
        raw = self.answers.batch(asked)
        new = raw.selectExpr("file_hash", f"{A.answer_of('response', 'error', self.rules)} AS answer")
        # Answers of this batch count as new, also if an attempt that failed later has cached them.
        earlier = cache.join(raw.select("file_hash"), "file_hash", "left_anti")
        return A.settle(A.with_answers(A.read_texts(docs, self.rules, self.limits), earlier, new))

    def _asked(self, batch_id: str) -> str:
        """The id that a batch's answers are stored under: another one each time the batch was undone, as its files are asked for anew."""
        times = self.ledger.log.times_undone(batch_id)
        return f"{batch_id}, again {times}" if times else batch_id

    def _keep_answers(self, batch_id: str, asked: str) -> None:
        """New answers go to the cache once the ledger has its rows; unusable ones are listed with their reason."""
        if self.make_provider is None:
            return
        raw = self.answers.batch(asked)
        new = raw.selectExpr("file_hash", f"{A.answer_of('response', 'error', self.rules)} AS answer")
        self.cache.upsert(A.cache_rows(new, self.cache_all).withColumn("cached_at", F.current_timestamp()), asked)
        unusable = raw.selectExpr("file_hash", "response", f"coalesce(error, {A.parse_error('response')}) AS error")
        self.rejects.upsert(unusable.where("error IS NOT NULL").withColumn("batch_id", F.lit(batch_id)), asked)

    def process(self, docs: DataFrame, batch_id: str | None = None,
                replace: Column | None = None) -> DataFrame:
        """Write ledger rows of the documents and return them, read back from storage.

        With `replace` the rows take the place of all ledger rows that meet it, as
        when a whole week is processed again.
        """
        batch_id = batch_id or uuid.uuid4().hex
        asked = self._asked(batch_id)
        if not self.ledger.has_batch(batch_id):
            rows = canonical_rows(self._resolved(docs, batch_id), self.notes)
            if replace is None:
                self.ledger.upsert(rows, batch_id)
            else:
                self.ledger.replace_where(rows, replace, batch_id)
        self._keep_answers(batch_id, asked)
        if self.keep_totals:
            self.totals.follow(self.ledger, batch_id)
        return self.ledger.batch(batch_id).drop("version")

    def find_duplicates(self, rows: DataFrame, match: str = "last",
                        ignore_empty: bool = False) -> DataFrame:
        """Duplicates of ledger rows; call before `register`, or rows meet themselves.

        A run over several weeks also compares rows of different weeks.
        """
        marked = dedup.with_fingerprint(rows)
        known = self._registered(marked.select("fingerprint"))
        return dedup.report(marked, known, ["seq"], tables.REGISTRY_ORDER, match, ignore_empty, scope="run")

    def _registered(self, wanted: DataFrame) -> DataFrame:
        """The registry, as far as it has some of the fingerprints. Few are sent to its rows; more than it has rows are not looked up in it first."""
        n = wanted.count()
        if n >= self.registry.rows_written:
            return self.registry.read()
        return self.registry.read(F.broadcast(wanted) if n <= tables.FEW_KEYS else wanted)

    def register(self, rows: DataFrame, batch_id: str) -> None:
        marked = dedup.with_fingerprint(rows).withColumnRenamed("sha1", "file_hash").withColumn(
            "first_seen_timestamp", F.current_timestamp())
        self.registry.upsert(marked, batch_id, self.ledger.rows_of(batch_id))

    def export(self, rows: DataFrame, batch_id: str) -> None:
        self.exports.insert_ignore(rows, batch_id, self.ledger.rows_of(batch_id))

    def reports(self, rows: DataFrame, file_pages: DataFrame, csv_path: str | None = None,
                title_pages: int = 1) -> dict[str, DataFrame]:
        """Summary, line items, list pages, manifest and links; the CSV if a path is given."""
        if csv_path:
            write_csv(rows, csv_path)
        items = listing.line_items(rows)
        months = listing.list_pages(rows, title_pages)
        manifest = listing.package_manifest(rows, file_pages, title_pages)
        return {
            "summary": totals.summary(rows),
            "categories": totals.category_totals(rows),
            "months": totals.month_totals(rows),
            "quality": totals.quality(rows),
            "line_items": items,
            "list_pages": months,
            "manifest": manifest,
            "links": listing.link_table(items, months, manifest),
        }

    def routing(self, files: DataFrame, rows: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
        """Where each file goes, by the category of its ledger row. `files` as from `scan_folders`."""
        placed = files.join(rows.select("week_id", "seq", "category"), ["week_id", "seq"])
        return routing.routing_plan(placed, occupied)

    def repair_duplicates(self, undone: str) -> None:
        """After an undo: stored duplicates of the fingerprints that lost a row are linked anew, to the rows that are left."""
        if self.duplicates.log.newest().version == 0 or self.duplicates.has_batch(f"{undone}, links"):
            return
        lost = self.registry.replaced(undone).select("fingerprint").distinct()
        if lost.isEmpty():
            return
        keys = ["week_id", "seq", "kind"]
        fresh = dedup.relinked(self.registry.read(tables.sent_if_few(lost)))
        stale = self.duplicates.having(lost).drop("version").join(fresh.select(*keys), keys, "left_anti")
        self.duplicates.apply(fresh.withColumn("deleted", F.lit(False)).unionByName(stale.withColumn("deleted", F.lit(True))), f"{undone}, links")

    def undo_week(self, week_id: str, batch_id: str | None = None, processed: DataFrame | None = None,
                  incoming: DataFrame | None = None, csv_path: str | None = None) -> Undone:
        """Take a week out of ledger, registry, export, duplicates, totals and the CSV at `csv_path`; cached answers stay.

        Duplicates in other weeks whose original is gone are linked to what is left.

        Batches that wrote rows of the week count as not done afterwards, so the week can be processed again under the id it had.

        `processed` and `incoming` (week_id, file_name, seq) are the files in their folders now; the
        plan says which processed files go back.
        """
        batch_id = batch_id or uuid.uuid4().hex
        for table in (self.ledger, self.exports, self.duplicates):
            table.delete(F.col("week_id") == week_id, batch_id, (week_id, week_id))
        removed = self.registry.delete(F.col("week_id") == week_id, batch_id, (week_id, week_id))
        self.repair_duplicates(batch_id)
        if self.keep_totals:
            self.totals.undo_week(week_id, batch_id)
        if csv_path:
            remove_week(self.spark, csv_path, week_id)
        if processed is None:
            return Undone(removed, None)
        there = processed.limit(0) if incoming is None else incoming
        return Undone(removed, routing.undo_plan(
            processed.where(F.col("week_id") == week_id), there.select("week_id", "file_name")))
