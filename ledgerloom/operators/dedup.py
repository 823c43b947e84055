"""Duplicate receipts: inside a batch, and against the registry of earlier batches.

Rows are the same receipt when date, vendor and amount agree; they are duplicates
when the file hashes differ (the same file again is only a re-run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import Sql, fingerprint
from ledgerloom.operators.keyed import keep_latest
from ledgerloom.operators.ordered import ROWS_PER_TASK, Ordering, with_previous

_ORIGINAL = ["week_id", "date", "vendor", "amount", "source_file"]


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", F.expr(fingerprint("date", "vendor", "amount")))


def _all_missing() -> Column:
    return F.expr("fingerprint = sha2('||', 256)")


def _with_previous(rows: DataFrame, order: list[str], rows_per_task: int, scope: str) -> DataFrame:
    if scope == "week":
        by = Ordering(("week_id", "fingerprint"), (*order, "sha1"), rows_per_task)
    elif scope == "run":
        by = Ordering(("fingerprint",), ("week_id", *order, "sha1"), rows_per_task)
    else:
        raise ValueError("scope is 'week' or 'run'")
    # Group sizes and cut points come from these columns alone, before anything is joined to the rows.
    narrow = rows.select(*dict.fromkeys((*by.groups, *by.order)))
    return with_previous(rows, by, ["sha1", "source_file", "week_id"], "__previous", measured=narrow)


_OTHER_PREVIOUS = "__previous IS NOT NULL AND NOT __previous.sha1 <=> sha1"
_OTHER_KNOWN = "get(filter(__known, known -> NOT known.file_hash <=> sha1), 0)"


def in_batch(batch: DataFrame, order: list[str], rows_per_task: int = ROWS_PER_TASK,
             ignore_empty: bool = False, scope: str = "week") -> DataFrame:
    """Rows whose previous row of the same receipt in the batch is another file.

    `batch` has week_id, fingerprint and the ledger columns; `order` is the
    processing order and must be unique inside a week. With scope="week" each week
    is a batch of its own; with scope="run" all rows are one batch, week after week.
    """
    rows = batch.filter(~_all_missing()) if ignore_empty else batch
    other_file = _with_previous(rows, order, rows_per_task, scope).filter(_OTHER_PREVIOUS)
    return other_file.selectExpr(
        *batch.columns, "__previous.week_id AS original_week", "date AS original_date", "vendor AS original_vendor",
        "amount AS original_amount", "__previous.source_file AS original_file", "'batch' AS kind")


def last_registered(registry: DataFrame, order: list[str]) -> DataFrame:
    """The newest registry row of each fingerprint."""
    return keep_latest(registry, ["fingerprint"], order)


def _originals() -> Column:
    return F.struct("file_hash", *_ORIGINAL)


def _known(registry: DataFrame, order: list[str], match: str) -> DataFrame:
    """fingerprint, __known: its newest registered rows, as many as are looked at."""
    if match == "last":
        return last_registered(registry, order).select("fingerprint", F.array(_originals()).alias("__known"))
    if match != "any":
        raise ValueError("match is 'last' or 'any'")
    newest = Window.partitionBy("fingerprint").orderBy(*[F.col(c).desc() for c in order])
    return (
        registry.withColumn("__rank", F.row_number().over(newest)).filter("__rank <= 2")
        .groupBy("fingerprint")
        .agg(F.sort_array(F.collect_list(
            F.struct("__rank", _originals().alias("row")))).alias("__ranked"))
        .select("fingerprint", F.transform("__ranked", lambda r: r["row"]).alias("__known"))
    )


def across_weeks(batch: DataFrame, registry: DataFrame, order: list[str],
                 match: str = "last", ignore_empty: bool = False) -> DataFrame:
    """Rows already registered under another file hash.

    match="last" looks at the newest registered row only; match="any" finds an
    older one too. File hashes are unique per fingerprint in the registry, so the
    two newest rows are all that "any" needs.
    """
    rows = batch.filter(~_all_missing()) if ignore_empty else batch
    return (
        rows.join(_known(registry, order, match), "fingerprint")
        .withColumn("__original", F.expr(_OTHER_KNOWN))
        .filter("__original IS NOT NULL")
        .selectExpr(
            *batch.columns, "__original.week_id AS original_week", "__original.date AS original_date",
            "__original.vendor AS original_vendor", "__original.amount AS original_amount",
            "__original.source_file AS original_file", "'registry' AS kind")
    )


def week_note(current: Sql, original: Sql) -> Sql:
    return f"IF({original} <=> {current}, 'same week', concat('week ', {original}))"


def report(batch: DataFrame, registry: DataFrame, batch_order: list[str],
           registry_order: list[str], match: str = "last", ignore_empty: bool = False,
           rows_per_task: int = ROWS_PER_TASK, scope: str = "week") -> DataFrame:
    """Both kinds of duplicate; a row may appear once in each.

    The rows are joined with the registry as they were ordered, so with scope="run" they are shuffled once for both.
    """
    rows = batch.filter(~_all_missing()) if ignore_empty else batch
    seen = _with_previous(rows, batch_order, rows_per_task, scope).join(_known(registry, registry_order, match), "fingerprint", "left")
    kinds = f"array(IF({_OTHER_PREVIOUS}, 'batch', NULL), IF(__original IS NOT NULL, 'registry', NULL))"
    # Values are taken from the columns after that, so that those nobody asks for are not shuffled.
    of_batch = {"week": "__previous.week_id", "date": "date", "vendor": "vendor", "amount": "amount", "file": "__previous.source_file"}
    originals = [f"IF(kind = 'batch', {value}, __original.{c}) AS original_{name}" for (name, value), c in zip(of_batch.items(), _ORIGINAL)]
    return (
        seen.withColumn("__original", F.expr(_OTHER_KNOWN))
        .selectExpr("*", f"explode(filter({kinds}, kind -> kind IS NOT NULL)) AS kind")
        .selectExpr(*batch.columns, *originals, "kind")
        .withColumn("seen_in", F.expr(week_note("week_id", "original_week"))))


def relinked(registry: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The duplicates of registered rows among themselves, as if each commit (`version`) had been compared with what was registered before it.

    Both kinds in the columns of the stored duplicates table. A row's original is the row before it in its commit, and the
    newest of an earlier commit. Only per-commit maxima are ordered for the latter, so a hot fingerprint is no large window.
    """
    rows = registry.withColumnRenamed("file_hash", "sha1")
    by = Ordering(("fingerprint", "version"), ("week_id", "seq", "sha1"), rows_per_task)
    seen = with_previous(rows, by, ["sha1", "source_file", "week_id"], "__original")
    newest = rows.groupBy("fingerprint", "version").agg(F.max(F.struct("week_id", "seq", "sha1", "source_file")).alias("newest"))
    earlier = newest.select("fingerprint", "version", F.lag("newest").over(Window.partitionBy("fingerprint").orderBy("version")).alias("__original"))
    across = rows.join(earlier.where("__original IS NOT NULL"), ["fingerprint", "version"])
    found = seen.withColumn("kind", F.lit("batch")).select(*rows.columns, "kind", F.struct("__original.week_id", "__original.sha1", "__original.source_file").alias("__original")).unionByName(
        across.withColumn("kind", F.lit("registry")).select(*rows.columns, "kind", F.struct("__original.week_id", "__original.sha1", "__original.source_file").alias("__original")))
    return found.filter("__original.sha1 IS NOT NULL AND __original.sha1 <> sha1").selectExpr(
        "week_id", "seq", "kind", "fingerprint", "sha1", "source_file", "__original.week_id AS original_week", "__original.source_file AS original_file",
        f"{week_note('week_id', '__original.week_id')} AS seen_in")
