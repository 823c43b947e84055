"""Ordered line items, their list pages, the package manifest and the links between them.

Order columns end in `seq`, the processing position, so every order is total.
Missing dates and vendors sort as empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import patterns as P
from ledgerloom.functions.text import Sql, money, month_caption, month_key
from ledgerloom.operators.keyed import keep_first
from ledgerloom.operators.ordered import (
    ROWS_PER_TASK, Ordering, with_row_number, with_running_sum,
)

_SORT = ("__date", "__vendor", "seq")


def _sortable(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", "coalesce(date, '') AS __date", "coalesce(vendor, '') AS __vendor")


def list_page_of(row: Sql) -> Sql:
    """Page inside its month (from 0) of the n-th line item."""
    return (f"IF({row} <= {P.FIRST_PAGE_ROWS}, 0L, "
            f"1 + ({row} - {P.FIRST_PAGE_ROWS + 1}) DIV {P.NEXT_PAGE_ROWS})")


def pages_of_month(n: Sql) -> Sql:
    """Pages of a month with n items; a page break follows a full page even if nothing comes after."""
    return (f"IF({n} >= {P.FIRST_PAGE_ROWS}, "
            f"2 + ({n} - {P.FIRST_PAGE_ROWS}) DIV {P.NEXT_PAGE_ROWS}, 1L)")


def line_items(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Line items with their position and page inside the month of their week's list."""
    keyed = _sortable(rows).withColumn("month", F.expr(month_key("date")))
    numbered = with_row_number(keyed, Ordering(("week_id", "month"), _SORT, rows_per_task), "item")
    return numbered.selectExpr(
        "week_id", "month", "item", f"{list_page_of('item')} AS page_in_month", "__date AS date",
        "__vendor AS vendor", "coalesce(category, '') AS category",
        f"substring(__vendor, 1, {P.SHOWN_VENDOR}) AS shown_vendor",
        f"substring(coalesce(category, ''), 1, {P.SHOWN_CATEGORY}) AS shown_category",
        f"{money('amount')} AS shown_amount", "source_file", "seq",
    )


def list_pages(rows: DataFrame, title_pages: int = 1) -> DataFrame:
    """Per week and month: items, pages, and the list page on which the month starts.

    One row per month remains after the count, so the running sum is small.
    """
    counts = rows.selectExpr("week_id", f"{month_key('date')} AS month").groupBy("week_id", "month").agg(
        F.expr("count(1) AS n_items"))
    before = ("sum(pages) OVER (PARTITION BY week_id ORDER BY month "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return counts.selectExpr("*", f"{pages_of_month('n_items')} AS pages").selectExpr(
        "week_id", "month", f"{month_caption('month')} AS caption", "n_items", "pages",
        f"{int(title_pages)} + coalesce({before}, 0L) AS first_page",
    )


def summary_pages(rows: DataFrame, title_pages: int = 1) -> DataFrame:
    """Number of pages of each week's summary."""
    return list_pages(rows, title_pages).groupBy("week_id").agg(
        F.expr(f"{int(title_pages)} + sum(pages) AS summary_pages"))


def package_manifest(rows: DataFrame, file_pages: DataFrame, title_pages: int = 1,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Where each receipt starts in the week's package: after the summary, by date and vendor.

    `file_pages` has (week_id, source_file, pages, seq); of several files with one
    name the first counts. Receipts without a file are left out.
    """
    files = keep_first(file_pages, ["week_id", "source_file"], ["seq"]).select(
        "week_id", "source_file", "pages")
    sortable = _sortable(rows)
    placed = sortable.join(files, ["week_id", "source_file"])
    summed = with_running_sum(placed, Ordering(("week_id",), _SORT, rows_per_task),
                              "pages", "__before", inclusive=False, measured=sortable)
    return (
        summed.join(summary_pages(rows, title_pages), "week_id")
        .selectExpr("week_id", "source_file", "seq", "date", "vendor", "CAST(pages AS BIGINT) AS pages",
                    "summary_pages + __before AS start_page")
    )


def link_table(items: DataFrame, months: DataFrame, manifest: DataFrame) -> DataFrame:
    """(list page -> target page) of each line item whose file is in the package.

    Files that appear more than once are linked at their last place.
    """
    targets = manifest.groupBy("week_id", "source_file").agg(F.max("start_page").alias("target_page"))
    return (
        items.join(months.select("week_id", "month", "first_page"), ["week_id", "month"])
        .join(targets, ["week_id", "source_file"])
        .selectExpr("week_id", "month", "item", "source_file",
                    "first_page + page_in_month AS list_page", "target_page")
    )
