"""Totals, counts and quality figures. All aggregates are combined before their shuffle.

Amounts are summed as decimals, so totals do not depend on the order of rows. An amount
that a decimal of 28 digits cannot hold (too large, infinite, not a number) is summed as a double, added to
the total and counted in `n_inexact`: no amount ends a job, and none is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import (
    missing, money, month_caption, month_key, none_if_empty, quote,
)
from ledgerloom.schemas import UNCATEGORIZED


_CATEGORY = f"coalesce({none_if_empty('category')}, {quote(UNCATEGORIZED)}) AS category"
_MONTH = f"{month_key('date')} AS month"


_AMOUNT = "coalesce(amount, 0D) AS amount"
_EXACT = "try_cast(amount AS DECIMAL(28, 2))"
_SUMS = [
    f"sum({_EXACT}) AS __exact",
    f"sum(IF({_EXACT} IS NULL, amount, NULL)) AS __rest",
    f"count_if({_EXACT} IS NULL) AS n_inexact",
    "count(1) AS n_rows",
]
_TOTAL = "coalesce(CAST(__exact AS DOUBLE), 0D) + coalesce(__rest, 0D) AS total"


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*map(F.expr, _SUMS))


def _count() -> Column:
    return F.expr("count(1) AS n_rows")


def category_totals(rows: DataFrame) -> DataFrame:
    return (
        _summed(rows.selectExpr(_CATEGORY, _AMOUNT), "category")
        .selectExpr("category", _TOTAL, "n_rows", "n_inexact")
        .orderBy("category")
    )


def month_totals(rows: DataFrame) -> DataFrame:
    """Totals by month in calendar order; `Unknown` sorts last."""
    return (
        _summed(rows.selectExpr(_MONTH, _AMOUNT), "month")
        .selectExpr("month", _TOTAL, "n_rows", "n_inexact")
        .selectExpr("*", f"{month_caption('month')} AS caption", f"{money('total')} AS shown")
        .orderBy("month")
    )


def summary(rows: DataFrame) -> DataFrame:
    """Category and month totals together from one pass over the rows.

    Rows are summed by both first, so that only that small table is doubled.
    """
    small = _summed(rows.selectExpr(_CATEGORY, _MONTH, _AMOUNT), "category", "month")
    both = small.groupingSets([["category"], ["month"]], "category", "month").agg(
        F.expr("grouping(category) = 1 AS by_month"), F.expr("sum(__exact) AS __exact"), F.expr("sum(__rest) AS __rest"),
        F.expr("sum(n_rows) AS n_rows"), F.expr("sum(n_inexact) AS n_inexact"))
    return both.selectExpr("IF(by_month, 'month', 'category') AS kind",
                           "IF(by_month, month, category) AS name", _TOTAL, "n_rows", "n_inexact")


def origin_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("week_id", "origin").agg(F.count(F.lit(1)).alias("n_files"))


def quality(rows: DataFrame) -> DataFrame:
    """What the extraction missed, per week and source of the date."""
    return (
        rows.withColumn("date_source", F.expr("coalesce(date_source, 'none')"))
        .groupBy("week_id", "date_source")
        .agg(_count(), F.expr("count_if(date IS NULL) AS no_date"),
             F.expr(f"count_if({missing('vendor')}) AS no_vendor"),
             F.expr("count_if(coalesce(amount, 0D) = 0) AS no_amount"))
    )


def name_collisions(rows: DataFrame) -> DataFrame:
    """Source-file names that more than one document of a week maps to."""
    return (
        rows.groupBy("week_id", "source_file").agg(F.count(F.lit(1)).alias("n_files"))
        .filter(F.col("n_files") > 1)
    )
