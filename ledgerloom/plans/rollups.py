"""Totals that follow the ledger: signed changes of each commit are merged into a small table, so no report rescans the ledger.

The table has a row per week, category and month, with an exact decimal sum and a count. An amount that a decimal cannot
hold has rows of its own, keyed by the amount, as only counts can be taken back exactly. What a commit put counts plus one, what it
replaced or took away minus one; undoing a week drops the week's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import missing, month_caption, month_key, money, none_if_empty, quote
from ledgerloom.schemas import UNCATEGORIZED
from ledgerloom.sources.tables import StateTable

TOTALS_SCHEMA = "week_id string, category string, month string, inexact string, exact decimal(38,2), n_rows bigint"
_EXACT = "try_cast(coalesce(amount, 0D) AS DECIMAL(28, 2))"


def contributions(rows: DataFrame, sign: int) -> DataFrame:
    """What ledger rows add to (1) or take from (-1) each total."""
    return rows.selectExpr(
        f"CASE WHEN {missing('week_id')} THEN '' ELSE week_id END AS week_id", f"coalesce({none_if_empty('category')}, {quote(UNCATEGORIZED)}) AS category",
        f"{month_key('date')} AS month", f"IF({_EXACT} IS NULL, CAST(amount AS STRING), '') AS inexact",
        f"coalesce({_EXACT}, 0) * {sign} AS exact", f"{sign} AS n").groupBy("week_id", "category", "month", "inexact").agg(
        F.sum("exact").cast("decimal(38,2)").alias("exact"), F.sum("n").cast("bigint").alias("n_rows"))


@dataclass(frozen=True)
class MaintainedTotals:
    spark: SparkSession
    root: str

    @property
    def table(self) -> StateTable:
        return StateTable(self.spark, f"{self.root}/totals", TOTALS_SCHEMA, ("week_id", "category", "month", "inexact"),
                          hashed=("week_id", "category", "month", "inexact"), span="week_id")

    def follow(self, ledger: StateTable, batch_id: str) -> None:
        """Take in what one commit of the ledger changed. To be called after each, before the log of the ledger is cut."""
        if not self.table.has_batch(batch_id):
            put, gone = contributions(ledger.batch(batch_id), 1), contributions(ledger.replaced(batch_id), -1)
            self.table.merge(put.unionByName(gone), ["exact", "n_rows"], batch_id)

    def undo_week(self, week_id: str, batch_id: str) -> None:
        self.table.delete(F.col("week_id") == week_id, batch_id, (week_id, week_id))

    def _by(self, *keys: str) -> DataFrame:
        rest = "sum(IF(inexact = '', 0D, try_cast(inexact AS DOUBLE) * n_rows))"
        return self.table.read().filter("n_rows <> 0").groupBy(*keys).agg(
            F.expr(f"CAST(sum(exact) AS DOUBLE) + {rest}").alias("total"), F.sum("n_rows").alias("n_rows"),
            F.expr("sum(IF(inexact = '', 0, n_rows))").alias("n_inexact"))

    def categories(self) -> DataFrame:
        return self._by("category").orderBy("category")

    def months(self) -> DataFrame:
        return self._by("month").selectExpr("*", f"{month_caption('month')} AS caption", f"{money('total')} AS shown").orderBy("month")
