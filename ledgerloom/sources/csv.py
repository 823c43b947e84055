"""CSV export of the ledger."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.schemas import RECEIPT_COLUMNS, RECEIPT_SCHEMA
from ledgerloom.sources.commits import Store

# Quotes are doubled inside quoted fields; line breaks stay inside a field; text
# keeps its blanks.
_OPTIONS = {"header": True, "escape": '"', "encoding": "UTF-8", "multiLine": True,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str) -> None:
    """The eight export columns, one folder per week; NULL becomes an empty field.

    Rebalancing gives each small week one file and splits a large one over tasks. Only
    the folders of the weeks in `rows` are replaced.
    """
    (rows.select(*RECEIPT_COLUMNS, "week_id").hint("rebalance", "week_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_id")
     .options(**_OPTIONS).option("nullValue", "").option("emptyValue", "").csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = RECEIPT_SCHEMA + ", week_id string"
    return spark.read.schema(schema).options(**_OPTIONS).csv(path)


def remove_week(spark: SparkSession, path: str, week_id: str) -> None:
    """Take one week's files away; nothing happens if there are none."""
    store = Store(spark, path)
    for name in store.names(""):
        if unquote(name) == f"week_id={week_id}":
            store.remove(name)
