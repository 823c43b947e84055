"""One row per key.

`row_number() = 1` is planned with a group limit before the shuffle, so each task
sends on one row per key at most and a hot key never gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _first_by(df, keys, [F.col(c).asc() for c in order])


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _first_by(df, keys, [F.col(c).desc() for c in order])
