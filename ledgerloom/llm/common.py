"""Shared folder, written intermediates and Arrow helpers of the operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 500
_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="ledgerloom-llm-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return _local_root[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cut from its lineage, so a lost executor costs a reread only."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_kinds(df: DataFrame, kind: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df for which `kind` holds and the others, written at once and read as two tables."""
    path, spark = new_path(df.sparkSession, label), df.sparkSession
    df.withColumn("kind", kind).write.partitionBy("kind").parquet(path)
    # Read with the folder's column and by a filter, as a kind without any rows has no folder.
    return tuple(spark.read.schema(f"{_ddl(df)}, kind boolean").parquet(path).where(F.col("kind") == which).drop("kind") for which in (True, False))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


ROW_KEY = ["__file", "__row"]


def keyed(df: DataFrame) -> DataFrame:
    """df with a key of each row, `__file` and `__row`, that stays the same however often the rows are read.

    The rows of one Parquet table have such a key; any other rows are written to one first.
    """
    plan = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    table = df if plan == "LogicalRelation" else written(df, "keyed")
    try:
        return table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # another format than Parquet
        return written(df, "keyed").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of at most ROWS_PER_BATCH, as single texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def partitions_for(n: float, per_partition: float, least: int = 1) -> int:
    return max(least, math.ceil(n / per_partition))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of each text in them; NULL is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = pc.fill_null(column, pa.scalar("", column.type) if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0]:at[-1]], at - at[0]


def spans_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer single text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j
