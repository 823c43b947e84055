"""The shared folder of the registered queries, in sessions that name none and run in one process, and files in it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import session

FOLDER_FILES = 4096  # files that a task puts into one folder


def ensure_shared_folder(spark: SparkSession) -> None:
    """Leave a configured folder alone; on one machine only, make a temporary one and remove it at exit."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)


def new_folder(spark: SparkSession, label: str) -> str:
    ensure_shared_folder(spark)
    return session.new_folder(spark, label)


def write_files(rows: DataFrame, key: str, text: str, end: str, folder: str) -> None:
    """Each row as a file `<key>=<value>` of its text and `end`, somewhere below the folder.

    On a mounted file system, the tasks write the files themselves: Spark's writer starts six processes for each file there. The files of
    a task come into the folder together when it ends, once only. On other stores Spark writes a folder `<key>=<value>` for each value.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    place = system.makeQualified(path).toUri()
    if place.getScheme() == "file":
        system.mkdirs(path)
        content = F.concat(text, F.lit(end)).cast("binary")
        rows.select(F.concat(F.lit(f"{key}="), key).alias("name"), content.alias("content")).mapInArrow(
            _file_writer(place.getPath()), "n bigint").agg(F.sum("n")).collect()
    else:
        rows.select(key, text).repartition(key).write.mode("append").option("lineSep", end).partitionBy(key).text(folder)


def _file_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    call = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, at = f"{call}-{TaskContext.get().partitionId():06d}", 0, ""
        unfinished = f"{folder}/.{own}-{uuid.uuid4().hex}"  # Spark lists no names that begin with a dot
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                if n % FOLDER_FILES == 0:
                    at = f"{unfinished}/{n // FOLDER_FILES:06d}"
                    os.makedirs(at)
                with open(f"{at}/{n % FOLDER_FILES:04d}-{name}", "wb") as file:
                    file.write(content.as_buffer())
                n += 1
        if n:
            try:
                os.rename(unfinished, f"{folder}/{own}")
            except OSError:
                if not os.path.isdir(f"{folder}/{own}"):
                    raise
                shutil.rmtree(unfinished)  # another run of this task has put the same files there
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write
