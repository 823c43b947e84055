"""The ledger fed by a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.weekly import WeeklyLedger

def batch_step(job: WeeklyLedger, stream: str) -> Callable[[DataFrame, int], None]:
    """One micro-batch: ledger rows, duplicates against what came before, registry, export.

    Every write carries the batch number. After a failure Spark sends the batch
    again and the writes that were done are passed over.
    """
    def step(docs: DataFrame, number: int) -> None:
        batch_id = f"{stream}-{number}"
        rows = job.process(docs, batch_id)
        if not job.duplicates.has_batch(batch_id):
            job.duplicates.upsert(job.find_duplicates(rows), batch_id)
        job.register(rows, batch_id)
        job.export(rows, batch_id)

    return step


def start(docs: DataFrame, job: WeeklyLedger, checkpoint: str, stream: str = "documents") -> StreamingQuery:
    """Run over all documents that are there now; later runs continue after them."""
    return (
        docs.writeStream.foreachBatch(batch_step(job, stream))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
