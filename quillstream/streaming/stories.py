"""Stories as a stream: each batch of reports is assigned by the memory that the batch before it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillstream.operators import memory
from quillstream.streaming.ledger import Ledger

REPORTS = "id long, kind string, day long, tokens array<string>"
ASSIGNED = f"{REPORTS}, story long"


def advance(ledger: Ledger, reports: DataFrame, batch: int, *, idle_days: int = memory.IDLE_DAYS) -> bool:
    """Assigns one batch and remembers it, once however often it is called with that number."""
    if ledger.has(f"batch {batch}"):
        return False
    before = ledger.latest("memory", memory.MEMORY)
    found = memory.assigned(reports, before, idle_days=idle_days).persist()
    try:
        return ledger.write(batch, {"assigned": found, "memory": memory.remembered(before, found, idle_days=idle_days)})
    finally:
        found.unpersist()


def follow(spark: SparkSession, reports: DataFrame, folder: str, checkpoint: str, *, idle_days: int = memory.IDLE_DAYS) -> StreamingQuery:
    """Runs over what a stream of reports has now; batches must come in the order of days, late reports meet the stories that are remembered."""
    ledger = Ledger(spark, folder)
    return reports.writeStream.foreachBatch(lambda df, n: advance(ledger, df, n, idle_days=idle_days) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assigned(spark: SparkSession, folder: str) -> DataFrame:
    return Ledger(spark, folder).table("assigned", ASSIGNED)
