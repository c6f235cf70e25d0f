"""Tables that streams write exactly once: parts by batch, and a ledger of the batches that count.

A batch writes its parts and then its entry in the ledger. A batch that stops before its entry has no effect: readers take parts of
entered batches only, and when the batch is repeated its parts are overwritten. A batch that is repeated after
its entry changes nothing. The same ledger gates what may happen once only, such as migrations.

All of it is Parquet in one folder that driver and executors share; nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRIES = "entry string, batch long"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """(entry, batch): batches by number, and what was done once, with no number."""
        return self._read("ledger", _ENTRIES).select("entry", "batch")

    def has(self, entry: str) -> bool:
        return not self.entries().where(F.col("entry") == entry).isEmpty()

    def _enter(self, entry: str, batch: int | None) -> None:
        self.spark.createDataFrame([(entry, batch)], _ENTRIES).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def write(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Writes the parts of a batch and enters it; False if it was entered before."""
        if self.has(f"batch {batch}"):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        self._enter(f"batch {batch}", batch)
        return True

    def table(self, name: str, schema: str) -> DataFrame:
        """All rows of entered batches, with their `batch`."""
        known = self.entries().where("batch is not null").select("batch").distinct()
        return self._read(name, f"{schema}, batch long").join(F.broadcast(known), "batch", "left_semi")  # a row for each batch

    def latest(self, name: str, schema: str) -> DataFrame:
        """The rows of the last entered batch."""
        last = self.entries().agg(F.max("batch")).first()[0]
        return self._read(f"{name}/batch={last}", schema) if last is not None else self.spark.createDataFrame([], schema)

    def once(self, name: str, action: Callable[[], None]) -> bool:
        """Does what must be done once only; False if it was done before. An action that stops half-way is repeated, so it must bear that."""
        if self.has(f"once {name}"):
            return False
        action()
        self._enter(f"once {name}", None)
        return True


def refresh(days: DataFrame, path: str, today: int, *, by: str = "day", open_days: int = 2) -> None:
    """Writes tables by day: the last `open_days` up to `today` are rebuilt, older days are written if they are not there yet and never again."""
    spark = days.sparkSession
    try:
        there = spark.read.parquet(path).where(F.col(by) <= today - open_days).select(by).distinct()
        days = days.join(there, by, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    days.where(F.col(by) <= today).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
