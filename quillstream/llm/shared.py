"""Small helpers that several corpus operators use: tables, shared folders, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker handles at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="quillstream-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def spare(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it while `df` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """`df`, written once to the shared folder and read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstream/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver find what nothing refers to any more, so that Spark deletes the shuffle files of steps whose results are written."""
    # The threads of the listener bus hold the last event, and so the plan of the query that ended last, until another comes.
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each take `most` bytes at most, or are one text."""
    for batch in batches:
        col = batch.column(text)
        if col.nbytes <= most or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()
