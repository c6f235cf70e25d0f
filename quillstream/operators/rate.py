"""A rate limit by a sliding log: a call is let through if fewer than so many were let through in the time before it.

What is refused does not count, so a decision depends on the decisions before it. A key's calls are walked in
order with the times of its last admitted ones, at most `most` of them. Where a key was quiet for as long as the window its log is
empty, so there its history is cut and the stretches are walked in different tasks; a task streams
through sorted rows and holds one log. The same walk serves a stream, which keeps each key's log as state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Calls in a window, and its seconds.
MOST, SECONDS = 18, 60.0


def walk(times: list[float], log: deque[float], most: int, seconds: float) -> list[bool]:
    """Which calls are let through; `log` is carried on. A call leaves the log when the window has passed."""
    out = []
    for t in times:
        while log and t - log[0] >= seconds:
            log.popleft()
        out.append(len(log) < most)
        if out[-1]:
            log.append(t)
    return out


def admitted(calls: DataFrame, *, most: int = MOST, seconds: float = SECONDS) -> DataFrame:
    """(key, id, admitted) of calls (key, id, ts), in the order of their time and id. Calls without a time are left out."""
    schema = f"key {calls.schema['key'].dataType.simpleString()}, id {calls.schema['id'].dataType.simpleString()}, admitted boolean"
    d = calls.where("ts is not null").select("key", "id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    w = Window.partitionBy("key").orderBy("at", "id")
    d = d.withColumn("quiet", F.when(F.col("at") - F.lag("at").over(w) >= seconds, 1).otherwise(0))
    d = d.withColumn("stretch", F.sum("quiet").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "id").select("key", "stretch", "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log = None, deque()
        for rows in batches:
            at, out = rows.column("at").to_pylist(), []
            # where one stretch ends and the next begins; most hold a few calls, so a frame for each would cost more than the walk
            keys = [k if k == k else "NaN" for k in rows.column("key").to_pylist()]  # NaN is one key, and not that of null
            names = list(zip(keys, rows.column("stretch").to_pylist(), strict=True))
            start = 0
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[start]:
                    continue
                if names[start] != now:
                    now, log = names[start], deque()
                out += walk(at[start:i], log, most, seconds)
                start = i
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("id"), pa.array(out, pa.bool_())], ["key", "id", "admitted"])

    return d.mapInArrow(run, schema)
