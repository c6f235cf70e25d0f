"""The batch operators as streams: windows with watermarks, deduplication, and state per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
#: Failures in a row after which a source goes to its next step, and runs after which the first is tried again.
SWITCH_AFTER, PROBE_EVERY = 2, 12


def event_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Parquet files of events as they land."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def counts(events: DataFrame, length: str, slide: str | None = None, *, late: str = "35 days", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and their value per tumbling (or sliding) window; rows later than `late` are left out of a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, *, late: str = "35 days") -> DataFrame:
    """Runs of a user's events with no gap longer than `gap`."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], *, late: str = "35 days") -> DataFrame:
    """The first event of each key, within the watermark in a stream."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def accepted(events: DataFrame, today: Column, *, days: int = 35) -> DataFrame:
    """Not older than so many days by the clock; times ahead of it are set to it."""
    return events.withColumn("ts", F.least("ts", today)).where(F.datediff(today, "ts") <= days)


def next_state(step: int, fails: int, runs: int, ok: bool, steps: int) -> tuple[int, int, int]:
    """(active step, failures in a row, runs) of a source after one more run."""
    runs += 1
    if ok:
        fails = 0
        if step and runs % PROBE_EVERY == 0:
            step = 0
    else:
        fails += 1
        if fails >= SWITCH_AFTER:
            step, fails = (step + 1) % steps, 0
    return step, fails, runs


def source_states(runs: DataFrame, steps: int = 3) -> DataFrame:
    """State of each source (user_id) after its runs in order of event_id; a stream keeps it between batches, a batch computes it at once."""
    schema = "user_id long, step int, fails int, runs int"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for ok in rows["event_type"] != "error":
            s = next_state(*s, bool(ok), steps)
        state.update(s)
        yield pd.DataFrame([(key[0], *s)], columns=["user_id", "step", "fails", "runs"])

    r = runs.select("user_id", "event_id", "event_type")
    if runs.isStreaming:
        return r.groupBy("user_id").applyInPandasWithState(update, schema, "step int, fails int, runs int", "update", GroupStateTimeout.NoTimeout)
    g = r.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_type") != "error").alias("ok")))).alias("r"))
    start = F.struct(F.lit(0).alias("step"), F.lit(0).alias("fails"), F.lit(0).alias("runs"))

    def advance(s: Column, e: Column) -> Column:
        n = s["runs"] + 1
        fails = F.when(e["ok"], 0).otherwise(s["fails"] + 1)
        switch = fails >= SWITCH_AFTER
        step = F.when(e["ok"] & (n % PROBE_EVERY == 0), 0).when(switch, (s["step"] + 1) % steps).otherwise(s["step"])
        return F.struct(step.cast("int").alias("step"), F.when(switch, 0).otherwise(fails).cast("int").alias("fails"), n.cast("int").alias("runs"))

    return g.select("user_id", F.aggregate("r", start, advance).alias("s")).select("user_id", "s.*")
