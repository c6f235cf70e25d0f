"""The sliding log of operators.rate as a stream: each key's log is state, dropped by a timer once the window has passed."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstream.operators import rate


class SlidingLog(StatefulProcessor):
    """State of a key: the times of its admitted calls, `most` at most."""

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows)).sort_values(["at", "id"])
        log = deque(x[0] for x in self.log.get())
        ok = rate.walk(calls["at"].tolist(), log, self.most, self.seconds)
        self.log.clear()
        if log:
            self.log.put([(x,) for x in log])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])
            self.handle.registerTimer(int((log[-1] + self.seconds) * 1000) + 1)
        yield pd.DataFrame({"key": calls["key"], "id": calls["id"], "admitted": ok})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.log.clear()
        return iter([])

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, *, most: int = rate.MOST, seconds: float = rate.SECONDS, late: str = "1 minute") -> DataFrame:
    """(key, id, admitted) of a stream of calls (key bigint, id bigint, ts timestamp); batches come in the order of time.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as all of Spark's arbitrary state does.
    """
    d = calls.where("ts is not null").select("key", "id", "ts", F.col("ts").cast("double").alias("at")).withWatermark("ts", late)
    return d.groupBy("key").transformWithStateInPandas(statefulProcessor=SlidingLog(most, seconds), outputStructType="key long, id long, admitted boolean", outputMode="Append", timeMode="EventTime")
