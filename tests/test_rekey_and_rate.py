"""Chained keys and the sliding log, in batch and as a stream, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillstream.operators import rate, rekey
from quillstream.streaming import rate as rate_stream


def test_chains_end_where_they_end(spark):
    m = [(k, k + 1) for k in range(100, 140)] + [(1, 2), (2, 3), (3, 1), (9, 1), (5, 5), (None, 4), (6, None), (7, 8), (7, 4)]
    got = {r.old: r.new for r in rekey.resolved(spark.createDataFrame(m, "old long, new long")).collect()}
    assert got == {k: 140 for k in range(100, 140)} | {2: 1, 3: 1, 9: 1, 7: 4}
    assert not rekey.resolved(spark.createDataFrame([], "old long, new long")).collect()


def test_rekeying_merges_editions_and_is_idempotent(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 12)}", rng.choice([2020, 2021, None]), k, rng.random() < 0.3, rng.choice([None, f"n{k}"]), rng.choice([None, k])) for k in range(120)]
    mapping = [("k0", "k1"), ("k1", "k2"), ("k5", "k2"), ("k7", "k9"), ("k9", "new"), ("k10", "k11"), ("k11", "k10")]
    end = {"k0": "k2", "k1": "k2", "k5": "k2", "k7": "new", "k9": "new", "k11": "k10"}
    d = spark.createDataFrame(rows, "key string, edition int, id int, official boolean, note string, total int")
    mp = spark.createDataFrame(mapping, "old string, new string")
    order = [~F.col("official"), F.col("id")]
    got = rekey.rekeyed(d, mp, "key", "edition", order, fill=("note", "total"))
    own = defaultdict(list)
    for r in rows:
        own[end.get(r[0], r[0]), r[1]].append(r)
    expected = set()
    for (key, edition), rs in own.items():
        rs.sort(key=lambda r: (not r[3], r[2]))
        first = lambda i: next((r[i] for r in rs if r[i] is not None), None)  # noqa: B023, E731
        expected.add((key, edition, rs[0][2], rs[0][3], first(4), first(5), rs[0][0] in end, len(rs) - 1))
    assert {tuple(r) for r in got.collect()} == expected
    again = rekey.rekeyed(got.drop("moved", "merged"), mp, "key", "edition", order, fill=("note", "total"))
    assert {tuple(r)[:6] for r in again.collect()} == {e[:6] for e in expected} and not again.where("moved or merged > 0").collect()


def logged(calls, most, seconds):
    out, logs = {}, defaultdict(deque)
    for key, i, ts in sorted((c for c in calls if c[2] is not None), key=lambda c: (c[2], c[1])):
        log = logs[key]
        while log and (ts - log[0]).total_seconds() >= seconds:
            log.popleft()
        out[i] = len(log) < most
        if out[i]:
            log.append(ts)
    return out


def random_calls(seed, n=400):
    rng = random.Random(seed)
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return [(rng.choice([1, 1, 1, 2, 3, None]), k, None if k % 50 == 7 else at + timedelta(seconds=rng.choice([rng.randint(0, 900), 60 * rng.randint(0, 15)]))) for k in range(n)]


def test_only_admitted_calls_count(spark):
    calls = random_calls(1)
    d = spark.createDataFrame(calls, "key long, id long, ts timestamp").repartition(6)
    got = {r.id: r.admitted for r in rate.admitted(d, most=5, seconds=60).collect()}
    assert got == logged(calls, 5, 60)
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    few = [(1, k, at + timedelta(seconds=20 * k)) for k in range(9)]
    assert [r.admitted for r in rate.admitted(spark.createDataFrame(few, "key long, id long, ts timestamp"), most=2, seconds=60).orderBy("id").collect()] == [True, True, False] * 3
    assert not rate.admitted(d.limit(0)).collect()


def test_null_and_nan_are_two_keys(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    calls = [(key, k, at + timedelta(seconds=k)) for k, key in enumerate([None, float("nan"), None, float("nan")])]
    d = spark.createDataFrame(calls, "key double, id long, ts timestamp").coalesce(1)
    assert {r.id: r.admitted for r in rate.admitted(d, most=1, seconds=60).collect()} == {0: True, 1: True, 2: False, 3: False}


def test_the_log_as_a_stream(spark, tmp_path):
    calls = [c for c in random_calls(5, 240) if c[2] is not None and c[0] is not None]
    calls.sort(key=lambda c: (c[2], c[1]))
    cuts = [calls[:70], calls[70:71], calls[71:160], calls[160:]]
    cuts = [c for c in cuts if c]
    landed = str(tmp_path / "landed")
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, "key long, id long, ts timestamp").coalesce(1).write.parquet(f"{landed}/part{k}")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for upto in ("[01]", "[0123]"):  # stopped and started again
            s = spark.readStream.schema("key long, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{landed}/part{upto}")
            q = rate_stream.admitted(s, most=5, seconds=60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len(calls)
    assert {r.id: r.admitted for r in rows} == logged(calls, 5, 60)


@pytest.mark.parametrize("most", [0, 1])
def test_walk_at_its_limits(most):
    assert rate.walk([0.0, 0.0, 60.0, 60.0, 119.9], deque(), most, 60.0) == [bool(most), False, bool(most), False, False]
