"""The streaming operators over static tables, where they give what a stream gives at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources.tables import read
from quillstream.streaming import jobs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _text(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(jobs.counts(_events(spark, sf_dir), "1 day"), "start")


@query("""SELECT strftime(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1), (2)) AS t(k) GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(jobs.counts(_events(spark, sf_dir), "3 days", "1 day"), "start")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
  SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS end, user_id, count(*) AS n FROM y GROUP BY user_id, s""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(jobs.sessions(_events(spark, sf_dir), "6 hours"), "start", "end")


@query("SELECT DISTINCT user_id, event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events")
def watermark_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return jobs.deduplicated(e, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


@query("SELECT event_id, strftime(least(ts, TIMESTAMP '2024-01-20 00:00:00'), '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE date_diff('day', CAST(least(ts, TIMESTAMP '2024-01-20 00:00:00') AS DATE), DATE '2024-01-20') <= 10")
def late_data_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(jobs.accepted(_events(spark, sf_dir), F.lit("2024-01-20").cast("timestamp"), days=10).select("event_id", "ts"), "ts")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 0 AS step, 0 AS fails FROM r WHERE n = 1 UNION ALL
    SELECT s.user_id, r.n, CASE WHEN ok AND r.n % 12 = 0 THEN 0 WHEN NOT ok AND fails + 1 >= 2 THEN (step + 1) % 3 ELSE step END, CASE WHEN ok OR fails + 1 >= 2 THEN 0 ELSE fails + 1 END FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1)
  SELECT user_id, arg_max(step, n) AS step, arg_max(fails, n) AS fails, CAST(max(n) AS INTEGER) AS runs FROM s GROUP BY user_id""")
def source_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.source_states(_events(spark, sf_dir))
