"""Keys that have become others, and calls that a sliding log lets through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import rate, rekey
from quillstream.plans.registry import query
from quillstream.sources.tables import read


@query("""WITH RECURSIVE way(key, now) AS (SELECT c_custkey, c_custkey FROM customer UNION ALL SELECT key, now // 2 FROM way WHERE now % 3 = 0 AND now > 0), last AS (SELECT key, min(now) AS final FROM way GROUP BY key),
  o AS (SELECT coalesce(final, o_custkey) AS k, year(o_orderdate) AS edition, o_orderstatus = 'F' AS official, o_orderkey AS report, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note, coalesce(final, o_custkey) <> o_custkey AS moved FROM orders LEFT JOIN last ON key = o_custkey),
  r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY k, edition) - 1 AS merged FROM o WINDOW w AS (PARTITION BY k, edition ORDER BY NOT official, report)),
  f AS (SELECT k, edition, first(note ORDER BY NOT official, report) AS note FROM o WHERE note IS NOT NULL GROUP BY ALL)
  SELECT r.k, r.edition, official, report, f.note, moved, merged FROM r LEFT JOIN f USING (k, edition) WHERE rn = 1""")
def rekeyed_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions by year under the keys that customers have become: a third of them leads on to half its number, and that one perhaps further."""
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("old"), F.floor(F.col("c_custkey") / 2).alias("new"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("edition"), (F.col("o_orderstatus") == "F").alias("official"), F.col("o_orderkey").alias("report"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"))
    return rekey.rekeyed(o, c, "k", "edition", [~F.col("official"), F.col("report")], fill=("note",))


#: Calls that a user may make in so many seconds.
_MOST, _SECONDS = 2, 6 * 3600.0


@query()
def admitted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of their users: which ones a limit of two in six hours lets through."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return rate.admitted(e, most=_MOST, seconds=_SECONDS)
