"""Selection of a day's digest: signals, tiers with a floor by place, coverage of subjects, and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators import rules

SIGNALS = [("event", "on", 1.5), ("event", "thion", 2.0), ("event", "it", 1.0), ("talk", "as", 1.0), ("talk", "be", 1.0)]
#: Bars for a card, a line and, among the first FLOOR of a day, a line all the same.
MUST, ALSO, FLOOR_SCORE, FLOOR = 4.2, 3.4, 2.0, 3
TIERS = ("top", "prelims", "more")


def with_signals(items: DataFrame, table: list[rules.Rule]) -> DataFrame:
    """Adds event and talk: how much of a development or of comment a title reports."""
    s = rules.weighted_terms(items, table, {"title": 1.0})
    s = s.groupBy("id").agg(F.max(F.when(F.col("bucket") == "event", F.col("score"))).alias("event"), F.max(F.when(F.col("bucket") == "talk", F.col("score"))).alias("talk"))
    return items.join(s, "id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("event", "talk")})


def digest_score(score: Column, event: Column, talk: Column) -> Column:
    return score + F.least(event, F.lit(4.0)) * 0.6 - talk * 0.8


def tiers(news: DataFrame) -> DataFrame:
    """Adds bs, place within the day, and tier (null: not taken)."""
    d = news.withColumn("bs", F.round(digest_score(F.col("score"), F.col("event"), F.col("talk")), 4))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("bs"), "id")))
    taken = (F.col("bs") >= ALSO) | ((F.col("place") <= FLOOR) & (F.col("bs") >= FLOOR_SCORE))
    note = F.col("grade").isin("NOTE", "SKIM") & (F.col("talk") < 1)
    fact = (F.col("event") >= 1.5) & (F.col("talk") == 0)
    tier = F.when(~taken, None).when((F.col("bs") >= MUST) & note, "top").when((F.col("bs") >= ALSO) & fact, "prelims").otherwise("more")
    return d.withColumn("tier", tier)


def coverage(d: DataFrame) -> DataFrame:
    """The best row not taken of each subject that a day's tiers leave uncovered."""
    covered = d.where("tier is not null").select("day", "subject").distinct()
    left = d.where("tier is null").join(covered, ["day", "subject"], "left_anti")
    w = Window.partitionBy("day", "subject").orderBy(F.desc("bs"), "id")
    return left.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ranked(d: DataFrame) -> DataFrame:
    """day, rank, id, tier and lead of folded picks: leads by tier and score, then the folded ones in their leads' order."""
    w = Window.partitionBy("lead")
    d = d.withColumn("lead_tier", F.max(F.when(F.col("id") == F.col("lead"), F.col("tier"))).over(w)).withColumn("lead_bs", F.max(F.when(F.col("id") == F.col("lead"), F.col("bs"))).over(w))
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("lead_tier"))
    folded = F.col("id") != F.col("lead")
    order = Window.partitionBy("day").orderBy(folded, tier, F.desc("lead_bs"), "lead", F.desc("bs"), "id")
    return d.select("day", F.row_number().over(order).alias("rank"), "id", F.col("lead_tier").alias("tier"), F.when(folded, F.col("lead")).alias("lead"))
