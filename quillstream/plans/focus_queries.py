"""A day's focus with its parts, and what of it fits in half an hour, an hour and an hour and a half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import digest, focus, products
from quillstream.operators import similarity as sim
from quillstream.operators.clusters import durable
from quillstream.plans.digest_queries import _TIERS, focus_value, news
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import graded
from quillstream.sources.tables import tokenised

BUDGETS = (30, 60, 90)
#: A topic is a word that headlines of so many days have, and no more than this share of all.
TOPIC_DAYS, TOPIC_SHARE = 3, 0.01


def section_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, day, section, score and grade of what a day's digest may show."""
    tiers = digest.tiers(news(spark, sf_dir)).where("tier is not null")
    own = tiers.select("id", "day", F.when(F.col("tier") == "top", "news").otherwise(F.col("tier")).alias("section"), F.col("bs").alias("score"), "grade")
    rest = graded(spark, sf_dir).where("kind <> 'news' and grade <> 'LOW'")
    return own.union(rest.select("id", "day", F.when(F.col("kind") == "editorial", "editorials").otherwise("explained"), "score", "grade"))


def running_topics(items: DataFrame) -> DataFrame:
    """(id, topic): words of headlines that keep coming back without being common."""
    n = items.count()
    w = items.select("id", "day", F.explode(F.array_distinct("tokens")).alias("topic"))
    known = w.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days")).where((F.col("days") >= TOPIC_DAYS) & (F.col("n") <= max(3.0, TOPIC_SHARE * n)))
    return w.join(known.select("topic"), "topic", "left_semi").select("id", "topic")


def day_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenised(spark, sf_dir)
    # each is read several times
    d = durable(section_picks(spark, sf_dir).select("id", "day", "section", "grade").join(focus_value(spark, sf_dir), "id"))
    sets, pairs = sim.rarity_sets(t.select("id", "tokens"), among=d.select("id", "day"), block=["day"], least=focus.ATTACHED_FROM)
    topics = durable(running_topics(t).join(d.select("id"), "id", "left_semi"))
    return focus.sections(d, pairs, topics, sets).join(d.select("id", "minutes"), "id")


@query()
def focus_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pick's part in a day's focus: cards, what is attached to them, lines and facts, one editorial and background read per topic, and their twins."""
    return day_sections(spark, sf_dir).select("day", "id", "part", "under")


@query()
def focus_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the focus fits in 30, 60 and 90 minutes."""
    d = day_sections(spark, sf_dir).where("part in ('card', 'line', 'fact', 'ed', 'bg')").withColumn("is_must", F.col("value") >= focus.MUST_FROM)
    d = d.withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS))))
    return focus.fitted(d, ["day"], "budget", [-F.col("value"), F.col("id")])


@query(f"""{_TIERS}, picked AS (SELECT id, day, CASE tier WHEN 'top' THEN 'card' WHEN 'prelims' THEN 'fact' ELSE 'line' END AS part, bs AS score, grade, 3 AS base FROM t WHERE tier IS NOT NULL
    UNION ALL SELECT id, day, CASE kind WHEN 'editorial' THEN 'ed' ELSE 'bg' END, score, grade, CASE kind WHEN 'editorial' THEN 6 ELSE 5 END FROM g WHERE kind <> 'news' AND grade <> 'LOW'),
  budgets AS (SELECT *, base + CASE WHEN grade = 'NOTE' THEN 1 ELSE 0 END AS minutes, score >= 5.0 AS must FROM picked, (VALUES (30), (60), (90)) v(budget)),
  running AS (SELECT *, sum(minutes) OVER p AS spent, row_number() OVER p AS nth FROM budgets WINDOW p AS (PARTITION BY day, budget, part ORDER BY score DESC, id)),
  carded AS (SELECT *, part = 'card' AND (nth <= 3 OR spent <= budget * 0.5) AS card FROM running),
  overs AS (SELECT *, part = 'card' AND NOT card AND must AS isover FROM carded),
  lined AS (SELECT *, isover OR (part = 'line' AND nth <= floor(budget * 0.15 / 0.5 + 0.5) - count(*) FILTER (WHERE isover) OVER (PARTITION BY day, budget)) AS line, part = 'fact' AND nth <= floor(budget * 0.15 / 0.5 + 0.5) AS fact FROM overs),
  resting AS (SELECT *, budget - sum(CASE WHEN card THEN minutes WHEN line OR fact THEN 0.5 ELSE 0 END) OVER (PARTITION BY day, budget) AS rest FROM lined),
  read_ AS (SELECT *, part = 'ed' AND (nth <= 1 OR spent <= rest - CASE WHEN budget >= 90 THEN 5 ELSE 0 END) AS ed FROM resting),
  fitting AS (SELECT *, part = 'bg' AND budget >= 90 AND spent <= rest - sum(CASE WHEN ed THEN minutes ELSE 0 END) OVER (PARTITION BY day, budget) AS bg FROM read_),
  kept AS (SELECT day, budget, id, score, isover, CASE WHEN isover THEN 'line' ELSE part END AS part FROM fitting WHERE card OR line OR fact OR ed OR bg)
  SELECT day, budget, id, part, row_number() OVER (PARTITION BY day, budget, part ORDER BY NOT isover, score DESC, id) AS place FROM kept""")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of 30, 60 and 90 minutes over a day's tiers as they are, by score."""
    d = section_picks(spark, sf_dir)
    s = F.col("section")
    part = F.when(s == "news", "card").when(s == "prelims", "fact").when(s == "more", "line").when(s == "editorials", "ed").otherwise("bg")
    kind = F.when(s == "editorials", "editorial").when(s == "explained", "explained").otherwise("news")
    d = d.withColumns({"part": part, "minutes": products.reading_minutes(kind, F.col("grade"), F.lit(1)), "is_must": F.col("score") >= 5.0, "budget": F.explode(F.array(*map(F.lit, BUDGETS)))})
    return focus.fitted(d, ["day"], "budget", [-F.col("score"), F.col("id")])
