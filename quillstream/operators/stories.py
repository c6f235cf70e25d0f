"""Stories made of reports, and the reports' rejection and removal from domestic subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a report's first, second and third subject weigh in its story.
SUBJECT_WEIGHTS = (3, 2, 1)
SUBJECTS, TAGS, SUMMARY = 3, 6, 700


def _weighted(members: DataFrame, column: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(story, column): the heaviest values of an ordered array column over a story's reports, ties by name."""
    e = members.select("story", F.posexplode(F.array_distinct(column)).alias("p", "v"))
    weight = F.lit(weights[-1])
    for k, w in enumerate(weights):
        weight = F.when(F.col("p") == k, w).otherwise(weight)
    s = e.groupBy("story", "v").agg(F.sum(weight).alias("w"))
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("w"), "v"))).where(F.col("rn") <= most)
    return s.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))), lambda x: x["v"]).alias(column))


def aggregated(members: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """One row for each story of reports (story, id, publisher, tier, kind, lang, day, title, body, score, subjects, tags).

    The report that stands for a story is of the best tier, has a summary, and is the earliest. Publishers come in the order
    of their best report. A story that half of its reports are rejected from (score 0 or less) has the score 0.
    """
    rank = F.lit(0)
    for name, r in tiers.items():
        rank = F.when(F.col("tier") == name, r).otherwise(rank)
    summary = F.trim(F.coalesce("body", F.lit("")))
    m = members.withColumn("rank", rank).withColumn("first", F.struct(-F.col("rank"), (summary == "").cast("int"), "day", "id"))
    by_publisher = m.groupBy("story", "publisher").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    publishers = by_publisher.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "publisher"))), lambda x: x["publisher"]).alias("publishers"))
    s = m.groupBy("story").agg(
        F.min_by(F.struct("id", "title", F.left(summary, F.lit(SUMMARY)).alias("summary")), "first").alias("lead"), F.count(F.lit(1)).alias("n_items"), F.max("score").alias("best"),
        F.count_if(F.col("score") <= 0).alias("rejected"), F.array_sort(F.collect_set("day")).alias("days"), F.bool_and(F.col("kind") == "editorial").alias("is_editorial"), F.bool_or(F.col("lang") != "en").alias("any_foreign"),
    )
    s = s.join(publishers, "story", "left").join(_weighted(m, "subjects", SUBJECT_WEIGHTS, SUBJECTS), "story", "left").join(_weighted(m, "tags", (1,), TAGS), "story", "left")
    none = F.array().cast("array<string>")
    return s.select(
        "story", F.col("lead.id").alias("lead"), "lead.title", "lead.summary", "n_items", "publishers", F.coalesce("subjects", none).alias("subjects"), F.coalesce("tags", none).alias("tags"),
        F.when(2 * F.col("rejected") > F.col("n_items"), 0.0).otherwise(F.col("best")).alias("base"), "days", "is_editorial", "any_foreign",
    )


def moved(scores: DataFrame, foreign: DataFrame, domestic: tuple[str, ...], to: str) -> DataFrame:
    """Scores (id, bucket, score) of the ids in `foreign` with what their domestic subjects have added to another one."""
    f = scores.join(foreign.select("id", F.lit(True).alias("is_foreign")), "id", "left")
    bucket = F.when(F.col("is_foreign") & F.col("bucket").isin(*domestic), to).otherwise(F.col("bucket"))
    return f.groupBy("id", bucket.alias("bucket")).agg(F.round(F.sum("score"), 4).alias("score"))


def rejection(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def walked(attempts: DataFrame, active: DataFrame) -> DataFrame:
    """(source, active, used, failed): of each source the first step, from its active one on, that succeeded.

    `attempts` has source, step, and ok: a step that failed, or was empty where that is not allowed, is not; `active` has
    source and active. A source of whose steps none succeeded has used null.
    """
    a = active.join(attempts, "source", "left").where("step is null or step >= active")
    s = a.groupBy("source", "active").agg(F.min(F.when(F.col("ok"), F.col("step"))).alias("used"), F.collect_set(F.when(~F.col("ok"), F.col("step"))).alias("bad"))
    failed = F.size(F.filter("bad", lambda k: F.col("used").isNull() | (k < F.col("used")))).cast("long")
    every = active.join(s, ["source", "active"], "left")
    return every.select("source", "active", "used", F.coalesce(failed, F.lit(0).cast("long")).alias("failed"))
