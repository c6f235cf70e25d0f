"""Weighted-term rules over token tables: scores, grades, tags and how coverage lifts a story.

Rules are small tables, bounded by the configuration and not by the data. The words of an item are
cut down to those that a rule names before anything is exploded or joined, in one pass over all fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names and lower bounds of grades, best first.
GRADES = (("NOTE", 5.5), ("SKIM", 3.2), ("READ", 1.6))
TIER_WEIGHT = {"official": 2.0, "premium": 1.5, "quality": 1.2, "general": 1.0}
REJECT = 0.0


#: A rule: bucket, term, weight.
Rule = tuple[str, str, float]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(bucket, term, weight), ready to be joined."""
    return F.broadcast(spark.createDataFrame(rules, "bucket string, term string, weight double"))


def weighted_terms(texts: DataFrame, rules: list[Rule], fields: dict[str, float]) -> DataFrame:
    """(id, bucket, score, terms): each distinct term of a field, a column or expression, counts once, times the field's factor.

    Scores are rounded to four places, so that rows are ranked alike in whatever order they were summed.
    """
    terms = F.array(*(F.lit(x) for x in sorted({term for _, term, _ in rules})))

    def found(field: str, factor: float) -> Column:
        words = F.split(F.lower(F.coalesce(F.expr(field), F.lit(""))), "[^a-z0-9]+")
        return F.transform(F.array_intersect(words, terms), lambda x: F.struct(x.alias("term"), F.lit(factor).alias("factor")))

    every = texts.select("id", F.inline(F.concat(*(found(c, factor) for c, factor in fields.items()))))
    return scored(every.join(rule_table(texts.sparkSession, rules), "term"))


def scored(matches: DataFrame) -> DataFrame:
    """(id, bucket, score, terms) of matches (id, bucket, term, weight, factor)."""
    return matches.groupBy("id", "bucket").agg(F.round(F.sum(F.col("weight") * F.col("factor")), 4).alias("score"), F.countDistinct("term").alias("terms"))


def leading_buckets(scores: DataFrame, *, least: float, most: int = 3) -> DataFrame:
    """The best buckets of each item, ties by name, with their rank."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "bucket")
    return scores.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def item_score(tier: Column, signal: Column, best: Column, tags: Column, noise: Column) -> Column:
    weight = F.lit(1.0)
    for name, w in TIER_WEIGHT.items():
        weight = F.when(tier == name, w).otherwise(weight)
    subject = F.when(best > 0, F.least(best / 4.0, F.lit(2.0))).otherwise(-1.5)
    return weight + F.least(signal, F.lit(4.0)) + subject + F.least(tags * 0.5, F.lit(1.5)) - noise


def grade(score: Column) -> Column:
    out = F.lit("LOW")
    for name, cut in reversed(GRADES):
        out = F.when(score >= cut, name).otherwise(out)
    return out


def coverage_bonus(publishers: Column) -> Column:
    return F.least(0.8 * F.log2(F.greatest(publishers, F.lit(1)).cast("double")), F.lit(3.0))


def story_score(best: Column, publishers: Column) -> Column:
    """A rejected story stays rejected, however many outlets carried it."""
    return F.when(best <= REJECT, best).otherwise(best + coverage_bonus(publishers))


def matching_tags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches, in their order."""
    return F.filter(F.array(*(F.when(text.rlike(p), name) for name, p in patterns.items())), lambda x: x.isNotNull())


def all_groups(text: Column, groups: list[str]) -> Column:
    """Every group (a pattern of alternatives) matches."""
    ok = F.lit(True)
    for g in groups:
        ok = ok & text.rlike(g)
    return ok


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that matches."""
    out = F.lit(otherwise)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def papers(subjects: Column, of: dict[str, str], order: tuple[str, ...]) -> Column:
    """Papers of the subjects, in the order of papers."""
    mapped = F.create_map(*(F.lit(x) for kv in of.items() for x in kv))
    return F.array_intersect(F.array(*map(F.lit, order)), F.transform(subjects, lambda s: F.try_element_at(mapped, s)))
