"""Headline rules read from a file: what a headline reports, how much of it is talk or noise, its tags, and its score for the brief."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import patterns
from quillstream.operators.patterns import PatternRule
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import GRADED_SQL, graded
from quillstream.sources import rule_files
from quillstream.sources.tables import ITEMS_SQL, items

RULES = rule_files.config(str(Path(__file__).with_name("headline_rules.json")))
_WEIGHTED = ("event", "talk", "hard", "noise")
TITLE_RULES = [PatternRule(b, p, w) for b in _WEIGHTED for p, w in RULES[b]]
TAG_RULES = [PatternRule(name, p) for name, p in RULES["tags"].items()]
_BRIEF = RULES["brief"]
#: Tags read the title and so much of the body.
_HEAD, _HEAD_CHARS = "concat(title, ' ', left(coalesce(body, ''), 220))", 220
#: What a curator's own pick adds to its event, and what makes an outlet's reports none at all.
CURATED, BLOCKED = 1.5, 10.0
FACT_TAGS = ("act", "pact", "species")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sum_sql(bucket: str) -> str:
    return "round(" + " + ".join(f"CASE WHEN regexp_matches(title, {_quoted('(?i)' + p)}) THEN CAST({w} AS DOUBLE) ELSE 0 END" for p, w in RULES[bucket]) + ", 4)"


def _names_sql(names: list[str]) -> str:
    return "coalesce(publisher IN (" + ", ".join(map(_quoted, names)) + "), false)"


_TAGS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(head, {_quoted('(?i)' + p)}) THEN '{name}' END" for name, p in RULES["tags"].items()) + ")"
SIGNALS_SQL = f"""h AS (SELECT *, title || ' ' || substr(coalesce(body, ''), 1, {_HEAD_CHARS}) AS head FROM items),
  signals AS (SELECT id, {_sum_sql("event")} + CASE WHEN {_names_sql(RULES["curators"])} THEN {CURATED} ELSE 0 END AS event, CASE WHEN {_sum_sql("hard")} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hard, {_sum_sql("talk")} AS talk,
    round({_sum_sql("noise")} + CASE WHEN {_names_sql(RULES["low_value"]["names"])} THEN {RULES["low_value"]["penalty"]} ELSE 0 END + CASE WHEN {_names_sql(RULES["blocked"])} THEN {BLOCKED} ELSE 0 END, 4) AS noise, {_TAGS_SQL} AS tags FROM h)"""


def _from(names: list[str]) -> Column:
    return F.coalesce(F.col("publisher").isin(*names), F.lit(False))


def signals(i: DataFrame) -> DataFrame:
    """Adds event, hard, talk, noise and the array tags to items."""
    d = patterns.with_matches(i, "title", TITLE_RULES, "_title")
    d = patterns.with_matches(d, _HEAD, TAG_RULES, "_head")
    total = lambda b: patterns.weight("_title", TITLE_RULES, b)
    noise = total("noise") + F.when(_from(RULES["low_value"]["names"]), RULES["low_value"]["penalty"]).otherwise(0.0) + F.when(_from(RULES["blocked"]), BLOCKED).otherwise(0.0)
    return d.withColumns({
        "event": total("event") + F.when(_from(RULES["curators"]), CURATED).otherwise(0.0), "hard": F.when(total("hard") > 0, 1.0).otherwise(0.0), "talk": total("talk"),
        "noise": F.round(noise, 4), "tags": patterns.buckets("_head", TAG_RULES),
    }).drop("_title", "_head")


def brief_score(score: Column) -> Column:
    """A grade's score, lifted by a development and an action and lowered by talk."""
    return F.round(score + _BRIEF["event"] * F.least("event", F.lit(_BRIEF["most_event"])) + _BRIEF["hard"] * F.col("hard") - _BRIEF["talk"] * F.col("talk"), 4)


def is_fact() -> Column:
    """A concrete development: no talk, and an event of weight or a tag that stands for one."""
    return (F.col("talk") <= 0) & ((F.col("event") >= _BRIEF["fact_event"]) | F.arrays_overlap("tags", F.array(*map(F.lit, FACT_TAGS))))


@query(f"WITH {ITEMS_SQL}, {SIGNALS_SQL} SELECT * FROM signals")
def headline_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regex rules over all items."""
    d = signals(items(spark, sf_dir))
    return d.select("id", "event", "hard", "talk", "noise", F.array_join("tags", ",").alias("tags"))


@query(f"""{GRADED_SQL}, {SIGNALS_SQL}, b AS (SELECT id, day, grade, round(score + {_BRIEF["event"]} * least(event, {_BRIEF["most_event"]}) + {_BRIEF["hard"]} * hard - {_BRIEF["talk"]} * talk, 4) AS signed, CASE WHEN signed = 0 THEN CAST(0 AS DOUBLE) ELSE signed END AS brief,
    talk <= 0 AND (event >= {_BRIEF["fact_event"]} OR len(list_intersect(string_split(tags, ','), ['{"', '".join(FACT_TAGS)}'])) > 0) AS fact, noise >= 5 AS rejected FROM g JOIN signals USING (id))
  SELECT id, day, brief, fact, rejected, CASE WHEN rejected OR brief < 3.4 THEN 'out' WHEN brief >= 4.2 AND grade = 'NOTE' THEN 'top' WHEN brief >= 4.2 AND fact THEN 'prelims' ELSE 'more' END AS section FROM b""")
def brief_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, fact and section of each item by the headline rules."""
    own = signals(items(spark, sf_dir)).select("id", "event", "hard", "talk", "noise", "tags")
    d = graded(spark, sf_dir).select("id", "day", "grade", "score").join(own, "id")
    d = d.select("id", "day", "grade", brief_score(F.col("score")).alias("brief"), is_fact().alias("fact"), (F.col("noise") >= 5).alias("rejected"))
    section = F.when(F.col("rejected") | (F.col("brief") < 3.4), "out").when((F.col("brief") >= 4.2) & (F.col("grade") == "NOTE"), "top").when((F.col("brief") >= 4.2) & F.col("fact"), "prelims").otherwise("more")
    return d.select("id", "day", "brief", "fact", "rejected", section.alias("section"))
