"""Practice questions of the documents' own sentences, and sets of them picked under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import practice
from quillstream.operators.clusters import durable
from quillstream.plans.registry import query
from quillstream.sources.tables import items, read

#: What an ending makes of a word here; rules that stand for lists of names.
KINDS = {"er": "person", "ed": "body", "tion": "place", "ing": "place", "ent": "body", "en": "person", "es": "scheme", "le": "scheme"}
RELATION = ("person", "body")
SET_SIZE = 12


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    stories = i.select(F.col("id").alias("story"), "day", F.floor(F.col("day") / 7).alias("week"), "title", F.col("body").alias("text"))
    s = i.select(F.col("id").alias("story"), F.posexplode(t.sentences(F.concat_ws(" ", "title", "body"), 40)).alias("place", "text"))
    return practice.questions(stories, s, KINDS, relation=RELATION)


@query()
def practice_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's pool: statements, blanks, figures and pairs."""
    d = pool(spark, sf_dir)
    return d.select("day", F.col("place").cast("long").alias("place"), "id", "story", "type", F.array_join("stem", "\n").alias("stem"), F.array_join("options", "|").alias("options"), "answer")


@query()
def practice_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of questions for each day; those of stories that labels know count as seen."""
    p = durable(pool(spark, sf_dir).select("day", "place", "id", "story", "type"))
    seen = p.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("story")), "story", "left_semi")
    return practice.picked(p, seen, SET_SIZE)
