"""Names in texts, in their order: a gazetteer of any size as a trie that is a table, walked by joins.

A row of the trie leads from a state by a word to the next state, and says which name ends there. Of each word of a text the words that
follow are kept beside it, so a step of the walk is one equi-join of the starts that are still alive with the trie,
and texts meet no row of it that their words do not name. Of each start the longest name counts, and names that lie within a longer one do not.

Words are runs of letters and digits, compared in lower case. Null texts have no names; a name that is in the gazetteer
under several kinds has the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.clusters import durable

#: Words of a titled person's name at most.
PERSON_WORDS = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))


def trie(gazetteer: DataFrame) -> DataFrame:
    """(state, word, next, name, kind, depth) of names (name, kind); a state is the words that lead to it."""
    g = gazetteer.select("name", "kind", F.transform(words_of(F.col("name")), F.lower).alias("w")).where("size(w) > 0")
    g = g.withColumn("key", F.array_join("w", " ")).groupBy("key").agg(F.min(F.struct("kind", "name", "w")).alias("x")).select("key", "x.*")
    steps = g.select("key", "name", "kind", F.posexplode("w").alias("at", "word"), "w")
    steps = steps.withColumn("state", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ")).withColumn("next", F.array_join(F.slice("w", F.lit(1), F.col("at") + 1), " "))
    ends = F.col("next") == F.col("key")
    return steps.groupBy("state", "word", "next").agg(F.max(F.when(ends, F.col("name"))).alias("name"), F.max(F.when(ends, F.col("kind"))).alias("kind"), F.max(F.col("at") + 1).alias("depth"))


def starts(texts: DataFrame, field: str, longest: int) -> DataFrame:
    """(id, start, w): every word of a text with those that follow, `longest` in all."""
    t = texts.select("id", words_of(F.expr(field)).alias("all"))
    return t.select("id", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1)).alias("start")).where("size(all) > 0").select("id", "start", F.slice("all", F.col("start") + 1, F.lit(longest)).alias("w"))


def hits(texts: DataFrame, field: str, gazetteer: DataFrame) -> DataFrame:
    """(id, start, stop, name, kind): the longest names of a column or expression that no longer one contains; stop is exclusive."""
    t = durable(trie(gazetteer))
    longest = t.agg(F.max("depth")).first()[0] or 0
    alive = starts(texts, field, max(1, longest)).select("id", "start", F.transform("w", F.lower).alias("w")).withColumn("state", F.lit(""))
    every = None
    for k in range(longest):
        edges = t.where(F.col("depth") == k + 1).select("state", F.col("word").alias("step"), "next", "name", "kind")
        alive = alive.withColumn("step", F.get("w", F.lit(k))).join(edges, ["state", "step"])
        found = alive.where("name is not null").select("id", "start", (F.col("start") + k + 1).alias("stop"), "name", "kind")
        every = found if every is None else every.union(found)
        alive = alive.select("id", "start", "w", F.col("next").alias("state"))
    if every is None:
        return texts.select("id", F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("name"), F.lit("").alias("kind")).limit(0)
    return uncontained(every)


def uncontained(found: DataFrame) -> DataFrame:
    """Of each start the longest hit, without those that end within one that started before."""
    of_start = Window.partitionBy("id", "start").orderBy(F.desc("stop"), "name")
    d = found.withColumn("rn", F.row_number().over(of_start)).where("rn = 1").drop("rn")
    before = F.max("stop").over(Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("before", before).where("before is null or stop > before").drop("before")


def titled(texts: DataFrame, field: str, titles: list[str]) -> DataFrame:
    """(id, start, stop, name, kind): persons, a title with up to PERSON_WORDS capitalised words behind it."""
    s = starts(texts, field, PERSON_WORDS + 1).where(F.lower(F.element_at("w", 1)).isin(*[x.lower() for x in titles]))
    capital = lambda k: F.coalesce(F.get("w", F.lit(k)).rlike("^[A-Z]"), F.lit(False))
    n, so_far = F.lit(0), F.lit(True)
    for k in range(1, PERSON_WORDS + 1):
        so_far = so_far & capital(k)
        n = n + so_far.cast("int")
    s = s.withColumn("n", n).where("n > 0")
    return s.select("id", "start", (F.col("start") + F.col("n") + 1).alias("stop"), F.array_join(F.slice("w", F.lit(2), F.col("n")), " ").alias("name"), F.lit("person").alias("kind"))


def in_order(found: DataFrame) -> DataFrame:
    """(id, place, name, kind): each name of a text once, by where it stands first."""
    d = found.groupBy("id", "name", "kind").agg(F.min("start").alias("start"))
    return d.select("id", F.row_number().over(Window.partitionBy("id").orderBy("start", "name")).alias("place"), "name", "kind")


def neighbours(found: DataFrame, left: str, right: str, gap: int) -> DataFrame:
    """(id, name, partner): names of the kind `left` with one of the kind `right` next among the hits, at most `gap` words behind."""
    nxt = Window.partitionBy("id").orderBy("start")
    d = found.withColumns({"partner": F.lead("name").over(nxt), "_kind": F.lead("kind").over(nxt), "_at": F.lead("start").over(nxt)})
    return d.where((F.col("kind") == left) & (F.col("_kind") == right) & (F.col("_at") - F.col("stop") <= gap)).select("id", "name", "partner")


def partners(relations: DataFrame) -> DataFrame:
    """(name, partner, n, rivals): the partner that most texts name, ties by name, and how many others there are."""
    c = relations.groupBy("name", "partner").agg(F.countDistinct("id").alias("n"))
    w = Window.partitionBy("name").orderBy(F.desc("n"), "partner")
    c = c.withColumn("rivals", F.count(F.lit(1)).over(Window.partitionBy("name")) - 1).withColumn("rn", F.row_number().over(w))
    return c.where("rn = 1").select("name", "partner", "n", "rivals")
