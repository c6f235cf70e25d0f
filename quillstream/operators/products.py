"""Data products: focus values, spaced repetition, practice questions, planners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an item is worth by its verdict, or without one by its grade, and what its section in the digest adds.
WORTH_BY_VERDICT = {3: 6.0, 2: 3.6, 1: 1.6, 0: 0.0}
WORTH_BY_GRADE = {"NOTE": 4.8, "SKIM": 3.2, "READ": 1.6, "LOW": 0.5}
WORTH_BY_SECTION = {"news": 1.0, "prelims": 0.3}
WORTH_OTHERWISE = 1.0
#: Facts about an item, what one unit of each adds, and how many units count.
LIFTS = (
    ("event", 0.5, 3.0), ("talk", -0.6, 2.0), ("soft", -0.6, 1.0), ("official", 0.3, 1.0), ("syllabus", 0.3, 1.0), ("running_topic", 0.3, 1.0),
    ("notice", -4.0, 1.0), ("local", -2.0, 1.0), ("routine", -1.5, 1.0),
)
#: Factor and power of the outlets beyond the first, ten at most.
OUTLETS_FACTOR, OUTLETS_POWER, OUTLETS_MOST = 0.12, 0.8, 10
#: Verdict that no routine of a place of its own lowers.
TOP_VERDICT = 3


def lookup(key: Column, table: dict, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def focus_value(verdict: Column, grade: Column, publishers: Column, facts: dict[str, Column], section: Column | None = None) -> Column:
    """What an item is worth to a reader: the verdict's worth or else the grade's, the section's, the outlets', and all LIFTS.

    `facts` are numbers or conditions by the names in LIFTS; what is not given, or null, counts nothing. A notice is not
    lowered as local news as well, nor is what the best verdict has.
    """
    whole = F.when(verdict.isNotNull(), lookup(verdict, WORTH_BY_VERDICT, 0.0)).otherwise(lookup(grade, WORTH_BY_GRADE, WORTH_OTHERWISE))
    beyond = F.greatest(F.lit(1), F.least(publishers, F.lit(OUTLETS_MOST))).cast("double") - 1.0
    whole = whole + F.pow(beyond, F.lit(OUTLETS_POWER)) * OUTLETS_FACTOR
    if section is not None:
        whole = whole + lookup(section, WORTH_BY_SECTION, 0.0)
    given = {name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in facts.items()}
    if "local" in given:
        exempt = F.coalesce(verdict == TOP_VERDICT, F.lit(False)) | (given.get("notice", F.lit(0.0)) > 0)
        given["local"] = F.when(exempt, 0.0).otherwise(given["local"])
    for name, unit, most in LIFTS:
        if name in given:
            whole = whole + F.least(given[name], F.lit(most)) * unit
    return whole


def reading_minutes(kind: Column, grade: Column, publishers: Column) -> Column:
    base = F.when(kind == "editorial", 6).when(kind == "explained", 5).otherwise(3)
    return base + (grade == "NOTE").cast("int") + (publishers >= 5).cast("int")


def srs_state(reviews: DataFrame, by: list[str]) -> DataFrame:
    """State of each card after its reviews (day, grade 1 to 4) in order: ease, interval in days, due day, lapses.

    A failed card starts again after a day; others grow by their ease, which moves with the grade.
    """
    g = reviews.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("day", "at", "grade"))).alias("r"))
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(0).cast("long").alias("interval"), F.lit(0).cast("long").alias("due"), F.lit(0).cast("long").alias("lapses"))

    def step(s: Column, r: Column) -> Column:
        failed = r["grade"] == 1
        ease = F.greatest(F.lit(1.3), s["ease"] + F.when(failed, -0.2).when(r["grade"] == 2, -0.15).when(r["grade"] == 4, 0.15).otherwise(0.0))
        grown = F.when(s["interval"] == 0, F.when(r["grade"] == 4, 4).otherwise(1)).when(r["grade"] == 2, F.greatest(F.lit(1.0), s["interval"] * 1.2)).otherwise(s["interval"] * ease)
        interval = F.when(failed, 1).otherwise(F.floor(grown)).cast("long")
        return F.struct(ease.alias("ease"), interval.alias("interval"), (r["day"] + interval).cast("long").alias("due"), (s["lapses"] + failed.cast("long")).alias("lapses"))

    return g.select(*by, F.aggregate("r", start, step).alias("s")).select(*by, "s.*")


def cloze(sentences: DataFrame, names: DataFrame, *, most: int = 2) -> DataFrame:
    """Questions (id, place, question, options, answer): a name in a sentence is blanked, three others are offered beside it.

    Choice and order come from SHA-1 of id, place and name, so they are the same in every run. `names` is a small table.
    """
    from pyspark.sql import Window

    w = sentences.select("id", "place", "text", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("name"))
    hit = w.join(F.broadcast(names), "name").withColumn("seed", F.sha1(F.concat_ws("|", "id", "place", "name")))
    hit = hit.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("seed"))).where(F.col("rn") <= most)
    pool = F.broadcast(names.agg(F.sort_array(F.collect_list("name")).alias("pool")))
    q = hit.join(pool)
    others = F.slice(F.array_sort(F.transform(F.array_remove("pool", F.col("name")), lambda n: F.struct(F.sha1(F.concat(F.col("seed"), n)).alias("h"), n.alias("n")))), 1, 3)
    options = F.array_sort(F.transform(F.concat(F.transform(others, lambda o: o["n"]), F.array("name")), lambda n: F.struct(F.sha1(F.concat(n, F.col("seed"))).alias("h"), n.alias("n"))))
    blank = F.regexp_replace(F.lower("text"), F.concat(F.lit("(^|[^a-z0-9])"), F.col("name"), F.lit("([^a-z0-9]|$)")), F.lit("$1____$2"))
    return q.select("id", "place", blank.alias("question"), F.transform(options, lambda o: o["n"]).alias("options"), F.col("name").alias("answer"))


def swapped_statements(sentences: DataFrame, by: list[str], place: str) -> DataFrame:
    """True statements, the sentences that have a figure, and false ones: with their first figure replaced by that of the next such sentence.

    The last sentence of a group takes the first one's figure; where both are alike there is no false statement.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(place)
    f = sentences.withColumn("n", F.regexp_extract("text", r"[0-9]+(?:\.[0-9]+)?", 0)).where("n <> ''")
    f = f.withColumn("other", F.coalesce(F.lead("n").over(w), F.first("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    at = F.instr("text", F.col("n"))
    false = F.concat(F.substring("text", 1, at - 1), F.col("other"), F.substring("text", at + F.length("n"), F.length("text")))
    return f.select(*by, place, F.lit(True).alias("holds"), F.col("text").alias("statement")).union(f.where("other <> n").select(*by, place, F.lit(False), false))


#: Likeness at which a piece goes under a card, and at which two lines are one; worth that a line needs.
ATTACHED_FROM, TWINS_FROM, LINE_FROM = 0.15, 0.25, 3.0


def focus_layout(picks: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """day, id, part and under of picks (id, day, tier, value), by the likeness of pairs (a, b, similarity) of `sets` (id, set) of one day.

    Cards are the top tier. Another pick goes under the card it is most like (ties: the lesser id). Of the others those of
    worth are facts or lines, best first; one that is like an earlier one is its twin. The rest has no part. A set's pair with
    itself says that its ids are alike; its least card stands for its cards.
    """
    from quillstream.operators import clusters
    from quillstream.operators import similarity as sim

    cards = picks.where("tier = 'top'").join(sets, "id").groupBy(F.col("set").alias("a")).agg(F.min("id").alias("card"))
    to_card = sim.both_ways(pairs.where(F.col("similarity") >= ATTACHED_FROM)).join(cards, "a")
    of_set = to_card.groupBy("b").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "card")).alias("w")).select(F.col("b").alias("set"), F.col("w.card").alias("card"))
    attached = sets.join(of_set, "set").select("id", "card")
    d = picks.join(attached, "id", "left").withColumn("card", F.when(F.col("tier") != "top", F.col("card")))
    rest = d.where(F.col("card").isNull() & (F.col("tier") != "top") & (F.col("value") >= LINE_FROM)).withColumn("worse", -F.col("value"))
    # all who are alike are so to the same degree, so a twin goes to the best of them
    alike = pairs.where(F.col("similarity") >= TWINS_FROM).select("a", "b", F.lit(1.0).alias("similarity"))
    lead = clusters.greedy(rest, alike, ["worse"], members=1, least=TWINS_FROM, block="day", sets=sets)
    out = d.join(lead, "id", "left")
    part = F.when(F.col("tier") == "top", "card").when(F.col("card").isNotNull(), "attached").when(F.col("lead").isNull(), None).when(F.col("lead") != F.col("id"), "twin").when(F.col("tier") == "prelims", "fact").otherwise("line")
    under = F.coalesce("card", F.when(F.col("lead") != F.col("id"), F.col("lead")))
    return out.select("day", "id", part.alias("part"), under.alias("under")).where("part is not null")
