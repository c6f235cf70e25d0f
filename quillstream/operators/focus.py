"""A day's focus: its parts with what is said twice folded, one piece per topic, and the parts' shares of a reader's minutes.

What is chosen best first, leaving out whatever conflicts with an earlier choice, is found in rounds: a piece that is the best of
all its undecided conflicts is chosen, those that conflict with it are left out, and so on until none is undecided. That is
what the sequential walk gives, and no day is one task. Conflicts are groups of pieces of which at most
one may be chosen: a topic is one group however many pieces it has, a pair of like pieces is a group of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.similarity import both_ways, durable

#: Likeness at which a piece goes under a card and at which two pieces are one; worth of a line, a read, and a card that must stay.
ATTACHED_FROM, TWINS_FROM, LINE_FROM, READ_FROM, MUST_FROM = 0.15, 0.25, 3.0, 3.4, 5.0
#: Minutes of a line or a fact and of a background read, shares of the budget, pieces that are taken in any case, budget from which background is read.
LINE_MINUTES, BACKGROUND_MINUTES = 0.5, 5
SHARES = {"card": 0.5, "line": 0.15, "fact": 0.15}
LEAST_CARDS, LEAST_READS, BACKGROUND_FROM = 3, 1, 90


def chosen(pieces: DataFrame, groups: DataFrame, order: list[Column]) -> DataFrame:
    """The ids that a walk in `order` (total) chooses if it passes over those in a group with one it has chosen.

    `groups` has id and group, of any type; ids without a group are all chosen. A piece in `pieces` twice counts once.
    """
    pieces = durable(pieces.dropDuplicates(["id"]))
    every = durable(groups.select("id", F.col("group").cast("string").alias("group")).join(pieces.select("id"), "id", "left_semi").distinct())
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col("id"))
    left = pieces.select("id", key.alias("key"))
    out = left.select("id").limit(0)
    while True:
        m = every.join(left, "id")
        best = m.groupBy("group").agg(F.min("key").alias("best"))
        firsts = m.join(best, "group").groupBy("id").agg(F.bool_and(F.col("key") == F.col("best")).alias("is_first"))
        state = durable(left.join(firsts, "id", "left").select("id", "key", F.coalesce("is_first", F.lit(True)).alias("wins")))
        won = state.where("wins").select("id")
        out = out.union(won)
        closed = every.join(won, "id").select("group").distinct()
        lost = every.join(closed, "group").select("id").distinct()
        left = durable(state.where("not wins").join(lost, "id", "left_anti").select("id", "key"))
        if left.isEmpty():
            return out


def under(left_out: DataFrame, kept: DataFrame, groups: DataFrame, order: list[Column]) -> DataFrame:
    """(id, under): of each id that was left out the first kept one, in `order` of the kept ones' columns, that it has a group with."""
    g = groups.select("id", F.col("group").cast("string").alias("group"))
    k = kept.select(F.col("id").alias("kept"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col("id")).alias("key"))
    there = g.withColumnRenamed("id", "kept").join(k, "kept").groupBy("group").agg(F.min("key").alias("key"))
    return g.join(left_out.select("id"), "id", "left_semi").join(there, "group").groupBy("id").agg(F.min("key").alias("key")).select("id", F.col("key.id").alias("under"))


def sections(picks: DataFrame, pairs: DataFrame, topics: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """day, id, part, under and value of picks (id, day, section, value), with the likeness of pairs (a, b, similarity) and topics (id, topic) of one day's picks.

    With `sets` (id, set) the pairs are of sets of one day; ids of a set in a pair are alike among themselves, and a set's pair with itself says just that.

    Sections are news, prelims, more, editorials and explained. Cards are the news. Another pick goes under the card it is most
    like, where a topic in common counts as a likeness of ATTACHED_FROM (ties: the better card). What is left and worth it: facts of prelims and lines
    of the rest of the news, twins folded; editorials and background, one per topic and event.
    """
    p = durable(picks.select("id", "day", "section", "value"))
    best_first = [-F.col("value")]
    t = topics.join(p.select("id", "day"), "id").select("id", F.concat_ws("|", F.lit("t"), "day", "topic").alias("group"))
    of = p.select("id", F.col("id").alias("set")) if sets is None else durable(sets.join(p.select("id"), "id", "left_semi").select("id", "set"))
    both = both_ways(pairs)
    cards = p.where("section = 'news'").select(F.col("id").alias("card"), (-F.col("value")).alias("worse"))
    others = p.where("section <> 'news'")
    # by likeness, and by topic with the best card of it
    # of a set's cards only the best one counts
    set_card = of.join(cards, F.col("id") == F.col("card")).groupBy(F.col("set").alias("a")).agg(F.min(F.struct("worse", "card")).alias("c"))
    to_set = both.where(F.col("similarity") >= ATTACHED_FROM).join(set_card, "a").groupBy(F.col("b").alias("set")).agg(F.min(F.struct((-F.col("similarity")).alias("less"), "c.worse", "c.card")).alias("w"))
    like = of.join(to_set, "set").select("id", (-F.col("w.less")).alias("similarity"), "w.worse", "w.card")
    topic_card = t.join(cards, F.col("id") == F.col("card")).groupBy("group").agg(F.min(F.struct("worse", "card")).alias("c"))
    by_topic = t.join(topic_card, "group").select("id", F.lit(ATTACHED_FROM).alias("similarity"), "c.worse", "c.card")
    ways = like.union(by_topic).join(others.select("id"), "id", "left_semi")
    attached = ways.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "worse", "card")).alias("w")).select("id", F.col("w.card").alias("card"))
    attached = durable(attached)
    rest = others.join(attached, "id", "left_anti")
    twin = pairs.where(F.col("similarity") >= TWINS_FROM).select(F.concat_ws("|", F.lit("p"), F.least("a", "b"), F.greatest("a", "b")).alias("group"), F.explode(F.array("a", "b")).alias("set"))
    twins = of.join(twin, "set").select("id", "group")
    parts = [cards.join(p.withColumnRenamed("id", "card"), "card").select("day", F.col("card").alias("id"), F.lit("card").alias("part"), F.lit(None).cast("long").alias("under"), "value")]
    parts.append(attached.join(p, "id").select("day", "id", F.lit("attached"), "card", "value"))
    reads = rest.withColumn("part", F.when(F.col("section") == "editorials", "ed").when(F.col("section") == "explained", "bg"))
    news = rest.withColumn("part", F.when(F.col("section") == "prelims", "fact").when(F.col("section") == "more", "line"))
    for own, least, groups, first in ((news, LINE_FROM, twins, [F.col("part") != "line"]), (reads, READ_FROM, twins.union(t), [])):
        own = own.where(F.col("part").isNotNull() & (F.col("value") >= least))
        # editorials and background don't know of each other
        g = groups.join(own.select("id", F.when(F.col("part").isin("ed", "bg"), F.col("part")).otherwise("news").alias("list")), "id").select("id", F.concat_ws("|", "list", "group").alias("group"))
        own = durable(own)
        kept = own.join(chosen(own, g, best_first), "id", "left_semi")
        out = own.join(kept.select("id"), "id", "left_anti")
        parts.append(kept.select("day", "id", "part", F.lit(None).cast("long"), "value"))
        parts.append(out.join(under(out, kept, g, [*first, *best_first]), "id").select("day", "id", F.lit("twin"), "under", "value"))
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    return every


def fitted(parts: DataFrame, by: list[str], budget: str, order: list[Column]) -> DataFrame:
    """The pieces that fit a reader's minutes: `parts` has the columns `by`, id, part (card, line, fact, ed or bg), minutes, is_must and `budget`.

    Cards take half of the budget, three of them in any case; a card beyond it that must stay becomes a line, before the other lines. Lines and facts
    have so many places each as their share has half-minutes. What the parts before leave goes to editorials, one in any case, and from 90 minutes on to background, for which
    one read's minutes are kept. Each part is taken in order up to the first piece that does not fit. Adds part and place; a group without pieces has no rows.
    """
    b = F.col(budget).cast("double")
    running = lambda *keys: F.sum("minutes").over(Window.partitionBy(*by, budget, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*by, budget, *keys).orderBy(*order))
    d = parts.withColumns({"_spent": running("part"), "_nth": nth("part")})
    taken = (F.col("part") == "card") & ((F.col("_nth") <= LEAST_CARDS) | (F.col("_spent") <= b * SHARES["card"]))
    d = d.withColumn("_card", taken).withColumn("_over", (F.col("part") == "card") & ~taken & F.col("is_must"))
    places = lambda part: F.floor(b * SHARES[part] / LINE_MINUTES + 0.5)
    whole = Window.partitionBy(*by, budget)
    d = d.withColumn("_overs", F.count_if("_over").over(whole))
    d = d.withColumn("_line", F.col("_over") | ((F.col("part") == "line") & (F.col("_nth") <= places("line") - F.col("_overs"))))
    d = d.withColumn("_fact", (F.col("part") == "fact") & (F.col("_nth") <= places("fact")))
    used = F.sum(F.when(F.col("_card"), F.col("minutes")).when(F.col("_line") | F.col("_fact"), LINE_MINUTES).otherwise(0.0)).over(whole)
    d = d.withColumn("_left", b - used)
    kept_back = F.when(b >= BACKGROUND_FROM, BACKGROUND_MINUTES).otherwise(0)
    d = d.withColumn("_ed", (F.col("part") == "ed") & ((F.col("_nth") <= LEAST_READS) | (F.col("_spent") <= F.col("_left") - kept_back)))
    d = d.withColumn("_read", F.sum(F.when(F.col("_ed"), F.col("minutes")).otherwise(0.0)).over(whole))
    d = d.withColumn("_bg", (F.col("part") == "bg") & (b >= BACKGROUND_FROM) & (F.col("_spent") <= F.col("_left") - F.col("_read")))
    d = d.where("_card or _line or _fact or _ed or _bg").withColumn("part", F.when(F.col("_over"), "line").otherwise(F.col("part")))
    place = F.row_number().over(Window.partitionBy(*by, budget, "part").orderBy(~F.col("_over"), *order))
    return d.withColumn("place", place.cast("long")).select(*by, budget, "id", "part", "place")
