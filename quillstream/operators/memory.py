"""Stories with a memory: a report joins a story that had one within the last days, and that one of its first reports resembles.

Reports come in the order of their day and id. Each joins the story with the best likeness to one of its first
MEMBERS reports (ties: the story founded first) if that story's last report is at most IDLE_DAYS days
old, or else founds one. So a story of routine headlines ends when nobody repeats them, and does not collect those of next month.

Likeness is between sets of words, so it is computed for distinct sets and not for reports: a headline that is repeated a
thousand times is one set. Sets that resemble each other make blocks; where a block is idle for
longer than the memory, no story goes on, so it is cut there. Decisions are taken in each stretch of a block by itself, and
stretches with one report take none.

What is remembered of a story (its first reports, its first and last day) is a table, so the same
function serves a whole history at once and a stream batch by batch (streaming.stories). Reports without a day, kind or id are
left out, of those with one id the first row of the order counts; sets of less than two words found stories that nothing can join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators import clusters
from quillstream.operators import similarity as sim

IDLE_DAYS, MEMBERS = 3, 8
#: What is remembered: a row for each of a story's first reports, by place from 0 on.
MEMORY = "story long, kind string, founded long, last long, reports long, place int, id long, tokens array<string>"


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEMORY)


def _stretches(rows: DataFrame, idle_days: int) -> DataFrame:
    """Adds `stretch`: the number of times that a block was idle before a row."""
    w = Window.partitionBy("block").orderBy("day")
    idle = F.when(F.col("day") - F.lag("day").over(w) > idle_days, 1).otherwise(0)
    return rows.withColumn("_idle", idle).withColumn("stretch", F.sum("_idle").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_idle")


def joined(rows: pd.DataFrame, links: pd.DataFrame, idle_days: int) -> pd.DataFrame:
    """(id, story) of the new rows of a stretch. Rows have id, sid (of their set), day, and for remembered ones story, founded and place."""
    near: dict[int, dict[int, float]] = {s: {s: 2.0} for s in rows["sid"].unique()}
    for a, b, s in zip(links["a"], links["b"], links["similarity"], strict=True):
        near[a][b] = near[b][a] = s
    names: list[int] = []
    last: list[int] = []
    size: list[int] = []
    holding: dict[int, list[int]] = {}  # of a set, the stories that have it among their first reports

    def add(story: int, sid: int) -> None:
        if size[story] < MEMBERS:
            own = holding.setdefault(sid, [])
            if story not in own[-1:]:
                own.append(story)
        size[story] += 1

    old = rows[rows["story"].notna()].sort_values(["founded", "story", "place"])
    at: dict[int, int] = {}
    for story, sid, day in zip(old["story"].astype("int64"), old["sid"], old["day"], strict=True):
        if story not in at:
            at[story] = len(names)
            names.append(story)
            last.append(day)
            size.append(0)
        add(at[story], sid)
    new = rows[rows["story"].isna()].sort_values(["day", "id"])
    out = []
    for i, sid, day in zip(new["id"], new["sid"], new["day"], strict=True):
        best, top = None, 0.0
        for other, s in near[sid].items():
            own = holding.get(other)
            if not own:
                continue
            own = holding[other] = [g for g in own if last[g] >= day - idle_days]
            if own and (s > top or (s == top and min(own) < best)):
                best, top = min(own), s
        if best is None:
            best = len(names)
            names.append(i)
            last.append(day)
            size.append(0)
        last[best] = max(last[best], day)
        add(best, sid)
        out.append((i, names[best]))
    return pd.DataFrame(out, columns=["id", "story"])


def assigned(reports: DataFrame, memory: DataFrame | None = None, *, idle_days: int = IDLE_DAYS) -> DataFrame:
    """(id, kind, day, tokens, story) of reports (id, kind, day, tokens), which come after all that `memory` was made of."""
    memory = nothing(reports.sparkSession) if memory is None else memory
    r = reports.select(F.col("id").cast("long").alias("id"), "kind", F.col("day").cast("long").alias("day"), F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    r = r.where("id is not null and kind is not null and day is not null and tokens is not null")
    r = r.groupBy("id").agg(F.min(F.struct("day", "kind", "tokens")).alias("x")).select("id", "x.*")
    none = {"story": F.lit(None).cast("long"), "founded": F.lit(None).cast("long"), "place": F.lit(None).cast("int")}
    rows = r.withColumns(none).unionByName(memory.select("id", F.col("last").alias("day"), "kind", "tokens", "story", "founded", "place"))
    sets = rows.where(F.size("tokens") >= 2).groupBy("kind", "tokens").agg(F.min("id").alias("sid"))
    pairs = clusters.durable(sim.similar_sets(sets.withColumnRenamed("sid", "id"), block=["kind"]))
    of = clusters.blocks(pairs)
    rows = rows.join(sets, ["kind", "tokens"], "left").withColumn("sid", F.coalesce("sid", "id"))
    rows = rows.join(of.withColumnRenamed("id", "sid"), "sid", "left").withColumn("block", F.coalesce("block", "sid"))
    rows = _stretches(rows, idle_days).select("id", "sid", "day", "story", "founded", "place", "block", "stretch")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("block", "stretch")))
    there = rows.where("n > 1").select("block", "stretch", "sid").distinct()
    links = pairs.join(there.withColumnRenamed("sid", "a"), "a").join(there.withColumnRenamed("sid", "b"), ["block", "stretch", "b"]).select(F.col("block").alias("of_block"), F.col("stretch").alias("of_stretch"), "a", "b", "similarity")

    def assign(key: tuple, own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        return joined(own, near, idle_days) if len(own) else pd.DataFrame({"id": pd.Series(dtype="int64"), "story": pd.Series(dtype="int64")})

    decided = rows.where("n > 1").groupBy("block", "stretch").cogroup(links.groupBy("of_block", "of_stretch")).applyInPandas(assign, "id long, story long")
    return r.join(decided, "id", "left").select("id", "kind", "day", "tokens", F.coalesce("story", "id").alias("story"))


def remembered(memory: DataFrame, news: DataFrame, *, idle_days: int = IDLE_DAYS, now: int | None = None) -> DataFrame:
    """The memory after the assigned reports `news`: stories with a report in the last days before `now`, or else before the last report of all."""
    first = Window.partitionBy("story").orderBy("day", "id")
    n = news.withColumn("place", F.row_number().over(first)).groupBy("story").agg(
        F.max("kind").alias("kind"), F.min("day").alias("founded"), F.max("day").alias("last"), F.count(F.lit(1)).alias("reports"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= MEMBERS, F.struct("place", "id", "tokens")))).alias("more"),
    )
    m = memory.groupBy("story").agg(
        F.max("kind").alias("_kind"), F.min("founded").alias("_founded"), F.max("last").alias("_last"), F.max("reports").alias("_reports"), F.array_sort(F.collect_list(F.struct("place", "id", "tokens"))).alias("own")
    )
    none = F.slice("more", 1, 0)
    j = m.join(n, "story", "full_outer").withColumn("all", F.slice(F.concat(F.coalesce("own", none), F.coalesce("more", none)), 1, MEMBERS))
    j = j.select(
        "story", F.coalesce("_kind", "kind").alias("kind"), F.coalesce("_founded", "founded").alias("founded"), F.greatest("_last", "last").alias("last"),
        (F.coalesce("_reports", F.lit(0)) + F.coalesce("reports", F.lit(0))).alias("reports"), F.posexplode("all").alias("place", "x"),
    )
    j = j.select("story", "kind", "founded", "last", "reports", "place", "x.id", "x.tokens")
    if now is not None:
        return j.where(F.col("last") >= now - idle_days)
    return j.join(F.broadcast(j.agg(F.max("last").alias("now"))), F.col("last") >= F.col("now") - idle_days).drop("now")
