"""The whole analysis of an item by rules read from a file: subjects, other countries' affairs, signal and noise, watched areas, rejection, score.

All sets of terms are matched in one pass over the texts (`terms.matched_sets`). What was found in an item is one array, whose length the
rules bound, and everything after that is column expressions over it: one shuffle for the matches, one for the items.

Defined cases: null and empty texts have no terms; a null publisher is no outlet; equal scores rank by name; an item without any term has a row;
ids that come more than once are matched together.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators import rules as base
from quillstream.operators import terms
from quillstream.operators.rules import Rule
from quillstream.sources.rule_files import bucket_rules

#: Letters of scripts other than those read here; so many in a title reject it.
OTHER_SCRIPT, OTHER_LETTERS = r"[\x{0980}-\x{0DFF}\x{0590}-\x{06FF}\x{0E00}-\x{0E7F}\x{3040}-\x{9FFF}\x{AC00}-\x{D7AF}]", 3
NOISE_HEAD, WIDE_HEAD = "left(body, 400)", "left(body, 300)"
BLOCKED, SCRIPT, NOISY, LOCAL = "blocked outlet", "other script", "noise", "foreign local"
_EVERYWHERE = {"title": 1.0, "body": 1.0}
#: For each set of terms the fields it reads, and how much a term weighs there.
FIELDS: dict[str, dict[str, float]] = {
    "subjects": {"title": 2.0, "body": 1.0}, "signals": {"title": 1.0, "body": 0.5}, "noise": {"title": 1.0, NOISE_HEAD: 0.3}, "foreign": {"title": 1.0},
    "neighbours": {"title": 1.0}, "links": _EVERYWHERE, "exempt": _EVERYWHERE, "wide": {"title": 1.0, WIDE_HEAD: 1.0}, "home": _EVERYWHERE, "watch": _EVERYWHERE,
}
TOPIC_FIELDS = {"title": 2.0, "body": 1.0}


def watch_bucket(name: str, group: int) -> str:
    return f"{name}/{group}"


def term_sets(config: dict[str, Any]) -> dict[str, list[Rule]]:
    """The rules of each set: subjects by subject, countries by country, watched areas by area and group, all others in one bucket."""
    named = {name: [("", t, float(w)) for t, w in config[name].items()] for name in ("signals", "noise")}
    plain = {name: [("", t, 1.0) for t in config[name]] for name in ("neighbours", "links", "exempt", "wide", "home")}
    watch = [(watch_bucket(name, k), t, 1.0) for name, area in config["watch"].items() for k, group in enumerate(area["groups"]) for t in group]
    return {"subjects": bucket_rules(config["subjects"]), "foreign": [(country, t, 1.0) for t, country in config["foreign"].items()], "watch": watch, **named, **plain}


def _hits(items: DataFrame, found: DataFrame) -> DataFrame:
    """`items` with the array _hits of what was found in each."""
    per_item = found.groupBy("id").agg(F.collect_set(F.struct("set", "bucket", "term", "field", (F.col("weight") * F.col("factor")).alias("points"), "weight", "factor")).alias("_hits"))
    none = F.array().cast("array<struct<set:string,bucket:string,term:string,field:string,points:double,weight:double,factor:double>>")
    return items.join(per_item, "id", "left").withColumn("_hits", F.array_sort(F.coalesce("_hits", none)))


def _of(name: str, *, title_only: bool = False) -> Column:
    return F.filter("_hits", lambda h: (h["set"] == name) & ((h["field"] == "title") if title_only else F.lit(True)))


def _any(name: str, *, title_only: bool = False) -> Column:
    return F.size(_of(name, title_only=title_only)) > 0


def _points(hits: Column) -> Column:
    return F.round(F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["points"]), 4)


def _scores(name: str) -> Column:
    """(name, score) of each bucket found, by name."""
    buckets = F.array_sort(F.array_distinct(F.transform(_of(name), lambda h: h["bucket"])))
    return F.transform(buckets, lambda b: F.struct(b.alias("name"), _points(F.filter("_hits", lambda h: (h["set"] == name) & (h["bucket"] == b))).alias("score")))


def _best_first(scores: Column) -> Column:
    return F.transform(F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("down"), s["name"].alias("name")))), lambda s: F.struct(s["name"].alias("name"), (-s["down"]).alias("score")))


def _among(value: Column, names: list[str]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False)) if names else F.lit(False)


def _with_fields(config: dict[str, Any]) -> dict[str, tuple[list[Rule], dict[str, float]]]:
    sets = term_sets(config)
    return {name: (sets[name], fields) for name, fields in FIELDS.items()}


def _topic_set(config: dict[str, Any]) -> dict[str, tuple[list[Rule], dict[str, float]]]:
    return {"topics": (bucket_rules(config["topics"]), TOPIC_FIELDS)}


def analysed(items: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Adds to items (id, title, body, publisher, tier, kind) subjects, elsewhere, local, signal, noise, watch, rejected, score and grade."""
    return _judged(_hits(items, terms.matched_sets(items, _with_fields(config))), config).drop("_hits")


def analysed_topics(items: DataFrame, config: dict[str, Any]) -> DataFrame:
    """`topics` of items (id, title, body, publisher, tier, kind) with the subjects that `analysed` finds, texts read and matched once for both."""
    found = terms.matched_sets(items, _with_fields(config) | _topic_set(config))
    return _ranked_topics(_judged(_hits(items, found), config), config)


def _judged(d: DataFrame, config: dict[str, Any]) -> DataFrame:
    outlet, title = F.lower(F.trim(F.coalesce("publisher", F.lit("")))), F.coalesce("title", F.lit(""))
    abroad, links = _any("foreign"), F.array_distinct(F.transform(_of("links"), lambda h: h["term"]))
    # a link that two countries share is none where the headline names the other one
    sure = F.size(F.array_except(links, F.array(*map(F.lit, config["ambiguous"])).cast("array<string>"))) > 0
    linked = (F.size(links) > 0) & (sure | ~abroad) | _any("exempt", title_only=True)
    by_outlet = reduce(lambda c, kv: F.when(outlet == kv[0], kv[1]).otherwise(c), config["publishers"].items(), F.lit(""))
    elsewhere = F.when(linked, "").when(abroad, F.when(_any("neighbours"), "near").otherwise("world")).otherwise(by_outlet)
    d = d.withColumns({"elsewhere": elsewhere, "_all": _scores("subjects")})
    moving = F.filter("_all", lambda s: s["name"].isin(*config["moves"]))
    d = d.withColumn("_moved", F.when(F.col("elsewhere") != "", F.round(F.aggregate(moving, F.lit(0.0), lambda a, s: a + s["score"]), 4)).otherwise(0.0))
    to = config["moved_to"]
    there = F.filter("_all", lambda s: s["name"] == to)
    lifted = F.struct(F.lit(to).alias("name"), F.round(F.coalesce(F.get(there, F.lit(0))["score"], F.lit(0.0)) + F.col("_moved"), 4).alias("score"))
    after = F.concat(F.filter("_all", lambda s: ~s["name"].isin(*config["moves"], to)), F.when(F.col("_moved") != 0, F.array(lifted)).otherwise(there))
    d = d.withColumn("_ranked", _best_first(F.when(F.col("elsewhere") != "", after).otherwise(F.col("_all"))))
    countries = F.size(F.array_distinct(F.transform(_of("foreign"), lambda h: h["bucket"])))
    local = (F.col("elsewhere") != "") & (countries < 2) & ~_any("wide") & ((F.col("elsewhere") == "world") | (F.col("_moved") != 0))
    low, blocked = _among(outlet, config["low_value"]["names"]), _among(outlet, config["blocked"])
    script = F.length(F.regexp_replace(title, OTHER_SCRIPT.replace("[", "[^", 1), "")) >= OTHER_LETTERS
    noise = _points(_of("noise"))
    for pattern, weight in config["noise_patterns"]:
        noise = noise + F.when(title.rlike("(?i)" + pattern), float(weight)).otherwise(0.0)
    bare = (outlet != "") & (F.lower(F.trim(title)) == outlet)
    noise = noise + F.when(low, config["low_value"]["penalty"]).otherwise(0.0) + F.when(bare, config["bare_name"]).otherwise(0.0)
    noise = F.round(noise + (F.when(blocked, 1).otherwise(0) + F.when(script, 1).otherwise(0)) * F.lit(config["blocked_noise"]), 4)
    at_home = _any("home") | _any("links")
    groups = F.array_distinct(F.transform(_of("watch"), lambda h: h["bucket"]))
    areas = [F.when(F.size(F.array_intersect(groups, F.array(*(F.lit(watch_bucket(name, k)) for k in range(len(a["groups"])))))) == len(a["groups"]), F.when(F.lit(a["regional"]) | at_home, name)) for name, a in sorted(config["watch"].items())]
    d = d.withColumns({
        "subjects": F.transform(F.slice(F.filter("_ranked", lambda s: s["score"] >= config["threshold"]), 1, config["most"]), lambda s: s["name"]),
        "best": F.coalesce(F.get("_ranked", F.lit(0))["score"], F.lit(0.0)), "local": local, "signal": _points(_of("signals")), "noise": noise, "watch": F.array_compact(F.array(*areas)),
    })
    home = at_home | (F.size("watch") > 0) | _any("exempt")
    rejected = F.when(script, SCRIPT).when(blocked, BLOCKED).when(F.col("noise") >= config["reject_noise"], NOISY)
    curated, news = _among(F.col("tier"), config["curated_tiers"]), F.coalesce(F.col("kind") == "news", F.lit(False))
    d = d.withColumns({"rejected": F.coalesce(rejected, F.when(F.col("local") & ~curated, LOCAL), F.lit("")), "score": _score(config, curated, news, home)})
    return d.withColumn("grade", base.grade(F.col("score"))).drop("_all", "_moved", "_ranked", "best")


def _score(config: dict[str, Any], curated: Column, news: Column, home: Column) -> Column:
    off, floor = config["penalties"], F.lit(config["reject_score"])
    weight = reduce(lambda c, kv: F.when(F.col("tier") == kv[0], kv[1]).otherwise(c), base.TIER_WEIGHT.items(), F.lit(1.0))
    subject = F.when(F.size("subjects") > 0, F.least(F.col("best") / 4.0, F.lit(2.0))).otherwise(-config["no_subject"])
    s = weight + F.least("signal", F.lit(4.0)) + subject - F.col("noise")
    away = F.when(F.col("elsewhere") == "near", off["near"]).otherwise(off["world"])
    s = (
        F.when(F.col("local") & ~curated, F.least(s - off["local"], floor))
        .when((F.col("elsewhere") != "") & news & ~curated, s - away)
        .when(~home & news & _among(F.col("tier"), config["home_tiers"]), s - off["home"])
        .otherwise(s)
    )
    return F.round(F.when((F.col("noise") >= config["reject_noise"]) | (F.size("subjects") == 0), F.least(s, floor)).otherwise(s), 4)


def topics(items: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(id, topic, score, rank) of items (id, title, body, subjects): title terms twice, terms of the body that the title has not once, and more where a subject fits."""
    return _ranked_topics(_hits(items, terms.matched_sets(items, _topic_set(config))), config)


def _ranked_topics(d: DataFrame, config: dict[str, Any]) -> DataFrame:
    own, limits = config["topics"], config["topic"]
    d = d.select("id", "subjects", _of("topics").alias("_found")).where("size(_found) > 0")
    # a term counts where it weighs most
    same = lambda t: F.filter("_found", lambda h: (h["bucket"] == t["bucket"]) & (h["term"] == t["term"]))
    most = lambda t, c: F.array_max(F.transform(same(t), lambda h: h[c]))
    once = F.array_distinct(F.transform("_found", lambda h: F.struct(h["bucket"].alias("bucket"), h["term"].alias("term"))))
    d = d.withColumn("_once", F.transform(once, lambda t: F.struct(t["bucket"].alias("bucket"), most(t, "factor").alias("factor"), most(t, "weight").alias("weight"))))
    of = lambda b: F.filter("_once", lambda t: t["bucket"] == b)
    score = lambda b: F.aggregate(of(b), F.lit(0.0), lambda a, t: a + t["weight"] * t["factor"])
    buckets = F.array_distinct(F.transform("_once", lambda t: t["bucket"]))
    s = d.select("id", "subjects", F.inline(F.transform(buckets, lambda b: F.struct(b.alias("bucket"), score(b).alias("score"), F.exists(of(b), lambda t: t["weight"] >= limits["strong"]).alias("strong"), F.size(of(b)).alias("terms")))))
    fits = reduce(lambda c, kv: F.when(F.col("bucket") == kv[0], F.arrays_overlap("subjects", F.array(*map(F.lit, kv[1]["subj"])))).otherwise(c), own.items(), F.lit(False))
    s = s.withColumn("score", F.round(F.col("score") + F.when(fits, limits["bonus"]).otherwise(0.0), 4)).where((F.col("score") >= limits["least"]) & (F.col("strong") | (F.col("terms") >= 2)))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "bucket")
    s = s.withColumns({"rank": F.row_number().over(w), "top": F.max("score").over(Window.partitionBy("id"))})
    return s.where((F.col("rank") <= limits["most"]) & (F.col("score") >= F.col("top") * limits["second"])).select("id", F.col("bucket").alias("topic"), "score", "rank")
