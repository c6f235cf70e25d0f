"""The focus: choice among conflicts, a day's parts, and the shares of the minutes, each against plain Python that walks piece by piece."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.operators import focus


def walk(order, groups):
    """(chosen, left out -> first chosen one it conflicts with)."""
    out, under = [], {}
    for x in order:
        twin = next((o for o in out if groups.get(x, set()) & groups.get(o, set())), None)
        if twin is None:
            out.append(x)
        else:
            under[x] = twin
    return out, under


@pytest.mark.parametrize("seed", [1, 2])
def test_chosen_is_what_a_walk_chooses(spark, seed):
    rng = random.Random(seed)
    pieces = [(i, rng.randint(0, 9) / 2) for i in range(120)]
    groups = [(i, f"p{min(i, j)}-{max(i, j)}") for a in range(90) for i, j in [rng.sample(range(120), 2)] for i in (i, j)] if seed == 1 else [(i, i // 2) for i in range(119)] + [(i, (i + 1) // 2 + 1000) for i in range(120)]
    groups += [(i, "topic") for i in range(0, 120, 7)] + [(999, "topic"), (5, None)]
    of = defaultdict(set)
    for i, g in groups:
        if g is not None:
            of[i].add(str(g))
    expected, under = walk([i for i, v in sorted(pieces, key=lambda p: (-p[1], p[0]))], of)
    p = spark.createDataFrame([*pieces, pieces[0]], "id long, value double")
    g = spark.createDataFrame([(i, None if g is None else str(g)) for i, g in groups], "id long, group string")
    order = [-F.col("value")]
    got = focus.chosen(p, g, order)
    assert sorted(r.id for r in got.collect()) == sorted(expected)
    kept, out = p.dropDuplicates(["id"]).join(got, "id", "left_semi"), p.dropDuplicates(["id"]).join(got, "id", "left_anti")
    assert {r.id: r.under for r in focus.under(out, kept, g, order).collect()} == under
    assert not focus.chosen(p.limit(0), g, order).collect()


def fit(rows, budget):
    """One day's pieces by part, as a reader's app takes them."""
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r["value"], r["id"])):
        own[r["part"]].append(r)

    def take(part, cap, least=0):
        out, t = [], 0
        for r in own[part]:
            if len(out) >= least and t + r["minutes"] > cap:
                break
            out.append(r)
            t += r["minutes"]
        return out, t

    half_up = lambda x: int(x + 0.5)
    cards, spent = take("card", budget * 0.5, 3)
    over = [r for r in own["card"][len(cards) :] if r["is_must"]]
    lines = over + own["line"][: max(0, half_up(budget * 0.15 / 0.5) - len(over))]
    facts = own["fact"][: half_up(budget * 0.15 / 0.5)]
    left = budget - spent - 0.5 * (len(lines) + len(facts))
    eds, read = take("ed", left - (5 if budget >= 90 else 0), 1)
    bg = take("bg", left - read)[0] if budget >= 90 else []
    return {(r["id"], part, k) for part, found in (("card", cards), ("line", lines), ("fact", facts), ("ed", eds), ("bg", bg)) for k, r in enumerate(found, 1)}


def test_shares_of_the_minutes(spark):
    rng = random.Random(4)
    rows = []
    for day in range(12):
        for _ in range(rng.choice([0, 3, 25, 120])):
            part = rng.choice(["card", "card", "line", "fact", "ed", "bg"])
            rows.append({"day": day, "id": len(rows), "part": part, "value": rng.randint(0, 16) / 2, "minutes": rng.randint(3, 8), "budget": 0})
    rows += [{"day": 50, "id": 9000 + k, "part": "card", "value": 8.0, "minutes": 5, "budget": 0} for k in range(60)]  # more must-knows than places
    for r in rows:
        r["is_must"] = r["value"] >= 5
    d = spark.createDataFrame(rows, "day long, id long, part string, value double, minutes int, is_must boolean, budget int").withColumn("budget", F.explode(F.array(*map(F.lit, (30, 60, 90)))))
    got = defaultdict(set)
    for r in focus.fitted(d, ["day"], "budget", [-F.col("value"), F.col("id")]).collect():
        got[r.day, r.budget].add((r.id, r.part, r.place))
    for day in {r["day"] for r in rows}:
        for budget in (30, 60, 90):
            own = [r for r in rows if r["day"] == day]
            assert got[day, budget] == fit(own, budget)
            must = {r["id"] for r in own if r["part"] == "card" and r["is_must"]}
            assert must <= {i for i, _, _ in got[day, budget]}  # none is dropped


def parted(picks, near, topics):
    """(id, part, under) of one day."""
    best = lambda ids: sorted(ids, key=lambda i: (-picks[i][1], i))
    like = lambda a, b: near.get(frozenset((a, b)), 0.0)
    cards = best(i for i, p in picks.items() if p[0] == "news")
    out = {i: ("card", None) for i in cards}
    for i in picks:
        if i in out:
            continue
        top, most = None, 0.0
        for c in cards:
            s = max(like(i, c), 0.15 if topics[i] & topics[c] else 0.0)
            if s > most:
                top, most = c, s
        if top is not None and most >= 0.15:
            out[i] = ("attached", top)
    lines, facts = [], []
    for i in best(i for i, p in picks.items() if p[0] in ("prelims", "more") and i not in out and p[1] >= 3.0):
        twin = next((f for f in lines + facts if like(i, f) >= 0.25), None)
        out[i] = ("twin", twin) if twin is not None else ("fact" if picks[i][0] == "prelims" else "line", None)
        if twin is None:
            (facts if picks[i][0] == "prelims" else lines).append(i)
    for part, section in (("ed", "editorials"), ("bg", "explained")):
        kept = []
        for i in best(i for i, p in picks.items() if p[0] == section and i not in out and p[1] >= 3.4):
            twin = next((o for o in kept if like(i, o) >= 0.25 or topics[i] & topics[o]), None)
            out[i] = ("twin", twin) if twin is not None else (part, None)
            if twin is None:
                kept.append(i)
    return {(i, *v) for i, v in out.items()}


def test_parts_of_days(spark):
    rng = random.Random(9)
    picks, near, topics = {}, {}, defaultdict(set)
    for i in range(150):
        picks[i] = (i // 75, rng.choice(["news", "prelims", "more", "editorials", "explained", "more", "editorials"]), rng.randint(4, 14) / 2)
    for _ in range(170):
        a, b = rng.sample(range(75), 2)
        a, b = (a, b) if rng.random() < 0.5 else (a + 75, b + 75)
        near[frozenset((a, b))] = rng.choice([0.1, 0.2, 0.25, 0.4, 1.0])
    for i in picks:
        for t in rng.sample(range(60), rng.choice([0, 0, 1, 2])):
            topics[i].add(t)
    expected = set()
    for day in (0, 1):
        expected |= parted({i: p[1:] for i, p in picks.items() if p[0] == day}, near, topics)
    d = spark.createDataFrame([(i, *p) for i, p in picks.items()], "id long, day long, section string, value double")
    pairs = spark.createDataFrame([(*sorted(k), s) for k, s in near.items()], "a long, b long, similarity double")
    t = spark.createDataFrame([(i, str(x)) for i, xs in topics.items() for x in xs], "id long, topic string")
    got = {(r.id, r.part, r.under) for r in focus.sections(d, pairs, t).collect()}
    assert got == expected
    assert {p for _, p, _ in got} == {"card", "attached", "line", "fact", "ed", "bg", "twin"}


DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_fit_is_of_the_sections(spark):
    from quillstream.plans import focus_queries

    rows = focus_queries.day_sections(spark, DATA).collect()
    days = defaultdict(list)
    for r in rows:
        if r.part in ("card", "line", "fact", "ed", "bg"):
            days[r.day].append({"id": r.id, "part": r.part, "value": r.value, "minutes": r.minutes, "is_must": r.value >= 5})
    got = defaultdict(set)
    for r in focus_queries.focus_fit(spark, DATA).collect():
        got[r.day, r.budget].add((r.id, r.part, r.place))
    assert got == {(day, b): f for day, own in days.items() for b in (30, 60, 90) if (f := fit(own, b))}
