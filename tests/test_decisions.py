"""The queries that SQL can't express, on whole tables, against plain Python that decides row by row."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.operators import search
from quillstream.operators import similarity as sim
from quillstream.plans import catalog, digest_queries, window_queries
from quillstream.sources.tables import items, read, tokenised

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def run(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def greedy(order, near, members):
    """id -> lead: each joins the group whose first members it is most like, the older of equal ones, or founds one."""
    lead, groups = {}, {}
    for x in order:
        best, top = None, 0.0
        for g, own in groups.items():
            s = max(near.get(frozenset((x, m)), 0.0) for m in own[:members])
            if s > top:
                best, top = g, s
        lead[x] = x if best is None else best
        groups.setdefault(lead[x], []).append(x)
    return lead


def test_story_clusters(spark):
    rows = tokenised(spark, DATA).select("id", "kind", "day", "tokens").collect()
    near = {}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = set(a.tokens), set(b.tokens)
            if a.kind != b.kind or len(x) < 2 or len(y) < 2:
                continue
            shared = len(x & y)
            jaccard, contain = shared / len(x | y), shared / min(len(x), len(y))
            if x == y:
                near[frozenset((a.id, b.id))] = 2.0
            elif shared >= 3 and (jaccard >= 0.5 or (contain >= 0.75 and shared >= 4)):
                near[frozenset((a.id, b.id))] = jaccard + contain
    expected, groups, last = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.day, r.id)):
        best, top = r.id, 0.0
        for g, own in groups.items():
            s = max(near.get(frozenset((r.id, m)), 0.0) for m in own[:8])
            if s > top and last[g] >= r.day - 3:
                best, top = g, s
        expected[r.id] = best
        groups.setdefault(best, []).append(r.id)
        last[best] = r.day
    assert {r.id: r.story for r in run(spark, "story_clusters")} == expected
    assert len(set(expected.values())) < len(expected)


def test_story_cards_are_of_the_clusters(spark):
    of, members = {r.id: r.story for r in run(spark, "story_clusters")}, defaultdict(list)
    for r in items(spark, DATA).select("id", "publisher", "day", "tier", "body").collect():
        members[of[r.id]].append(r)
    tier = {"official": 7, "premium": 6, "quality": 5, "general": 3}
    got = {r.story: r for r in run(spark, "story_cards")}
    assert set(got) == set(members)
    for story, own in members.items():
        own.sort(key=lambda r: (-tier[r.tier], not (r.body or "").strip(" "), r.day, r.id))
        assert (got[story].lead, got[story].n_items) == (own[0].id, len(own))
        assert got[story].publishers == ",".join(dict.fromkeys(r.publisher for r in own if r.publisher is not None))
        assert got[story].days == ",".join(map(str, sorted({r.day for r in own})))


def test_daily_digest(spark):
    picks = {r.id: r for r in run(spark, "digest_tiers")}
    pairs = sim.rarity_pairs(tokenised(spark, DATA).select("id", "tokens")).where("similarity >= 0.25").collect()
    near = {frozenset((r.a, r.b)): r.similarity for r in pairs}
    days = defaultdict(list)
    for r in picks.values():
        days[r.day].append(r)
    expected = set()
    for day, own in days.items():
        lead = greedy([r.id for r in sorted(own, key=lambda r: (-r.bs, r.id))], near, 3)
        place = {"top": 1, "prelims": 2, "more": 3}
        key = lambda r: (r.id != lead[r.id], place[picks[lead[r.id]].tier], -picks[lead[r.id]].bs, lead[r.id], -r.bs, r.id)  # noqa: B023, E731
        for rank, r in enumerate(sorted(own, key=key), 1):
            folded = lead[r.id] != r.id
            expected.add((day, rank, r.id, picks[lead[r.id]].tier, lead[r.id] if folded else None))
    assert {(r.day, r["rank"], r.id, r.tier, r.lead) for r in run(spark, "daily_digest")} == expected


def test_focus_layout(spark):
    value = {r.id: r.value for r in digest_queries.focus_value(spark, DATA).collect()}
    picks = {r.id: r for r in run(spark, "digest_tiers")}
    pairs = sim.rarity_pairs(tokenised(spark, DATA).select("id", "tokens")).collect()
    near = {frozenset((r.a, r.b)): r.similarity for r in pairs if r.a in picks and r.b in picks and picks[r.a].day == picks[r.b].day}
    expected = set()
    for day in {r.day for r in picks.values()}:
        own = [r for r in picks.values() if r.day == day]
        cards = sorted(r.id for r in own if r.tier == "top")
        lines = []
        for r in sorted(own, key=lambda r: (-value[r.id], r.id)):
            like = {c: near.get(frozenset((r.id, c)), 0.0) for c in cards}
            best = min(cards, key=lambda c: (-like[c], c), default=None)  # noqa: B023
            if r.tier == "top":
                expected.add((day, r.id, "card", None))
            elif best is not None and like[best] >= 0.15:
                expected.add((day, r.id, "attached", best))
            elif value[r.id] >= 3.0:
                twin = next((x for x in lines if near.get(frozenset((r.id, x)), 0.0) >= 0.25), None)
                if twin is None:
                    lines.append(r.id)
                expected.add((day, r.id, "twin" if twin is not None else "fact" if r.tier == "prelims" else "line", twin))
    assert {(r.day, r.id, r.part, r.under) for r in run(spark, "focus_layout")} == expected


def test_focus_plan(spark):
    days = {r.id: r.day for r in items(spark, DATA).select("id", "day").collect()}
    of = defaultdict(list)
    for r in digest_queries.focus_value(spark, DATA).collect():
        of[days[r.id]].append((-r.value, r.id, r.minutes))
    expected = set()
    for day, rows in of.items():
        spent = 0
        for _, i, minutes in sorted(rows):
            if spent + minutes <= 30:
                spent += minutes
                expected.add((day, i))
    assert {(r.day, r.id) for r in run(spark, "focus_plan")} == expected


def test_srs_schedule(spark):
    e = read(spark, DATA, "events").select("user_id", "event_type", F.datediff("ts", F.lit("2024-01-01")).alias("day"), "event_id", "value").collect()
    of = defaultdict(list)
    for r in e:
        of[r.user_id, r.event_type].append((r.day, r.event_id, int(r.value // 25) % 4 + 1))
    expected = {}
    for key, reviews in of.items():
        ease, interval, due, lapses = 2.5, 0, 0, 0
        for day, _, grade in sorted(reviews):
            moved = {1: -0.2, 2: -0.15, 3: 0.0, 4: 0.15}[grade]
            if grade == 1:
                grown, lapses = 1, lapses + 1
                ease = max(1.3, ease + moved)
            else:
                grown = (4 if grade == 4 else 1) if not interval else max(1.0, interval * 1.2) if grade == 2 else interval * ease
                ease = max(1.3, ease + moved)
            interval = int(grown)
            due = day + interval
        expected[key] = (round(ease, 6), interval, due, lapses)
    assert {(r.user_id, r.card): (round(r.ease, 6), r.interval, r.due, r.lapses) for r in run(spark, "srs_schedule")} == expected


def test_cloze_questions(spark):
    names = ["from", "have", "that", "the", "this", "with"]
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    sentences = read(spark, DATA, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.posexplode(digest_queries.t.sentences(F.col("text"), 20)).alias("place", "text")).collect()
    of = defaultdict(list)
    for r in sentences:
        for name in set(re.split("[^a-z0-9]+", r.text.lower())) & set(names):
            of[r.id].append((sha(f"{r.id}|{r.place}|{name}"), r.place, name, r.text.lower()))
    expected = set()
    for i, found in of.items():
        for seed, place, name, text in sorted(found)[:2]:
            others = sorted((x for x in names if x != name), key=lambda x: sha(seed + x))[:3]  # noqa: B023
            options = sorted([*others, name], key=lambda x: sha(x + seed))  # noqa: B023
            question = re.sub(f"(^|[^a-z0-9]){name}([^a-z0-9]|$)", r"\1____\2", text)
            expected.add((i, place, question, tuple(options), name))
    assert {(r.id, r.place, r.question, tuple(r.options), r.answer) for r in run(spark, "cloze_questions")} == expected


def test_pruned_points(spark):
    p = window_queries._points(spark, DATA)
    score = {(r.id, r.place): round(r.score, 6) for r in search.ranked_sentences(p).collect()}
    of = defaultdict(list)
    for r in p.collect():
        if (r.id, r.place) in score:
            of[r.id].append((-score[r.id, r.place], r.place, set(r.words), r.text))
    expected = {}
    for i, rows in of.items():
        kept = []
        for _, _, words, text in sorted(rows, key=lambda x: x[:2]):
            if len(kept) < 3 and not any(len(words & w) >= 0.6 * min(len(words), len(w)) for w, _ in kept):
                kept.append((words, text))
        expected[i] = "\n".join(x for _, x in kept)
    assert {r.id: r.points for r in run(spark, "pruned_points")} == expected
