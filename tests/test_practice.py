"""Practice questions against plain Python that makes them story by story, and what must hold for any of them."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import practice
from quillstream.plans import practice_queries as pq
from quillstream.sources.tables import items, read

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TWO, THREE = ["1 only", "2 only", "Both 1 and 2", "Neither 1 nor 2"], ["Only one", "Only two", "All three", "None"]


def h(*parts):
    return int(hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def near(raw):
    one = "." in raw
    units = int(raw.replace(".", ""))
    half_up = lambda x: int(x + 0.5)
    moved = [units + k for k in (-3, -1, 2, 4)] if not one and re.fullmatch("(19|20)[0-9]{2}", raw) else [half_up(units * k) for k in (0.5, 0.75, 1.3, 1.6)]
    return list(dict.fromkeys(f"{v // 10}.{v % 10}" if one else str(v) for v in moved))


def made(stories, sentences, kinds, relation, per_story=2, per_day=60):
    """(day, place) -> (story, type, stem, options, answer)."""
    order = list(dict.fromkeys(kinds.values()))
    cut = {s: [re.findall("[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+|[^A-Za-z0-9]+", x) for x in xs[:8]] for s, xs in sentences.items()}
    kind_of = lambda w: next((k for e, k in reversed(kinds.items()) if w.endswith(e)), None)
    df = defaultdict(Counter)
    for s, ps in cut.items():
        for w in {x.lower() for p in ps for x in p if re.fullmatch("[a-z]{5,}", x.lower())}:
            df[stories[s]["week"]][w] += 1
    pools = defaultdict(dict)
    for week, c in df.items():
        for kind in order:
            own = sorted(((-n, w) for w, n in c.items() if n >= 2 and kind_of(w) == kind))[:40]
            if own:
                pools[week][kind] = sorted(w for _, w in own)
    out, relations = defaultdict(list), defaultdict(dict)
    for s in sorted(cut):
        ps, st = cut[s], stories[s]
        whole = " ".join(x for x in (st["title"], st["text"]) if x is not None)
        swaps = defaultdict(list)  # place -> (order of kind, at, old, decoys, times)
        for place, p in enumerate(ps):
            names = []
            for at, x in enumerate(p):
                w = x.lower()
                kind = next((k for k in order if w in pools[st["week"]].get(k, [])), None)
                if kind is not None and re.fullmatch("[a-z]{5,}", w):
                    swaps[place].append((order.index(kind), at, w, [d for d in pools[st["week"]][kind] if d != w and d not in whole.lower()], [y.lower() for y in p].count(w)))
                    names.append((kind, w, at))
                if re.fullmatch(r"[1-9][0-9]{1,8}|[0-9]{1,8}\.[0-9]", x) and x not in (st["title"] or ""):
                    before, after = p[at - 1] if at else "", p[at + 1] if at + 1 < len(p) else ""
                    if not re.search("[A-Za-z-]$", before) and not re.search("^[A-Za-z-]", after):
                        swaps[place].append((99, at, x, [d for d in near(x) if d != x and d not in whole], p.count(x)))
            both = [x for x in names if x[0] in relation]
            for a, b in zip(both, both[1:], strict=False):
                if (a[0], b[0]) == relation:
                    relations[st["week"]].setdefault(a[1], (b[1], s))
        text = lambda p, at, by: "".join(p[:at] + [by] + p[at + 1 :])
        mine = []
        if len(ps) >= 2:
            seed = h(s, "statements")
            n = 3 if len(ps) >= 3 and seed % 3 == 0 else 2
            lines, holds = [], []
            for i in range(n):
                own = sorted(x for x in swaps[i] if x[3])
                if own and not seed >> (i + 2) & 1:
                    _, at, _, decoys, _ = own[0]
                    lines.append(text(ps[i], at, decoys[(seed + i) % len(decoys)]))
                    holds.append(False)
                else:
                    lines.append("".join(ps[i]))
                    holds.append(True)
            k = sum(holds)
            mine.append(("statements", lines, TWO if n == 2 else THREE, (2 if k == 2 else 3 if not k else 0 if holds[0] else 1) if n == 2 else (k - 1) % 4))
        for kind, pick in (("blank", lambda x: x[0] < 99 and x[4] == 1), ("figure", lambda x: x[0] == 99)):
            found = next(((i, x) for i in range(len(ps)) for x in sorted(swaps[i]) if pick(x) and len(x[3]) >= 3), None)
            if found:
                i, (_, at, old, decoys, _) = found
                seed = h(s, kind, old)
                three = decoys[:3]
                if kind == "blank":
                    drawn = [decoys[(seed + 7 * k) % len(decoys)] for k in range(3)]
                    three = drawn if len(set(drawn)) == 3 else three
                options = three[:]
                options.insert(seed % 4, old)
                mine.append((kind, [text(ps[i], at, "______")], options, seed % 4))
        out[st["day"]] += [(s, *q) for q in mine if len(set(q[2])) == 4][:per_story] if len(mine) <= per_story else [(s, *q) for q in mine[:per_story] if len(set(q[2])) == 4]
    for week, rel in relations.items():
        names = sorted(rel, key=lambda n: (-h(week, "pairs", n), n))[:3]
        if len(names) < 3:
            continue
        truth = [rel[n][0] for n in names]
        others = [d for d in pools[week][relation[1]] if d not in truth]
        if len(others) < 3:
            continue
        seed = h(week, "pairs", "|".join(names))
        shown = [others[(seed + i) % len(others)] if i < seed % 4 else x for i, x in enumerate(truth)]
        k = sum(a == b for a, b in zip(shown, truth, strict=True))
        s = rel[names[0]][1]
        out[stories[s]["day"]].insert(0, (s, "pairs", [f"{a} - {b}" for a, b in zip(names, shown, strict=True)], THREE, (k - 1) % 4))
    return {(day, k): q for day, qs in out.items() for k, q in enumerate(qs[:per_day], 1)}


def checked(spark, stories, sentences, kinds, relation):
    d = spark.createDataFrame([(s, x["day"], x["week"], x["title"], x["text"]) for s, x in stories.items()], "story long, day long, week long, title string, text string")
    f = spark.createDataFrame([(s, k, x) for s, xs in sentences.items() for k, x in enumerate(xs)], "story long, place int, text string")
    got = {(r.day, r.place): (r.story, r.type, r.stem, r.options, r.answer) for r in practice.questions(d, f, kinds, relation=relation).collect()}
    assert got == made(stories, sentences, kinds, relation)
    return got


def test_questions_of_a_small_week(spark):
    kinds = {"er": "person", "ton": "place"}
    names = ["baker", "miller", "weaver", "tanner", "carter", "cooper"], ["alton", "burton", "carlton", "dalton", "elton", "felton", "gorton", "halton"]
    stories, sentences = {}, {}
    for k in range(48):
        xs = [f"The {names[0][k % 6]} went to {names[1][k % 8]} with 1{k} sacks.", f"In 19{k + 40} only {k}.5 of them, said {names[0][(k + 1) % 6].title()}, were left.", f"Su-30 and {names[1][(k + 2) % 8]} again {k}"][: 1 + k % 3]
        stories[k] = {"day": k % 2, "week": k // 24, "title": f"Report {k} of 12" if k % 5 else None, "text": " ".join(xs)}
        sentences[k] = xs
    stories[90], sentences[90] = {"day": 1, "week": 0, "title": None, "text": None}, []
    got = checked(spark, stories, sentences, kinds, ("person", "place"))
    assert {q[1] for q in got.values()} == {"statements", "blank", "figure", "pairs"}
    for s, kind, stem, options, answer in got.values():
        whole = f"{stories[s]['title'] or ''} {stories[s]['text']}".lower()
        if kind in ("blank", "figure"):  # only the answer is in the source
            assert [o.lower() in whole for o in options] == [k == answer for k in range(4)]
            assert stem[0].replace("______", options[answer]).lower() in whole
        if kind == "statements":
            true = [x.lower() in whole for x in stem]
            assert answer == ((2 if all(true) else 3 if not any(true) else 0 if true[0] else 1) if len(stem) == 2 else (sum(true) - 1) % 4)


def test_texts_are_not_shuffled(spark):
    rng = random.Random(3)
    names = ["baker", "miller", "weaver", "tanner", "carter", "cooper"]
    sentences = {k: [f"The {names[k % 6]} and the {names[(k + 1) % 6]} had {k}.5 sacks."] for k in range(40)}
    stories = {k: {"day": 0, "week": 0, "title": None, "text": xs[0] + "".join(rng.choices("bcdfgh jklmnpqrstvwxz", k=20000))} for k, xs in sentences.items()}
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        bus.waitUntilEmpty()
        found = store.executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = shuffled()
    assert checked(spark, stories, sentences, {"er": "person"}, ("person", "person"))
    assert shuffled() - before < 40 * 20000 / 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_practice_questions_of_the_tables(spark):
    i = items(spark, DATA)
    stories = {r.id: {"day": r.day, "week": r.day // 7, "title": r.title, "text": r.body} for r in i.collect()}
    sentences = defaultdict(list)
    for r in i.select("id", F.posexplode(t.sentences(F.concat_ws(" ", "title", "body"), 40)).alias("k", "x")).orderBy("id", "k").collect():
        sentences[r.id].append(r.x)
    expected = made(stories, sentences, pq.KINDS, pq.RELATION)
    got = {(r.day, r.place): (r.story, r.type, r.stem.split("\n"), r.options.split("|"), r.answer) for r in pq.practice_questions(spark, DATA).collect()}
    assert got == {k: (q[0], q[1], "\n".join(q[2]).split("\n"), *q[3:]) for k, q in expected.items()}


def sets(rows, seen, n):
    """The sequential picker: fresh before seen, three passes each."""
    quota = {"pairs": 0.08, "statements": 0.5, "blank": 0.25, "figure": 0.17}
    out = []
    for wanted in (False, True):
        for level in (0, 1, 2):
            for q in rows:
                if (q[0] in seen) != wanted or q in out or len(out) >= n:
                    continue
                mine, same = [x for x in out if x[1] == q[1]], [x for x in out if x[2] == q[2]]
                over = len(same) >= max(1, int(quota.get(q[2], 0.2) * n + 0.5))
                if q[2] == "pairs" and same or level == 0 and (mine or over) or level == 1 and mine and over:
                    continue
                out.append(q)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_practice_sets(spark):
    known = {r.doc_id for r in read(spark, DATA, "labels").collect()}
    days = defaultdict(list)
    for r in sorted(pq.pool(spark, DATA).collect(), key=lambda r: r.place):
        days[r.day].append((r.id, r.story, r.type))
    got = defaultdict(dict)
    for r in pq.practice_sets(spark, DATA).collect():
        got[r.day][r["rank"]] = r.id
    for day, rows in days.items():
        expected = sets(rows, {q[0] for q in rows if q[1] in known}, pq.SET_SIZE)
        assert [got[day][k] for k in sorted(got[day])] == [q[0] for q in expected]
