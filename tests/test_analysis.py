"""The analysis of items against a plain reading of the rules, by regex alternation and loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.operators import analysis, terms
from quillstream.plans.analysis_queries import CONFIG
from quillstream.sources import rule_files

SCHEMA = "id long, title string, body string, publisher string, tier string, kind string"
WORDS = "the of and that la der des die Le un los Is que war por this with in en from thion erat les de is it be not as by for A a Ther to on und mit nicht xx The thes | 12 it-is".split()


class Finder:
    """Distinct terms of one set in a text: whole words, longest first, plurals; one regex for cased terms and one for the others."""

    def __init__(self, names):
        names = {terms.normal(n) for n in names}
        self.cased = {n for n in names if " " not in n and any(c.isupper() for c in n)}
        self.plain = {n.lower() for n in names - self.cased}

    def _regex(self, names, flags):
        alts = []
        for n in sorted(names, key=lambda x: (-len(x), x)):
            plural = "(?:s|es)?" if n[-1].isalpha() and n.islower() else "s?" if n[-1].isalpha() and not flags else ""
            alts.append(re.escape(n).replace(r"\ ", r"[\s\-]+") + plural)
        return re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(alts) + r")(?![A-Za-z0-9])", flags)

    def find(self, text):
        out = set()
        for names, flags in ((self.cased, 0), (self.plain, re.I)):
            if names and text:
                for m in self._regex(names, flags).finditer(text):
                    key = terms.normal(m.group(0))
                    key = key if not flags else key.lower()
                    out.add(next(k for k in (key, key.removesuffix("es"), key.removesuffix("s")) if k in names))
        return out


def plain(item, c):
    _, title, body, publisher, tier, kind = item
    title, body, outlet = title or "", body or "", (publisher or "").strip().lower()
    find = lambda names, text: Finder(names).find(text)
    both = lambda names: find(names, title) | find(names, body)
    scores = {}
    for subject, entry in c["subjects"].items():
        every = [t for s in c["subjects"].values() for t in s["kw"]]
        s = sum(entry["kw"].get(t, 0) * 2 for t in find(every, title)) + sum(entry["kw"].get(t, 0) for t in find(every, body))
        if s:
            scores[subject] = round(s, 4)
    abroad, links = find(c["foreign"], title), both(c["links"])
    if abroad and links <= set(c["ambiguous"]):
        links = set()
    spared = find(c["exempt"], title)
    elsewhere, local = "", False
    if not links and not spared:
        elsewhere = ("near" if find(c["neighbours"], title) else "world") if abroad else c["publishers"].get(outlet, "")
    if elsewhere:
        moved = round(sum(scores.pop(s) for s in c["moves"] if s in scores), 4)
        if moved:
            scores[c["moved_to"]] = round(scores.get(c["moved_to"], 0) + moved, 4)
        countries = {c["foreign"][t] for t in abroad}
        local = len(countries) < 2 and not find(c["wide"], title) and not find(c["wide"], body[:300]) and (elsewhere == "world" or moved != 0)
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    subjects = [s for s, v in ranked if v >= c["threshold"]][: c["most"]]
    signal = round(sum(c["signals"][t] for t in find(c["signals"], title)) + 0.5 * sum(c["signals"][t] for t in find(c["signals"], body)), 4)
    noise = sum(c["noise"][t] for t in find(c["noise"], title)) + 0.3 * sum(c["noise"][t] for t in find(c["noise"], body[:400]))
    noise += sum(w for p, w in c["noise_patterns"] if re.search(p, title, re.I))
    noise += c["low_value"]["penalty"] if outlet in c["low_value"]["names"] else 0
    noise += c["bare_name"] if outlet and title.strip().lower() == outlet else 0
    script = sum(any(lo <= ord(x) <= hi for lo, hi in ((0x980, 0xDFF), (0x590, 0x6FF), (0xE00, 0xE7F), (0x3040, 0x9FFF), (0xAC00, 0xD7AF))) for x in title) >= 3
    blocked = outlet in c["blocked"]
    noise = round(noise + c["blocked_noise"] * (script + blocked), 4)
    at_home = bool(both(c["home"]) or both(c["links"]))
    watched = lambda a: all(both([t for g in c["watch"].values() for gr in g["groups"] for t in gr]) & set(group) for group in a["groups"])
    watch = sorted(n for n, a in c["watch"].items() if watched(a) and (a["regional"] or at_home))
    curated = tier in c["curated_tiers"]
    rejected = "other script" if script else "blocked outlet" if blocked else "noise" if noise >= c["reject_noise"] else "foreign local" if local and not curated else ""
    weight = {"official": 2.0, "premium": 1.5, "quality": 1.2, "general": 1.0}.get(tier, 1.0)
    s = weight + min(signal, 4) + (min(ranked[0][1] / 4, 2) if subjects else -c["no_subject"]) - noise
    off = c["penalties"]
    if local and not curated:
        s = min(s - off["local"], c["reject_score"])
    elif elsewhere and kind == "news" and not curated:
        s -= off[elsewhere]
    elif not (at_home or watch or both(c["exempt"])) and tier in c["home_tiers"] and kind == "news":
        s -= off["home"]
    if noise >= c["reject_noise"] or not subjects:
        s = min(s, c["reject_score"])
    return subjects, elsewhere, local, signal, noise, watch, rejected, s


def made(n, seed):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choices(WORDS, k=r.randint(0, k)))
    rows = [(i, text(7), text(14) if i % 3 else text(120), f"src{r.randint(1, 20)}", r.choice(["official", "premium", "quality", "general", "x"]), r.choice(["news", "news", "explained"])) for i in range(n)]
    odd = [(None, None, None, None, None), ("", "", "", "", ""), ("src5", "", "src5", "general", "news"), ("กกก x", "the", "src1", "general", "news"), ("一丁 the", None, None, "quality", "news"), ("the\nof", "in\tthe", " SRC19 ", "premium", None)]
    return rows + [(n + k, *x) for k, x in enumerate(odd)]


def test_analysis_equals_a_plain_reading(spark):
    rows = made(500, 7)
    got = {r.id: r for r in analysis.analysed(spark.createDataFrame(rows, SCHEMA), CONFIG).collect()}
    assert len(got) == len(rows)
    seen = set()
    for row in rows:
        want, r = plain(row, CONFIG), got[row[0]]
        assert (r.subjects, r.elsewhere, r.local, r.signal, r.noise, r.watch, r.rejected) == (want[0], want[1], want[2], pytest.approx(want[3]), pytest.approx(want[4]), want[5], want[6]), row
        assert r.score == pytest.approx(want[7], abs=1e-3), row
        seen |= {("elsewhere", r.elsewhere), ("rejected", r.rejected), ("local", r.local), *(("watch", w) for w in r.watch)}
    assert seen >= {("elsewhere", x) for x in ("", "near", "world")} | {("rejected", x) for x in ("", "other script", "blocked outlet", "noise", "foreign local")} | {("local", True), ("watch", "coast"), ("watch", "border")}


def test_topics_equal_a_plain_reading(spark):
    rows = [(*x[:3], random.Random(x[0]).sample(sorted(CONFIG["subjects"]), 2)) for x in made(300, 11)]
    d = spark.createDataFrame(rows, "id long, title string, body string, subjects array<string>")
    got = {}
    for r in analysis.topics(d, CONFIG).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.topic, r.score)
    own, limits = CONFIG["topics"], CONFIG["topic"]
    finder = Finder([t for x in own.values() for t in x["kw"]])
    for id_, title, body, subjects in rows:
        head = finder.find(title)
        found = [(t, 2) for t in head] + [(t, 1) for t in finder.find(body) - head]
        best = []
        for name, topic in own.items():
            mine = [(topic["kw"][t], k) for t, k in found if t in topic["kw"]]
            s = round(sum(w * k for w, k in mine) + (limits["bonus"] if mine and set(subjects) & set(topic["subj"]) else 0), 4)
            if s >= limits["least"] and (len(mine) >= 2 or any(w >= limits["strong"] for w, _ in mine)):
                best.append((-s, name))
        best = sorted(best)[: limits["most"]]
        want = {k + 1: (name, -s) for k, (s, name) in enumerate(best) if s <= best[0][0] * limits["second"]}
        assert {k: (n, pytest.approx(s)) for k, (n, s) in want.items()} == got.get(id_, {}), (title, body)


def test_analysis_of_an_empty_table_and_without_rules(spark):
    assert analysis.analysed(spark.createDataFrame([], SCHEMA), CONFIG).count() == 0
    assert terms.matched_sets(spark.createDataFrame([(1, "a")], "id long, x string"), {"a": ([], {"x": 1.0})}).count() == 0


def test_terms_of_one_set_do_not_hide_those_of_another(spark):
    d = spark.createDataFrame([(1, "of the law of the land", "the law")], "id long, x string, y string")
    got = {(r.set, r.field, r.term, r.factor) for r in terms.matched_sets(d, {"a": ([("", "of the", 1.0)], {"x": 1.0}), "b": ([("", "the law", 1.0), ("", "law", 1.0)], {"x": 2.0, "y": 0.5})}).collect()}
    assert got == {("a", "x", "of the", 1.0), ("b", "x", "the law", 2.0), ("b", "y", "the law", 0.5)}


def test_texts_are_read_once(spark, tmp_path):
    at = str(tmp_path / "items")
    spark.createDataFrame([(1, "A law", "of the sea", "x", "official", "news")], "id long, title string, body string, publisher string, tier string, kind string").write.parquet(at)
    i = spark.read.parquet(at)
    # once to match all fields, once to bring the matches to their items
    reads = lambda d: d._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert reads(analysis.analysed(i, CONFIG)) == 2
    assert reads(analysis.analysed_topics(i, CONFIG)) == 2


def test_topics_are_those_of_two_passes(spark):
    words = sorted({t for name in ("topics", "subjects") for _, t, _ in rule_files.bucket_rules(CONFIG[name])})
    rows = [(k, " ".join(words[k % 7 :: 29]), " and ".join(words[k :: 11]), None, "official", "news") for k in range(30)]
    i = spark.createDataFrame(rows, "id long, title string, body string, publisher string, tier string, kind string")
    d = i.select("id", "title", "body").join(analysis.analysed(i, CONFIG).select("id", "subjects"), "id")
    got = sorted(map(tuple, analysis.analysed_topics(i, CONFIG).collect()))
    assert got and got == sorted(map(tuple, analysis.topics(d, CONFIG).collect()))


def test_pieces_of_odd_texts(spark):
    texts = ["a😀b 😀😀.x", "x😀", "😀", " ", "..", "é-ü a--b\n\nc", "u.s. economy.", "\u0085a9 ", "İstanbul'da"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", terms.pieces(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in got} == {x: re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]", re.sub(r"[ \t\n\x0b\f\r\-]+", " ", x)) for x in texts}
