"""Operators on small tables: results against brute force, and what nulls, ties, repeats and empty tables give."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, jaccard, language, line_dedup, main_text, personal_data, pieces, quality, token_counts, url_filter
from quillstream.llm import components as cc
from quillstream.llm.queries import vocabulary
from quillstream.llm.shared import release, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
WORDS = "the of and thion erat onble stea hering whou inth reand edes tiat nder shou anent".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


def prose(rng, n, words=WORDS):
    out = []
    while n > 0:
        k = min(n, rng.randint(1, 14))
        s = [rng.choice(words) + rng.choice(["", "er", "on", "ti"]) for _ in range(k)]
        if k > 6:
            s[k // 2] += ","
        out.append(" ".join(s).capitalize() + rng.choice([". ", ". ", ".\n"]))
        n -= k
    return "".join(out).strip()


ODD = [(900, None, "en"), (901, "", "en"), (902, " \n\t ", None), (903, "one", "en"), (None, "two words", "en"), (904, "x " * 3000, "en")]


def test_repeated_rows_stay_in_several_blocks(spark):
    b = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(8)], "item_id long, text string")
    text = " ".join(f"w1x{j}" for j in range(20))
    d = spark.createDataFrame([(1, text, 5), (1, text, 6), (2, "other words", 7), (None, None, 8)], "doc_id long, text string, _bad_id int")
    results = []
    for block_bytes in (1 << 20, 100):
        results.append(sorted((str(r.doc_id), r.n_words, r.n_hit, r.longest, r.longest_start, r.longest_item) for r in decontaminate.matches(d, b, block_bytes=block_bytes).collect()))
        kept = decontaminate.decontaminate(d, b, block_bytes=block_bytes)
        assert kept.columns == d.columns and sorted(r["_bad_id"] for r in kept.collect()) == [7, 8]
    assert results[0] == results[1] == [("1", 20, 20, 20, 0, 1), ("1", 20, 20, 20, 0, 1), ("2", 2, 0, 0, None, None), ("None", 0, 0, 0, None, None)]


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(4)
    bench = [(k, prose(rng, rng.randint(5, 40))) for k in range(12)] + [(None, "the of and"), (50, None), (51, "!!"), (3, "Only Three Words")]
    rows = []
    for k in range(80):
        text = prose(rng, rng.randint(0, 120)) if k % 3 else ""
        if k % 2:
            item = bench[k % 12][1]
            text += " " + (item if k % 4 == 1 else " ".join(item.split()[: rng.randint(8, 20)])) + " " + prose(rng, rng.randint(0, 300))
        rows.append((k, text, "en"))
    rows += [*ODD, (60, "only three WORDS only, three words", "en")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in bench:
        w = split.findall((t or "").translate(LOWER))
        if i is not None and w:
            for p in range(max(1, len(w) - 12)):
                windows[tuple(w[p : p + 13])].add(i)
    expected = []
    for i, t, _ in rows:
        w, hit, items = split.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if found := windows.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    items |= found
        expected.append((i, len(w), len(hit), sorted(items)))
    key = lambda r: (r[0] is None, r)
    for block_bytes in (1 << 20, 300):
        got = decontaminate.matches(docs(spark, rows), b, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got), key=key) == sorted(expected, key=key)
        kept = decontaminate.decontaminate(docs(spark, rows), b, block_bytes=block_bytes)
        assert kept.columns == docs(spark, rows).columns
        assert {r.doc_id for r in kept.collect()} == {i for i, n, h, _ in expected if not (h and 20 * h >= n)}


def test_longest_match(spark):
    text = " ".join(f"w{k}" for k in range(40))
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    r = decontaminate.matches(docs(spark, [(1, "a b " + " ".join(f"w{k}" for k in range(5, 30)) + " z", "en")]), b).first()
    assert (r.longest, r.longest_start, r.longest_item) == (25, 2, 1)


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.matches(docs(spark, [(1, "a b", "en")]), none).collect()] == [0]
    assert decontaminate.matches(docs(spark, []), none).count() == 0


def shingle_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[i] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [512, 8])
def test_components_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", 4 * block)
    rng = random.Random(7)
    rows, base = [], [prose(rng, 120) for _ in range(4)]
    for k in range(90):
        w = base[k % 4].split(" ")
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w), "en"))
    rows += [(200 + k, prose(rng, rng.randint(1, 30)), "en") for k in range(40)] + [(300, rows[5][1], "en"), (301, "one", "en"), (302, "ONE", "en")]
    rows += [r for r in ODD if r[0] is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == shingle_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    rows = [(None, "a b c d", "en"), (1, None, "en"), (2, "a b c d", "en"), (2, "a b c d", "en")]
    assert sorted((str(r.doc_id), r.component_id) for r in jaccard.near_duplicates(docs(spark, rows)).collect()) == [("1", 1), ("2", 2), ("2", 2), ("None", None)]


def test_ids_with_several_texts_lose_no_link(spark):
    rng = random.Random(19)
    a, b, c = (prose(rng, 100) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(1, a, "en"), (1, b, "en"), (7, near(a), "en"), (9, near(b), "en"), (5, near(c), "en"), (12, c, "en"), (12, near(near(a)), "en"), (20, prose(rng, 50), "en"), (20, prose(rng, 50), "en")]
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows)).collect()}
    assert got == {(1, 1), (7, 1), (9, 1), (12, 1), (5, 1), (20, 20)}
    own = spark.createDataFrame([(1, a, 0, 0), (2, a, 1, 1)], "doc_id long, text string, _gone int, rep int")
    kept = jaccard.keep_one_each(own)
    assert kept.columns == own.columns and [r.doc_id for r in kept.collect()] == [1]


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (60, 60)], "a long, b long")
    got = {r.id: r.component for r in cc.components(e).collect()}
    assert got == dict.fromkeys(range(21), 0) | {40: 40, 50: 40, 60: 60}


def test_repeated_passages_go_from_all_but_the_first(spark):
    rng = random.Random(5)
    passages = [prose(rng, rng.randint(60, 110)) for _ in range(8)]
    rows = []
    for k in range(64):
        a, b = prose(rng, rng.randint(30, 120)), prose(rng, rng.randint(30, 120))
        rows.append((k, f"{a}\n{passages[k // 2 % 8]}\n{b}" if k % 2 else f"{a}\n{b}", "en"))
    d = docs(spark, [*rows, *ODD, (905, rows[0][1], "en")])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert len(got) == 64 + len(ODD) + 1
    assert all(got[k].text == rows[k][1] for k in range(0, 64, 2))  # clean documents and firsts of copies stay
    assert all(got[k].text == rows[k][1] for k in range(1, 16, 2))  # the first document with each passage
    caught = sum(passages[k // 2 % 8] not in got[k].text for k in range(17, 64, 2))
    assert caught >= 22  # of 24; a passage is missed if no chunk of it ends twice inside it
    assert len(got[905].text) < len(rows[0][1]) / 2
    assert got[900].text is None and got[901].text == "" and got[902].text == " \n\t " and got[None].text == "two words"


def test_three_ways_of_chunking_break_up_what_one_misses(spark):
    rng = random.Random(12)
    passages = [prose(rng, rng.randint(52, 90)) for _ in range(180)]
    rows = [(k, f"{prose(rng, 40)}\n{passages[k % 180]}\n{prose(rng, 40)}", "en") for k in range(360)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[k] == rows[k][1] for k in range(180))
    assert sum(passages[k] not in got[180 + k] for k in range(180)) == 180  # 179 with one


def test_whole_passages_go(spark):
    rng = random.Random(13)
    passages = [prose(rng, 120).rstrip() for _ in range(20)]
    one = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60))  # one line
    hindi = "।".join(" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(9)) for _ in range(8))
    passages += [one, hindi]
    rows = [(k, f"{prose(rng, 40)}\n{passages[k % 22]}\n{prose(rng, 40)}", "en") for k in range(44)] + [(50, one, "en")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[k] == rows[k][1] for k in range(22))
    lines = [[x.strip() for x in re.split(line_dedup.CUT.replace("\\\\", "\\"), p)] for p in passages]
    assert all(x not in got[22 + k] for k in range(22) for x in lines[k] if len(x) > 12)
    assert got[50] == ""


def test_line_dedup_settles_shared_hashes(spark):
    """A hash of several texts makes it start again with other hashes; here every line has one and the same hash at first."""
    rng = random.Random(9)
    p = prose(rng, 80)
    d = docs(spark, [(k, prose(rng, 60) + "\n" + p, "en") for k in range(3)])
    weak = "if({seed} = 0, 7L, xxhash64({line}, {seed}))"
    assert not line_dedup.mixed_hashes(d, line_dedup.repeated_runs(d, line_hash=weak), line_hash=weak).isEmpty()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d, line_hash=weak).collect()}
    assert got == {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()}
    assert p in got[0] and len(got[1]) < len(p) and len(got[2]) < len(p)


def brute_force_dedup(rows):
    """The stretches of lines as the operator's docstring says, compared as texts."""
    cut = re.compile(line_dedup.CUT.replace("\\\\", "\\"))
    pieces = {i: cut.split(t or "") for i, t in rows}
    spans = {}  # (doc, start, lines) -> (lines, whether a chunk)
    for i, p in pieces.items():
        lines = [x.strip(" \t\n\r") for x in p]
        for a in range(len(lines)):
            n = [max(1, len(x)) for x in lines]
            if len(lines[a]) >= line_dedup.LONG:
                spans[i, a, 1] = (lines[a],), True
            if a + 2 <= len(lines):
                enough = len(lines[a]) + len(lines[a + 1]) >= line_dedup.LEAST
                spans[i, a, 2] = tuple(lines[a : a + 2]), enough
                for b in range(a + 3, len(lines) + 1) if not enough else ():
                    if sum(n[a:b]) >= line_dedup.LEAST:
                        spans[i, a, b - a] = tuple(lines[a:b]), True
                        break
    first = {}
    for (i, a, _), (x, _) in sorted(spans.items()):
        first.setdefault(x, (i, a))
    runs = {i: [] for i in pieces}
    for (i, a, k), (x, chunk) in sorted(spans.items()):
        if first[x] != (i, a):
            if runs[i] and a < runs[i][-1][1]:
                runs[i][-1] = (runs[i][-1][0], max(a + k, runs[i][-1][1]), runs[i][-1][2] or chunk)
            else:
                runs[i].append((a, a + k, chunk))
    return pieces, {i: {j for a, b, chunk in r if chunk for j in range(a, b)} for i, r in runs.items()}


def test_removed_lines_are_those_of_brute_force(spark):
    """Without the choice of chunks (every stretch is one) exactly the repeated stretches go; with it, nothing else does."""
    rng = random.Random(21)
    rows = []
    passages = [" ".join(x.capitalize() + "." for x in (prose(rng, 12).replace(".", "").replace("\n", " ") for _ in range(m))) for m in (2, 3, 4, 5, 6) for _ in range(12)]
    for k in range(120):
        rows.append((k, f"{prose(rng, 40)}\n{passages[k % 60]}\n{prose(rng, 40)}"))
    rows += [(200, rows[3][1]), (201, ""), (202, "1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20"), (203, "x\n1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20"), (204, "Echo of an echo of an echo, again.\n" * 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    pieces, gone = brute_force_dedup(rows)
    every = {r.doc_id: r for r in line_dedup.dedup_lines(d, sparsity=1 << 40, short=1).collect()}
    assert {i: r._n_removed for i, r in every.items()} == {i: len(x) for i, x in gone.items()}
    assert {i: r.text for i, r in every.items()} == {i: "".join(x for j, x in enumerate(p) if j not in gone[i]) for i, p in pieces.items()}
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert all(got[i]._n_removed <= len(gone[i]) for i in gone)
    recall = {m: sum(got[60 + 12 * j + c].text != rows[60 + 12 * j + c][1] for c in range(12)) for j, m in enumerate((2, 3, 4, 5, 6))}
    assert sum(recall.values()) >= 54, recall  # nine in ten


def test_line_dedup_of_odd_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(d).count() == 0
    rng = random.Random(8)
    p = prose(rng, 70)
    names = "doc_id long, text string, spans string, _found_key string, _gone long, Hash long, _n_removed string, _checked int"
    own = spark.createDataFrame([(2, "a b. " + p, "s", "k", 1, 2, "n", 3), (1, p, "t", None, None, None, None, None), (1, p, "t", None, None, None, None, None), (None, p, "u", "", 0, 0, "", 0)], names)
    got = line_dedup.dedup_lines(own)
    assert got.columns == ["doc_id", "text", "spans", "_found_key", "_gone", "Hash", "_checked", "_n_removed"]
    rows = sorted((str(r.doc_id), r.spans, r.text == p, r._n_removed > 0) for r in got.collect())
    assert rows == [("1", "t", True, False), ("1", "t", True, False), ("2", "s", False, True), ("None", "u", False, True)]


def test_shuffle_files_of_the_last_step_are_let_go(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    release(spark)
    time.sleep(1)
    before = files()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() - before
    release(spark)
    ends = time.time() + 10
    while files() - before and time.time() < ends:
        time.sleep(0.2)
    assert not files() - before


def test_line_dedup_shuffles_texts_once(spark):
    """What is compared and what is left are read from texts that were shuffled and cut before."""
    rng = random.Random(31)
    p = prose(rng, 60)
    d = docs(spark, [(k, prose(rng, 30) + "\n" + p, "en") for k in range(4)])
    plan = line_dedup.dedup_lines(d)._jdf.queryExecution().toString()
    assert "Join" not in plan and "split(" not in plan


def test_line_dedup_keeps_bytes_of_what_stays(spark):
    """Texts that are not valid UTF-8 keep their bytes if no line goes; rows of one document twice are no repeats of each other."""
    rng = random.Random(32)
    p = prose(rng, 60)
    rows = [(1, bytearray(b"\xff" + p.encode())), (1, bytearray(b"\xff" + p.encode())), (2, bytearray(prose(rng, 40).encode() + b"\n" + p.encode())), (3, bytearray(b"\xfe\xff alone"))]
    d = spark.createDataFrame(rows, "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    got = line_dedup.dedup_lines(d).select("doc_id", F.col("text").cast("binary").alias("b"), "_n_removed").collect()
    kept = sorted((r.doc_id, bytes(r.b)) for r in got if r.doc_id != 2)
    assert kept == [(i, bytes(b)) for i, b in rows if i != 2]
    assert [r._n_removed > 0 for r in got if r.doc_id == 2] == [True]


def test_line_dedup_of_a_very_long_text(spark):
    rng = random.Random(2)
    p = prose(rng, 60)
    d = docs(spark, [(1, p, "en"), (2, prose(rng, 60_000) + "\n" + p, "en")])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert got[1].text == p and p not in got[2].text and len(got[2].text) > 200_000


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(3)
    good = [(k, prose(rng, rng.randint(60, 300)), "en") for k in range(150)]
    bad = [(500 + k, " ".join(w + "###" for w in prose(rng, 120).split()), "en") for k in range(20)] + [(600 + k, ("buy now cheap pills here today " * 40).strip(), "en") for k in range(10)]
    rows = [*good, *bad, *ODD, (700, "a\x0bb\x0cc d\xa0e\n\na\x0b\n#*|", "en"), (701, "q w e r t y u i o q w e r t y u i o p\nq w\nq w", "en")]
    got = quality.judged(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        t = text[r.doc_id]
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        c, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                cover |= set(range(i, i + 8))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    kept = {r.doc_id for r in got if r.kept}
    assert {i for i, _, _ in good} <= kept and not kept & {i for i, _, _ in bad}
    assert quality.judged(docs(spark, [])).count() == 0


def test_em_learns_from_agreement():
    patterns = {(1, 1): 900, (-1, -1): 80, (-1, 0): 10, (0, 0): 10}
    trust = quality.em(patterns, ["a", "b"])
    assert trust.weights["a"][-1] < -1 and trust.weights["b"][-1] < -1 and trust.weights["a"][1] >= 0
    assert quality.em({}, ["a"]).weights["a"][-1] <= 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(1)
    of = {"en": "the and with this from that have were which".split(), "de": "der und nicht über schön durch großer eine".split(), "ru": "привет мир и это как есть нет".split()}
    rows = [(k, " ".join(rng.choice(of[lang]) for _ in range(30)), lang) for k, lang in enumerate(["en", "de", "ru"] * 80)]
    d = docs(spark, [*rows, *ODD, (910, "12 34 !", "en")])
    model = language.fit(d)
    got = {r.doc_id: r for r in language.identify(d, model).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert held and all(got[i].lang_pred == lang for i, lang in held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902, 910))
    mixed = docs(spark, [(1, " ".join(of["en"] * 4 + of["de"] * 6), "de")])
    assert [s.lang for s in language.identify(mixed, model).first().spans] == ["en", "de"]
    assert {r.doc_id for r in language.keep_identified(d, model).collect()} >= {i for i, _, _ in rows}
    empty = language.fit(docs(spark, []))
    assert [r.lang_pred for r in language.identify(mixed, empty).collect()] == ["und"]


def test_variety_does_not_depend_on_length(spark):
    few = [f"word{k}" for k in range(12)]
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choice(few) for _ in range(n)), "en") for n in (200, 4990, 5010, 20_000)]
    got = quality.judged(docs(spark, rows)).select("vote_variety").collect()
    assert [r[0] for r in got] == [-1] * 4


def test_personal_data_of_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a.b@c.de", "x"), (3, "mail a.b@c.de", "x"), (None, 'token = "04dbebab91ab85687d33"', None), (4, "a" * 300_000 + " 1.2.3.4 " + "9" * 100_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted((str(r.doc_id), [tuple(s) for s in r.found]) for r in personal_data.personal_data(d).collect())
    assert got == [("1", []), ("2", []), ("3", [("email", 5, 13)]), ("3", [("email", 5, 13)]), ("4", [("ip", 300_001, 300_008)]), ("None", [("secret", 9, 29)])]
    clean = personal_data.redact(d)
    assert clean.columns == d.columns
    assert sorted(str(r.text)[:30] for r in clean.collect() if r.doc_id != 4) == ["", "None", "mail <email>", "mail <email>", 'token = "<secret>"']
    assert personal_data.personal_data(d.limit(0)).count() == 0


def test_pages_verdicts(spark):
    rows = [(1, "http://A.com/x", '<a href="http://B.org/x">'), (2, "http://b.org/q", "<a href=https://c.net/es/>x</a>"), (3, "http://c.net/es/1", None), (4, None, None), (5, "nourl", "x"), (6, "http://www.EXAMPLE.com/en/?q", ""), (7, "http://x.example.com/en/", ""), (8, "http://A.com?x", "")]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(1, 9)] == [("a.com", "/x", "com/"), ("b.org", "/q", None), ("c.net", "/es/1", "net/es/"), ("", "", None), ("", "", None), ("www.example.com", "/en/", "www.example.com/en/"), ("x.example.com", "/en/", "example.com/en/"), ("a.com", "", None)]
    assert (got[3].verdict, got[6].verdict, got[4].verdict) == ("block", "allow", "allow")
    assert got[2].distrust > 0 and got[2].trust > 0  # distrust against the link to c.net, trust along the one from a.com


def test_propagation_is_personalised_pagerank(spark):
    hosts = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0)], "host string, allowed double, blocked double")
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], "src string, dst string, n long")
    got = {r.host: r for r in url_filter.propagated(hosts, links, rounds=80).collect()}
    d = 0.85
    total = 1 + d + d * d
    assert [round(got[h].trust, 2) for h in "abc"] == [round(3 / total, 2), round(3 * d / total, 2), round(3 * d * d / total, 2)]
    assert got["b"].distrust > got["a"].distrust


def power_iteration(names, seeds, edges, damping=0.85):
    """PageRank of restarts at the seeds, with what has nowhere to go lost, scaled to the number of hosts."""
    total = sum(seeds.values())
    start = {h: seeds.get(h, 0.0) / total for h in names}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = dict(start)
    for _ in range(300):
        new = {h: (1 - damping) * start[h] for h in names}
        for (a, b), n in edges.items():
            new[b] += damping * rank[a] * n / out[a]
        rank = new
    whole = sum(rank.values())
    return {h: r / whole * len(names) for h, r in rank.items()}


def test_link_graph_is_that_of_brute_force(spark):
    rng = random.Random(14)
    names = [f"h{k}.{t}" for k in range(12) for t in ("com", "net", "org")]
    rows, edges = [], Counter()
    for k in range(150):
        host = rng.choice(names)
        targets = [rng.choice([*names, "only-linked.io", "sub.only-linked.io"]) for _ in range(rng.randint(0, 4))]
        forms = ['<a class=x href="http://{}/p">', "<a href='//{}'>", "<a title=y HREF = HTTPS://{}/>"]
        html = "".join(rng.choice(forms).format(t.upper() if rng.random() < 0.2 else t) for t in targets) + '<a href="/own"><a href="mailto:a@b.c"><link href="http://style.org/x">'
        if k % 10 == 0:
            base = rng.choice(names)
            html = f'<base href="//{base}/d/">' + html
            targets.append(base)
        for t in targets:
            edges[host, t] += t != host
        rows.append((k, f"https://{host}/{rng.choice(['en', 'es', 'fr'])}/{k}", html))
    edges = Counter({e: n for e, n in edges.items() if n})
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.src, r.dst): r.n for r in url_filter.linked_hosts(pages).collect()} == dict(edges)
    got = {r.page_id: r for r in url_filter.judged(pages, kin=0).collect()}
    every = {r[1].split("/")[2] for r in rows} | {b for _, b in edges}
    share = {"allow": Counter(), "block": Counter()}
    of = Counter(r[1].split("/")[2] for r in rows)
    for k, url, _ in rows:
        host, lang = url.split("/")[2:4]
        ruled = "allow" if host.endswith("com") else "block" if host.endswith("net") and lang != "en" else None
        if ruled:
            share[ruled][host] += 1 / of[host]
    trust = power_iteration(every, share["allow"], edges)
    distrust = power_iteration(every, share["block"], Counter({(b, a): n for (a, b), n in edges.items()}))
    for k, url, _ in rows:
        host = url.split("/")[2]
        assert abs(got[k].trust - trust[host]) < 0.01 and abs(got[k].distrust - distrust[host]) < 0.01
        if got[k].rule is None and abs(distrust[host] - trust[host] - 0.5) > 0.02:
            assert got[k].verdict == ("block" if distrust[host] - trust[host] > 0.5 else "allow")
    assert url_filter.kin_of(spark.createDataFrame([("a.b",), ("b",), ("c.b",), ("x.y",)], "host string")).count() == 4
    twice = url_filter.judged(spark.createDataFrame(rows * 2, "page_id long, url string, html string"), kin=0)
    assert twice.count() == 300 and url_filter.judged(pages.limit(0)).count() == 0


def test_trust_reaches_far_hosts(spark):
    hosts = spark.createDataFrame([(f"h{i}", float(i == 0), 0.0) for i in range(41)], "host string, allowed double, blocked double")
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(40)], "src string, dst string, n long")
    got = {r.host: r.trust for r in url_filter.propagated(hosts, links).collect()}
    whole = sum(0.85**i for i in range(41))
    assert all(abs(got[f"h{i}"] - 41 * 0.85**i / whole) < 0.005 for i in range(41)) and got["h40"] > 0


def test_template_text_is_left_out(spark):
    page = lambda k: f"<html><body><div>Share this page with all friends</div><article><p>Own text {k} is here</p><p>Share on all networks</p></article></body></html>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(40)] + [(100 + k, f"http://copy.org/{k}", page(0)) for k in range(30)] + [(200, None, None)]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3 is here"
    assert got[100] == "Own text 0 is here\nShare on all networks"  # copies of one page make no template
    assert got[200] == ""


PAGES = "page_id long, url string, html string"


def unnamed_page(rng, k, layout=0):
    """A page whose menu, notice and foot have no telling names: only the template tells them from the text."""
    paragraphs = [prose(rng, rng.randint(20, 60)).replace("\n", " ") for _ in range(rng.randint(1, 5))]
    menu = "".join(f"<div class=k1><a href=/{w}>{w} {k % 7}</a></div>" for w in WORDS[:6])
    notice = "<div class=k2>This is a notice that all pages of the site show.</div>"
    foot = f"<div class=k9>Number {k} of all pages</div>"
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    if layout:
        page = f"<html><body><table><tr><td class=k5>{menu}</td><td class=k6><h2>Title {k}</h2>{body}{notice}</td></tr></table>{foot}</body></html>"
    else:
        page = f"<html><body><div class=k0>{menu}</div><div class=k4><h1>Title {k}</h1>{notice}{body}</div>{foot}</body></html>"
    return page, "\n".join([f"Title {k}", *(" ".join(x.split()) for x in paragraphs)])


def test_slots_tell_text_from_unnamed_boilerplate(spark):
    rng = random.Random(6)
    made = [unnamed_page(rng, k, k % 2) for k in range(60)]
    rows = [(k, f"http://two-layouts.org/{k}", made[k][0]) for k in range(60)]
    small = [unnamed_page(rng, 100 + k, k % 2) for k in range(6)]  # six hosts of one page each, like the others
    rows += [(100 + k, f"http://small{k}.org/", small[k][0]) for k in range(6)]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == made[k][1] for k in range(60))
    notice = "This is a notice that all pages of the site show."
    for k in range(6):  # the template of all pages knows the elements, but no host's texts
        lines = [x for x in got[100 + k].split("\n") if x != notice]
        assert "\n".join(lines) == small[k][1]
    assert sum(main_text.own_text(made[k][0]) != got[k] for k in range(60)) > 50  # without a template most pages come out otherwise
    twice = {(r.page_id, r.text) for r in main_text.extract(spark.createDataFrame(rows[:60] * 2, PAGES)).collect()}
    assert twice == {(k, made[k][1]) for k in range(60)}


def test_names_decide_on_little_text_only():
    read = main_text.own_text
    assert read('<body><main class="content no-sidebar"><p>All of the text.</p></main></body>') == "All of the text."
    assert read('<article class="post has-related"><p>Some text of an article here.</p><div class="market-share">Shares of the market</div></article>').endswith("Shares of the market")
    assert read('<body><div class="comments"><p>' + "long text " * 50 + '</p></div></body>').startswith("long text")
    assert read('<article><p>' + "long text " * 50 + '</p><div class="post-comments"><p>nice one</p></div><div id="sidebar-left">x</div></article>') == ("long text " * 50).strip()


def test_comments_go_however_long(spark):
    read = main_text.own_text
    comments = "<section id=comments>" + "<div class=comment><p>nice one, and more of it</p></div>" * 30 + "</section>"
    assert read(f"<body><article><h1>Title</h1><p>A short article.</p>{comments}</article></body>") == "Title\nA short article."
    assert read(f"<body><header>Site</header><article><h1>Title</h1><p>A short article.</p></article>{comments}</body>") == "Title\nA short article."


def test_classes_are_those_of_brute_force(spark):
    rng = random.Random(16)
    rows = [(k, f"http://h{k % 3}.org/{k}", unnamed_page(rng, k, k % 2)[0]) for k in range(90)]
    vectors = {}
    for k, url, page in rows:
        p = main_text.parsed(page)
        for host in (url[7:9], "all"):
            for path, n in Counter(e[2] for e in p.elements).items():
                vectors.setdefault((host, False, path), {})[k] = n
            if host != "all":
                for (e, _, t, _), n in Counter(p.blocks).items():
                    key = vectors.setdefault((host, True, p.elements[e][2] + "\x1f" + t), {})
                    key[k] = key.get(k, 0) + n
    content = {k: main_text._content(main_text.parsed(page)) for k, _, page in rows}
    classes = defaultdict(lambda: [0, 0])
    for (host, is_text, _), v in vectors.items():
        if len(v) >= (18 if host == "all" else 6) and len({content[k] for k in v}) >= 8:
            classes[host, tuple(sorted(v.items()))][is_text] += 1
    expected = sorted((len(v), n, m) for (_, v), (n, m) in classes.items() if n)
    found = main_text.templates(spark.createDataFrame(rows, PAGES), contents=8, support=0.2).collect()
    assert sorted((r.pages, len(r.elements), len(r.texts)) for r in found) == expected and len(expected) > 8


def test_main_text_of_odd_tables(spark):
    assert main_text.extract(spark.createDataFrame([], PAGES)).count() == 0
    long = "<article>" + "".join(f"<p>Paragraph {k} of many.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, None, "<p>a</p>", 1), (1, None, "<p>a</p>", 2), (None, "x", None, 3), (2, "http://h.org/", "", 4), (3, "http://h.org/", long, 5)]
    got = main_text.extract(spark.createDataFrame(rows, PAGES + ", elements int")).collect()
    assert sorted((str(r.page_id), len(r.text)) for r in got)[:4] == [("1", 1), ("1", 1), ("2", 0), ("3", len(main_text.own_text(long)))]
    assert max(r.text.count("\n") for r in got) == 19_999


def test_counts_and_pieces_of_tables(spark):
    d = docs(spark, ODD)
    n = {r.doc_id: r for r in token_counts.token_counts(d, vocabulary("word_bpe_49k.json")).collect()}
    assert (n[900].n_bytes, n[900].n_tokens) == (0, 0) and n[904].over_limit and n[903].n_tokens == 1
    p = pieces.segmented(d, vocabulary("piece_bpe_32k.model"))
    assert all(r.decodes for r in p.collect())
    back = {r.doc_id: r.text for r in pieces.decoded(p, vocabulary("piece_bpe_32k.model")).collect()}
    assert back[904] == "x " * 3000 and back[900] == ""


def test_pipeline_keeps_columns_and_order():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece"]


def test_operators_on_empty_tables_long_texts_and_other_columns(spark):
    rng = random.Random(23)
    long = prose(rng, 30_000)
    names = "doc_id long, text string, lang string, spans string, found int, ids int, named int, rep int, component_id int, h int, items int, held_out int"
    rows = [(1, long, "en", *[None] * 9), (2, None, None, *[1] * 8, None), (3, "two words", "en", *[2] * 9), (3, "two words", "en", *[2] * 9)]
    rows = [(*r[:3], None if r[3] is None else str(r[3]), *r[4:]) for r in rows]
    d = spark.createDataFrame(rows, names)
    b = spark.createDataFrame([(1, " ".join(long.split()[100:140]))], "item_id long, text string")
    model = language.fit(d)
    ops = {
        "counts": lambda x: token_counts.token_counts(x, vocabulary("word_bpe_49k.json")),
        "pieces": lambda x: pieces.segmented(x, vocabulary("piece_bpe_32k.model")),
        "language": lambda x: language.identify(x, model),
        "matches": lambda x: decontaminate.matches(x, b),
        "near": jaccard.near_duplicates,
        "quality": quality.judged,
        "personal": personal_data.personal_data,
    }
    for name, op in ops.items():
        assert op(d.limit(0)).count() == 0, name
        assert sorted(r.doc_id for r in op(d).collect()) == [1, 2, 3, 3], name
    for name, op in {"language": lambda x: language.keep_identified(x, model), "clean": lambda x: decontaminate.decontaminate(x, b), "one": jaccard.keep_one_each, "redact": personal_data.redact}.items():
        assert op(d).columns == d.columns and op(d.limit(0)).count() == 0 and {3} <= {r.doc_id for r in op(d).collect()}, name
    counted = {r.doc_id: r for r in ops["matches"](d).collect()}
    assert (counted[1].longest, counted[1].longest_start, counted[1].n_hit) == (40, 100, 40)


def test_pipeline_stages_return_the_columns_of_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of it here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(31)
    d = docs(spark, [(k, prose(rng, 60), "en") for k in range(12)] + [(20, None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, d, str(tmp_path))
        assert kept.schema.simpleString() == d.schema.simpleString(), name
        assert {r.doc_id for r in kept.collect()} >= set(range(12)), name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_drops_near_copies_of_five_words(spark):
    from quillstream.llm import pipeline

    words = [f"w{i}" for i in range(500)]
    copy = ["x" + w if i % 50 == 25 else w for i, w in enumerate(words)]  # ten words changed: similarity 468 / 528 of three words, 446 / 546 of five
    d = docs(spark, [(1, " ".join(words), "en"), (2, " ".join(copy), "en"), (3, " ".join(w + "y" for w in words), "en")])
    assert {r.doc_id for r in pipeline.keep_one_each(spark, d, "").collect()} == {1, 3}


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = prose(rng, 40)
    rows = [(k, prose(rng, 80), "en") for k in range(60)]
    rows += [(100, rows[7][1], "en"), (101, rows[8][1], "en"), (102, item + " " + prose(rng, 60), "en"), (103, "123 456", "en"), (104, None, "en")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id for r in left.collect()}
    assert set(range(60)) <= got and not got & {102, 103, 104}
    assert left.where("not decodes").count() == 0
