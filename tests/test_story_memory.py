"""Stories with a memory of three days: against plain Python, as one batch and as a stream, and what repeated batches change."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import memory
from quillstream.streaming import stories
from quillstream.streaming.ledger import Ledger, refresh

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()


def likeness(a, b):
    a, b = set(a), set(b)
    shared = len(a & b)
    if a == b:
        return 2.0 if shared >= 2 else 0.0
    if shared < 3:
        return 0.0
    jaccard, contain = shared / len(a | b), shared / min(len(a), len(b))
    return jaccard + contain if jaccard >= 0.5 or (contain >= 0.75 and shared >= 4) else 0.0


def walked(reports, idle=3):
    """id -> story, report by report."""
    stories_, out = [], {}
    for i, kind, day, tokens in sorted(reports, key=lambda r: (r[2], r[0])):
        best, top = None, 0.0
        for s in stories_:
            if s["kind"] == kind and s["last"] >= day - idle:
                like = max(likeness(tokens, m) for m in s["members"])
                if like > top:
                    best, top = s, like
        if best is None:
            best = {"name": i, "kind": kind, "last": day, "members": []}
            stories_.append(best)
        best["last"] = max(best["last"], day)
        if len(best["members"]) < 8:
            best["members"].append(tokens)
        out[i] = best["name"]
    return out


def random_reports(seed, n=260, days=25):
    rng = random.Random(seed)
    themes = [rng.sample(WORDS, rng.randint(3, 7)) for _ in range(14)] + [["alpha", "bravo", "charlie", "delta"]] * 3 + [["echo", "golf"], ["lima"], []]
    out = []
    for k in range(n):
        t = list(rng.choice(themes))
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        out.append((k * 7 % 1000 + (k % 3), rng.choice(["news", "editorial"]), rng.randrange(days), sorted(set(t))))
    return [r for k, r in enumerate(out) if r[0] not in {x[0] for x in out[:k]}]


def frame(spark, reports):
    return spark.createDataFrame(reports, "id long, kind string, day long, tokens array<string>")


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_history_is_walked_report_by_report(spark, seed):
    reports = random_reports(seed)
    expected = walked(reports)
    assert {r.id: r.story for r in memory.assigned(frame(spark, reports).repartition(5)).collect()} == expected
    assert len(set(expected.values())) > len(set(walked(reports, idle=99).values()))  # the memory matters


def test_a_story_ends_after_three_idle_days(spark):
    same = ["alpha", "bravo", "charlie"]
    reports = [(1, "news", 1, same), (2, "news", 4, same), (3, "news", 8, same), (4, "news", 9, same), (5, "editorial", 9, same), (6, "news", 12, same)]
    assert {r.id: r.story for r in memory.assigned(frame(spark, reports)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 3}
    odd = [(None, "news", 1, same), (7, None, 1, same), (8, "news", None, same), (9, "news", 1, None), (10, "news", 1, ["one"]), (11, "news", 1, ["one"]), (12, "news", 1, same), (12, "news", 2, ["x", "y"])]
    assert {r.id: r.story for r in memory.assigned(frame(spark, odd)).collect()} == {10: 10, 11: 11, 12: 12}
    assert not memory.assigned(frame(spark, [])).collect()


def test_the_first_eight_reports_speak_for_a_story(spark):
    sets = [["alpha", "bravo", "charlie", "delta", f"n{k}"] for k in range(9)]
    reports = [(k, "news", 1, t) for k, t in enumerate(sets)] + [(20, "news", 2, ["charlie", "delta", "n8", "z"])]
    got = {r.id: r.story for r in memory.assigned(frame(spark, reports)).collect()}
    assert got == walked(reports) and got[8] == 0 and got[20] == 20  # 20 is like 8, the ninth report


def test_batches_and_streams_give_the_same_stories(spark, tmp_path):
    reports = random_reports(3, n=160, days=12)
    expected = walked(reports)
    by_batch = [[r for r in reports if r[2] // 3 == k] for k in range(4)]
    landed = str(tmp_path / "landed")
    for k, part in enumerate(by_batch):
        frame(spark, part).coalesce(1).write.parquet(f"{landed}/part{k}")
    folder, check = str(tmp_path / "stories"), str(tmp_path / "checkpoint")
    stream = lambda upto: spark.readStream.schema(stories.REPORTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{landed}/part{upto}")
    for glob in ("[01]", "[0123]"):  # stopped after two files and started again
        stories.follow(spark, stream(glob), folder, check).awaitTermination()
    got = stories.assigned(spark, folder)
    assert {r.id: r.story for r in got.collect()} == expected and got.count() == len(expected)
    kept = Ledger(spark, folder).latest("memory", memory.MEMORY)
    assert kept.agg(F.min("last")).first()[0] >= max(r[2] for r in reports) - memory.IDLE_DAYS
    assert kept.groupBy("story").count().agg(F.max("count")).first()[0] <= memory.MEMBERS


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path))
    first, second = [(1, "news", 1, ["a", "b", "c"])], [(2, "news", 2, ["a", "b", "c"]), (3, "news", 2, ["x", "y"])]
    assert stories.advance(ledger, frame(spark, first), 0)
    # the second batch stops after its parts were written and before its entry
    with monkeypatch.context() as m:
        m.setattr(Ledger, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            stories.advance(ledger, frame(spark, [(99, "news", 2, ["half", "done"])]), 1)
    assert [r.id for r in stories.assigned(spark, str(tmp_path)).collect()] == [1]
    assert stories.advance(ledger, frame(spark, second), 1)
    rows = lambda: sorted((r.id, r.story, r.batch) for r in stories.assigned(spark, str(tmp_path)).collect())
    assert rows() == [(1, 1, 0), (2, 1, 1), (3, 3, 1)]
    files = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert not stories.advance(ledger, frame(spark, first), 1)
    assert rows() == [(1, 1, 0), (2, 1, 1), (3, 3, 1)] and sorted(p.name for p in tmp_path.rglob("*.parquet")) == files


def test_what_is_done_once(spark, tmp_path):
    ledger, done = Ledger(spark, str(tmp_path)), []
    with pytest.raises(ZeroDivisionError):
        ledger.once("rekey", lambda: done.append(1 / 0))
    assert ledger.once("rekey", lambda: done.append(1)) and not ledger.once("rekey", lambda: done.append(2))
    assert ledger.once("other", lambda: done.append(3)) and done == [1, 3]
    assert ledger.write(0, {"t": spark.range(3)}) and not ledger.write(0, {"t": spark.range(9)})
    assert ledger.table("t", "id long").count() == 3 and ledger.table("absent", "id long").count() == 0


def test_old_days_are_frozen_and_new_ones_rebuilt(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = lambda v, days: spark.createDataFrame([(d, v) for d in days], "day long, v string")
    refresh(rows("a", range(1, 6)), path, today=5)
    refresh(rows("b", range(0, 8)), path, today=6)
    got = {r.day: r.v for r in spark.read.parquet(path).collect()}
    assert got == {0: "b", 1: "a", 2: "a", 3: "a", 4: "a", 5: "b", 6: "b"}
