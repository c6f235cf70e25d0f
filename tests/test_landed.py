"""Landed files as a source: what a stream reads once, what it finds changed or removed, sections and letters."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillstream.sources import landed

LONG = "word " * 30
LETTER = """From: The Daily <news@daily.example>
Subject: Morning
 letter
Date: Tue, 02 Jan 2024 03:04:05 +0530
Message-ID: <a1@daily.example>
MIME-Version: 1.0
Content-Type: text/html; charset=utf-8

<html><style>p {{}}</style><body><a href="https://d.example/1">Court reads the new water law in full</a>
<a href="https://d.example/1">Court reads the new water law in full again</a>
<a href="https://d.example/2">Too short</a><a href="https://d.example/unsubscribe?x">Please leave this list of ours by this link</a>
<a href="https://d.example/3">Read the <b>E-Paper</b></a><a href="mailto:x">Write to the people who make this letter</a>{more}</body></html>
"""


def put(folder, name, text, at=None):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text.encode() if isinstance(text, str) else text)
    if at:
        os.utime(p, (at, at))


def run(spark, tmp_path, **options):
    """One run of a stream over what is there; all rows written so far as (batch, path, change, content)."""
    spark.dataSource.register(landed.Landed)
    rows = spark.readStream.format("landed").options(manifests=str(tmp_path / "manifests"), **options).load(str(tmp_path / "in"))

    def write(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{tmp_path}/out/b={batch}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    return sorted((r.batch, r.path, r.change, None if r.content is None else bytes(r.content).decode()) for r in out)


def test_stream_reads_each_file_once_and_sees_changes_and_removals(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a.md", "one", 1000)
    put(folder, "deep/b.md", "two", 2000)
    put(folder, ".hidden.md", "no", 1000)
    put(folder, "c.bin", "no", 1000)
    first = run(spark, tmp_path, endings=".md")
    assert [x[1:] for x in first] == [("a.md", "new", "one"), ("deep/b.md", "new", "two")]
    assert run(spark, tmp_path, endings=".md") == first
    put(folder, "a.md", "one more", 3000)
    (folder / "deep" / "b.md").unlink()
    put(folder, "e.md", "", 4000)
    later = run(spark, tmp_path, endings=".md")
    assert [x[1:] for x in later if x not in first] == [("a.md", "changed", "one more"), ("deep/b.md", "removed", None), ("e.md", "new", "")]
    assert set(first) < set(later)


def test_repeated_batch_finds_the_same_files(tmp_path):
    put(tmp_path / "in", "a.md", "one", 1000)
    options = {"path": str(tmp_path / "in"), "manifests": str(tmp_path / "manifests"), "files": "1"}
    s = landed._Stream(landed._Folder(options))
    v1 = s.latestOffset()
    assert s.latestOffset() == v1 == {"version": 1}
    put(tmp_path / "in", "b.md", "two", 2000)
    put(tmp_path / "in", "c.md", "three", 3000)
    v2 = s.latestOffset()
    plan = s.partitions(v1, v2)
    assert [x[0] for p in plan for x in p.files] == ["b.md"]
    s.latestOffset()
    again = landed._Stream(landed._Folder(options))
    assert again.partitions(v1, v2) == plan and again.partitions(v2, v2) == []
    assert [x[0] for p in again.partitions(s.initialOffset(), v2) for x in p.files] == ["a.md", "b.md"]
    again.commit(v2)
    assert again.folder.versions() == [2, 3]
    with pytest.raises(FileNotFoundError):
        again.partitions(v1, v2)


def test_partitions_go_by_bytes_and_files_that_went_give_no_row(tmp_path):
    for i in range(6):
        put(tmp_path / "in", f"{i}.txt", "x" * 40, 1000 + i)
    f = landed._Folder({"path": str(tmp_path / "in"), "bytes": "100"})
    dealt = f.dealt({}, f.listing())
    assert [len(p.files) for p in dealt] == [2, 2, 2]
    (tmp_path / "in" / "1.txt").unlink()
    assert [b.num_rows for b in f.read(dealt[0].files)] == [1]
    assert landed._Folder({"path": str(tmp_path / "none")}).listing() == {}


def test_differences_against_sets():
    old = {f"f{i}": (i, i) for i in range(20)}
    new = {f"f{i}": (i + (i % 3 == 0), i) for i in range(5, 30)}
    got = landed.differences(old, new)
    assert {p for p, _, c in got if c == "removed"} == set(old) - set(new)
    assert {p for p, _, c in got if c == "new"} == set(new) - set(old)
    assert {p for p, _, c in got if c == "changed"} == {p for p in set(old) & set(new) if old[p] != new[p]}


def test_stream_needs_manifests(spark, tmp_path):
    spark.dataSource.register(landed.Landed)
    with pytest.raises(StreamingQueryException, match="manifests"):
        q = spark.readStream.format("landed").load(str(tmp_path)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()


def test_sections_of_files_and_refreshed(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "Policy_notes-2024-03.md", f"intro\n# First\n{LONG}\n## Short\nno\n### Third one\n{LONG}", 1000)
    put(folder, "march 2023.txt", f"RULES FOR THE RIVER\n{LONG}\n\nsmall\n\n{LONG}", 1000)
    put(folder, "page.html", f"<nav><h1>x</h1></nav><p>lost</p><h1>A &amp; B</h1><p>{LONG}<p>{LONG}</p><div>aside</div><h2>C</h2><p>no</p>", 1000)
    put(folder, "bad.htm", b"\xff\xfe plain <b>text</b>", 1000)
    put(folder, "empty.md", "", 1000)
    spark.dataSource.register(landed.Landed)
    files = spark.read.format("landed").load(str(folder))
    s = landed.sections(files)
    words = LONG.strip()
    got = {(r.path, r.n): (r.document, r.title, r.body) for r in s.collect()}
    assert got == {
        ("Policy_notes-2024-03.md", 1): ("Policy notes 2024 03", "First", words),
        ("Policy_notes-2024-03.md", 3): ("Policy notes 2024 03", "Third one", words),
        ("march 2023.txt", 1): ("march 2023", "Rules For The River", f"RULES FOR THE RIVER {words}"),
        ("march 2023.txt", 2): ("march 2023", "march 2023: section 2", words),
        ("page.html", 1): ("page", "A & B", f"{words} {words}"),
        ("bad.htm", 1): ("bad", "bad: section 1", "�� plain text"),
    }
    days = {r.path: str(r.published) for r in s.collect()}
    assert days["Policy_notes-2024-03.md"] == "2024-03-01 06:30:00" and days["march 2023.txt"] == "2023-03-01 06:30:00" and days["page.html"] == "1970-01-01 00:16:40"
    changed = spark.createDataFrame([("page.html", datetime(2024, 1, 1), "removed", None), ("bad.htm", datetime(2024, 1, 1), "changed", bytearray(b"new"))], landed.SCHEMA)
    once = landed.refreshed(s, changed, landed.sections(changed))
    twice = landed.refreshed(once, changed, landed.sections(changed))
    assert {(r.path, r.body) for r in once.collect()} == {(k[0], v[2]) for k, v in got.items() if k[0] not in ("page.html", "bad.htm")} | {("bad.htm", "new")}
    assert sorted(once.collect()) == sorted(twice.collect())


def test_letters_links_papers_and_what_was_seen(spark, tmp_path):
    folder = tmp_path / "in"
    more = "".join(f'<a href="https://d.example/n{i}">Headline number {i} of the long list today</a>' for i in range(60))
    put(folder, "1.eml", LETTER.format(more=""), 1000)
    put(folder, "2.eml", LETTER.format(more=""), 1000)
    put(folder, "3.eml", LETTER.replace("a1@", "a3@").format(more=more), 1000)
    put(folder, "4.eml", "Subject: plain\n\nhello  there", 1000)
    put(folder, "5.eml", "", 1000)
    spark.dataSource.register(landed.Landed)
    rows = landed.letters(spark.read.format("landed").load(str(folder)))
    got = [(r.kind, r.place, r.title, r.url, r.sender, r.address, r.published) for r in rows.where("path = '1.eml'").orderBy("place").collect()]
    base = ("The Daily", "news@daily.example", datetime(2024, 1, 1, 21, 34, 5))
    assert got == [
        ("letter", 0, "Morning letter", None, *base),
        ("link", 1, "Court reads the new water law in full", "https://d.example/1", *base),
        ("paper", 2, "Today's e-paper: The Daily", "https://d.example/3", *base),
    ]
    assert rows.where("path = '3.eml' and place > 0").count() == landed.LINKS
    assert [tuple(r) for r in rows.where("path = '4.eml'").select("title", "text", "sender", "published").collect()] == [("plain", "hello there", "Newsletter", datetime(1970, 1, 1, 0, 16, 40))]
    assert rows.where("path = '5.eml'").count() == 1
    fresh = landed.unseen(rows, spark.createDataFrame([("a3@daily.example",)], "key string"))
    assert sorted({r.path for r in fresh.collect()}) == ["1.eml", "4.eml", "5.eml"]


def test_heading_lines(spark):
    lines = ["The Rivers of India", "rivers of the north are", "A Title That Ends.", "1234 5678 90123 45", "TWO RULES, ONE STATE", "Of The"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(landed.heading_line(F.col("x"))).collect()]
    assert got == ["The Rivers of India", None, None, None, "Two Rules, One State", None]
