"""Operators on small frames: rules of ties, caps, thresholds and state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import clusters, facets, filters, rules, search, upserts, windows
from quillstream.operators import similarity as sim
from quillstream.sources import landing
from quillstream.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("HTTPS://Www.Site.com/a/?utm_source=x&b=1&ref=z#top", "https://www.site.com/a?b=1"),
        ("https://site.com/", "https://site.com/"),
        ("/files/x.pdf#page=2", "/files/x.pdf#page=2"),
        ("https://s.com/a?gclid=1", "https://s.com/a"),
    ],
)
def test_canonical_url(spark, raw, expected):
    assert one(spark, t.canonical_url(F.lit(raw))) == expected


def test_stem_and_tokens(spark):
    assert one(spark, t.tokens(F.lit("Policies on the Taxes of Tigers, 3 reserves and a Crisis"))) == ["policy", "tax", "tiger", "3", "reserve", "crisis"]
    assert one(spark, t.tokens(F.lit(None).cast("string"))) == []


def test_titles(spark):
    assert one(spark, t.clean_title(F.lit(" – Big  news | "))) == "Big news"
    assert one(spark, t.strip_publisher(F.lit("Bank cuts rates - The Paper"), F.lit("The Paper"))) == "Bank cuts rates"
    assert one(spark, t.clip(F.lit("one two three"), 8)) == "one two…"
    assert one(spark, t.publisher_key(F.lit("The Economic Times.com"), {"economictimes": "et"})) == "et"


def test_sentences_keep_abbreviations_and_decimals(spark):
    got = one(spark, t.sentences(F.lit("Dr. Rao met the ministers for 3.5 hours on Monday. Nothing else was decided by the panel."), 10))
    assert got == ["Dr. Rao met the ministers for 3.5 hours on Monday.", "Nothing else was decided by the panel."]


def similarity(spark, a, b):
    d = spark.createDataFrame([(1, a), (2, b)], "id long, tokens array<string>")
    rows = sim.sized(sim.shared_pairs(d), d).select(sim.story_similarity().alias("s")).collect()
    return rows[0].s if rows else 0.0


def test_story_similarity_edges(spark):
    assert similarity(spark, ["a", "b"], ["b", "a"]) == 2.0
    assert similarity(spark, ["a", "b", "c"], ["a", "b", "c", "d", "e", "f"]) > 0  # exactly three shared, Jaccard one half
    assert similarity(spark, ["a", "b", "x"], ["a", "b", "y"]) == 0
    assert similarity(spark, list("abcd"), list("abcdefghij")) > 0  # contained, four shared


def test_greedy_compares_with_first_members_only(spark):
    items = spark.createDataFrame([(i, i) for i in range(1, 6)], "id long, place_ long")
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.9), (1, 4, 0.1)], "a long, b long, similarity double")
    got = {r.id: r.lead for r in clusters.greedy(items, pairs, ["place_"], members=2, least=0.05).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    got = {r.id: r.lead for r in clusters.greedy(items, pairs, ["place_"], members=1, least=0.2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_blocks_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    got = {r.id: r.block for r in clusters.blocks(pairs).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_spread_caps_publishers_then_fills(spark):
    d = spark.createDataFrame([(i, "p" if i < 6 else f"q{i}", float(20 - i)) for i in range(8)], "id long, publisher string, score double").withColumn("day", F.lit(1))
    got = [r.id for r in windows.spread(d, ["day"], "publisher", [F.desc("score"), F.col("id")], 6).orderBy("rank").collect()]
    assert got == [0, 1, 2, 6, 7, 3]


def test_budgets(spark):
    d = spark.createDataFrame([(1, 1, 10), (1, 2, 30), (1, 3, 5)], "g long, id long, cost long")
    assert [r.id for r in windows.prefix_budget(d, ["g"], [F.col("id")], F.col("cost"), 20).collect()] == [1]
    assert sorted(r.id for r in clusters.skip_ahead_budget(d, ["g"], ["id"], "cost", 20).collect()) == [1, 3]


def test_islands(spark):
    d = spark.sql("select 1 as u, date'2024-01-01' + x as d from values (0), (1), (1), (4) as t(x)")
    assert sorted(r.length for r in windows.islands(d, ["u"], "d").collect()) == [1, 2]


def test_facets_skip_their_own_filter(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "x string, y int")
    got = {(r.facet, r.value): r.n for r in facets.facet_counts(d, {"x": F.col("x"), "y": F.col("y")}, {"x": F.col("x") == "a", "y": F.col("y") == 1}).collect()}
    assert got == {("x", "a"): 1, ("x", "b"): 1, ("y", "1"): 1, ("y", "2"): 1}


def test_upserts(spark):
    b = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "k int, v string, n int")
    d = spark.createDataFrame([(1, "z", 7), (3, "w", 8)], "k int, v string, n int")
    get = lambda p: sorted(map(tuple, upserts.upsert(b, d, ["k"], p).collect()))
    assert get("replace") == [(1, "z", 7), (2, "y", 5), (3, "w", 8)]
    assert get("ignore") == [(1, "x", None), (2, "y", 5), (3, "w", 8)]
    assert get("fill") == [(1, "x", 7), (2, "y", 5), (3, "w", 8)]


def test_month_archive_is_written_once(spark, tmp_path):
    d = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month string, n int")
    upserts.archive_months(d, spark.createDataFrame([("2024-01",)], "month string"), str(tmp_path / "a"))
    assert [r.n for r in spark.read.json(str(tmp_path / "a")).collect()] == [2]


def test_partition_overwrite_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "p")
    upserts.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "day int, v string"), path, "day")
    upserts.overwrite_partitions(spark.createDataFrame([(2, "c")], "day int, v string"), path, "day")
    assert sorted((r.day, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_pruned_points(spark):
    p = [(["a", "b", "c"], "1"), (["a", "b", "d"], "2"), (["x", "y"], "3")]
    d = spark.createDataFrame([(p,)], "p array<struct<words:array<string>,text:string>>")
    assert [x.text for x in d.select(search.pruned(F.col("p"), 3).alias("k")).first().k] == ["1", "3"]


def test_kinds_and_grades(spark):
    kind = lambda own, title, path: one(spark, filters.content_kind(F.lit(own), F.lit(title), F.lit(path)))
    assert kind("editorial", "x", "/") == "editorial"
    assert kind(None, "Explained: x", "/") == "explained"
    assert kind(None, "x", "/opinion/y") == "editorial"
    assert kind(None, "x", "/news/y") == "news"
    assert [one(spark, rules.grade(F.lit(s))) for s in (5.5, 5.49, 1.6, 1.0)] == ["NOTE", "SKIM", "READ", "LOW"]
    assert one(spark, rules.story_score(F.lit(0.0), F.lit(64))) == 0.0


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(f"<item><title>T{i} - </title><link>https://x/{i}</link><description>&lt;p&gt;Hi {i}&lt;/p&gt; Read more</description><pubDate>Mon, 1 Jan 2024 10:00:00 GMT</pubDate></item>" for i in range(3)) + "</channel></rss>")
    got = landing.feed(spark, str(tmp_path / "f.xml"), limit=2).orderBy("url").collect()
    assert [(r.title, r.summary) for r in got] == [("T0", "Hi 0"), ("T1", "Hi 1")]
    assert str(got[0].published) == "2024-01-01 10:00:00"


def test_mails_folder_and_notes(spark, tmp_path):
    for d in ("m", "d", "n"):
        (tmp_path / d).mkdir()
    (tmp_path / "m/a.eml").write_bytes(b'Message-ID: <1>\r\nSubject: Letter\r\nContent-Type: text/html\r\n\r\n<a href="https://x/1">Five words make a good headline here</a><a href="https://x/2">More</a>')
    assert sorted(str(r.url) for r in landing.mails(spark, str(tmp_path / "m")).collect()) == ["None", "https://x/1"]
    (tmp_path / "d/b.md").write_text("intro\n# One\ntext\n## Two\nmore")
    f = landing.folder(spark, str(tmp_path / "d"))
    assert [r.heading for r in f.orderBy("section").collect()] == ["", "One", "Two"]
    assert landing.folder(spark, str(tmp_path / "d"), f.select("path", "modified").distinct()).count() == 0
    (tmp_path / "n/c.json").write_text('{"s1": {"what": "w", "why": "y", "points": ["p"]}, "s2": {"what": "w"}}')
    assert [r.story_id for r in landing.notes(spark, str(tmp_path / "n")).collect()] == ["s1"]


def test_registry_chain_and_due(spark):
    a = spark.createDataFrame([("x", True, 1), ("y", False, 1)], "id string, enabled boolean, n int")
    b = spark.createDataFrame([("x", True, 2), ("z", None, 2)], "id string, enabled boolean, n int")
    assert sorted((r.id, r.n) for r in landing.registry(a, b).collect()) == [("x", 1), ("z", 2)]
    assert one(spark, landing.chain(F.lit("rss:a"), F.lit(None).cast("array<string>"), F.lit("a.com"))) == ["rss:a", "search:site:a.com"]
    s = spark.sql("select 'x' as id, 900 as interval_s union all select 'y', 900")
    st = spark.sql("select 'x' as id, timestamp'2024-01-01 00:00:00' as last_attempt")
    assert sorted(r.id for r in landing.due(s, st, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()) == ["y"]


def test_streams_end_like_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", i % 3, "error" if i % 2 else "view", 1.0, "{}") for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = jobs.event_stream(spark, str(tmp_path / "e"))
    q = jobs.source_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("states").collect()))
    assert got == sorted(map(tuple, jobs.source_states(e).collect()))
    q = jobs.counts(jobs.event_stream(spark, str(tmp_path / "e")), "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, jobs.counts(e, "1 hour").collect()))
