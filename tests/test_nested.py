"""Values at any depth of JSON: fixtures at several depths, against a walk in plain Python."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quillstream.sources import nested


def walk(x, keys, path=""):
    out = []
    for k, v in sorted(x.items()) if isinstance(x, dict) else [(f"{i:06d}", v) for i, v in enumerate(x)] if isinstance(x, list) else []:
        if isinstance(x, dict) and k in keys:
            out.append((k, f"{path}/{k}", v))
        out += walk(v, keys, f"{path}/{k}")
    return out


def test_keys_at_any_depth(spark):
    rng = random.Random(1)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([None, 1, 2.5, True, "text", "", "é"])
        if rng.random() < 0.5:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: made(depth - 1) for k in rng.sample(["a", "b", "wanted", "other key", "c"], rng.randint(0, 3))}

    texts = [made(6) for _ in range(60)]
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(100, None), (101, "{not json"), (102, ""), (103, '{"wanted": {"wanted": [1]}}')]
    d = spark.createDataFrame(rows, "id long, json string")
    found = nested.found(d, ["wanted", "a"]).select("id", "key", "path", "depth", F.col("value").cast("string").alias("s"), F.to_json("value").alias("j")).collect()
    expected = sorted((i, k, p) for i, t in [*enumerate(texts), (103, json.loads(rows[-1][1]))] for k, p, _ in walk(t, {"wanted", "a"}))
    assert sorted((r.id, r.key, r.path) for r in found) == expected
    assert all(r.depth == r.path.count("/") for r in found)
    whole = {(r.id, r.path): json.loads(r.j) for r in found if r.j is not None}
    assert whole == {(i, p): v for i, t in [*enumerate(texts), (103, json.loads(rows[-1][1]))] for k, p, v in walk(t, {"wanted", "a"}) if (i, p) in whole}


def test_articles_in_linked_data(spark):
    ld = lambda x: f'<SCRIPT type="application/ld+json" id=1>{x if isinstance(x, str) else json.dumps(x)}</script>'
    body = {"@type": "NewsArticle", "articleBody": "The body.\nIt has lines.", "datePublished": "2024-05-01", "headline": "Head"}
    pages = [
        (1, "<p>x</p>" + ld(body)),
        (2, ld({"@graph": [{"@type": "WebSite", "headline": "Site"}, {"mainEntity": {**body, "articleBody": ["One.", "Two."]}}]})),
        (3, ld("{broken") + ld([{"a": [{"b": {"c": body}}]}]) + ld({"articleBody": "short"})),
        (4, "<script>var articleBody = 1</script>"),
        (5, None),
        (6, ld({"datePublished": "2023-01-01", "articleBody": {"not": "text"}})),
    ]
    got = {r.id: (r.body, r.published, r.headline) for r in nested.articles(spark.createDataFrame(pages, "id long, html string")).collect()}
    text = ("The body.\nIt has lines.", "2024-05-01", "Head")
    assert got == {1: text, 2: ("One.\n\nTwo.", "2024-05-01", "Site"), 3: text, 6: (None, "2023-01-01", None)}


def test_videos_of_a_search_page(spark):
    video = lambda k, **x: {"videoRenderer": {"videoId": f"v{k}", "title": {"runs": [{"text": f"Title {k}"}]}, "ownerText": {"runs": [{"text": "C"}]}, "lengthText": {"simpleText": "3:10"}, **x}}
    deep = {"contents": {"two": {"primary": [{"items": [video(1), {"ad": 1}, video(2, title={"simpleText": "Plain"})]}, {"items": [video(1), video(3, title=None), {"shelf": {"list": [video(4)]}}]}]}}}
    many = {"x": [video(k) for k in range(30)]}
    d = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(many)), (3, "[]")], "id long, json string")
    got = {(r.id, r.place): (r.video, r.title, r.channel, r.length) for r in nested.videos(d).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): ("v1", "Title 1", "C", "3:10"), (1, 2): ("v2", "Plain", "C", "3:10"), (1, 3): ("v4", "Title 4", "C", "3:10")}
    assert [got[2, k][0] for k in range(1, 16)] == [f"v{k}" for k in range(15)] and len(got) == 18
