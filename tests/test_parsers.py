"""Parsers of landed pages, character references, folding, and terms of several words."""

from __future__ import annotations

import html as stdlib_html
import random
import re
import unicodedata
from datetime import date, datetime

from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import rules, similarity, terms, windows
from quillstream.sources import landing, parsers, rule_files

PAGE = "page_id long, url string, html string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_character_references_are_those_of_the_standard(spark):
    texts = ["a &amp; b", "&lt;b&gt; &eacute;&#233;&#xE9; &hellip;", "&#147;q&#148; &#128;", "&unknown; &amp", "&#x1F600; &NotEqualTilde;", "no reference", "&#0; &#xD800; &#1114112;", None, "&amp;lt;"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(t.unescape(F.col("x"))).collect()]
    for x, y in zip(texts, got, strict=True):
        assert y == (None if x is None else stdlib_html.unescape(x) if not x.endswith("&amp") else x), x


def test_folding_drops_marks(spark):
    x = "Ålesund ŁódźĆ Ṽietnam naïve Ü é ﬀ"
    got = one(spark, t.fold, x)
    plain = "".join(c for c in unicodedata.normalize("NFKD", x.replace("ﬀ", "")) if not unicodedata.combining(c))
    assert got.replace("ﬀ", "") == plain


def test_stop_words_are_complete(spark):
    assert one(spark, t.tokens, "India says plan for big week: reservoirs report") == ["reservoir"]


def test_atom_and_rss_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One &amp;amp; two</title><link rel="edit" href="http://x/e"/><link href="http://x/1"/><content>Body</content><updated>2024-03-05T10:00:00+05:30</updated></entry>'
        "<entry><title>No link</title></entry></feed>"
    )
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>Three</title><link>http://x/3</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0530</pubDate></item><item><title>Four</title><link>http://x/4</link><pubDate>5 Mar 2024 10:00 GMT</pubDate></item></channel></rss>")
    got = {r.url: r for r in landing.feed(spark, str(tmp_path / "*.xml")).collect()}
    assert set(got) == {"http://x/1", "http://x/3", "http://x/4"} and got["http://x/1"].title == "One & two" and got["http://x/1"].summary == "Body"
    assert got["http://x/1"].published == got["http://x/3"].published == datetime(2024, 3, 5, 4, 30) and got["http://x/4"].published == datetime(2024, 3, 5, 10, 0)


def test_listing_links(spark):
    page = (
        '<header><a href="/h">A headline in the header of the page</a></header><a class=x data-y="1" href="/news/1#top"><b>A headline</b> of sufficient length &amp; more</a>'
        "<a href='story/2' title='Titled headline of sufficient length'>x</a><a href=\"http://other.org/3\">A headline of another host, long enough</a><a href='/login'>Sign in to read all of our headlines</a>"
        "<a href='/news/1'>The same page with another headline text</a><a href='../up/4?x=1'>One folder up, a headline of good length</a><a href='//x.org/5'>Without a scheme, a headline of good length</a><a href='#here'>A link to this very page, of good length</a><a>No target but still of good length here</a>"
    )
    d = spark.createDataFrame([(1, "https://x.org/list/today/", page), (2, "https://y.org/", None), (3, None, page)], PAGE)
    got = [(r.page_id, r.place, r.title, r.url) for r in parsers.listing_links(d).orderBy("page_id", "place").collect()]
    assert got == [
        (1, 0, "A headline of sufficient length & more", "https://x.org/news/1"),
        (1, 1, "Titled headline of sufficient length", "https://x.org/list/today/story/2"),
        (1, 2, "One folder up, a headline of good length", "https://x.org/list/up/4?x=1"),
        (1, 3, "Without a scheme, a headline of good length", "https://x.org/5"),
    ]
    assert [r.url for r in parsers.listing_links(d, pattern="/news/", limit=1).collect()] == ["https://x.org/news/1"]


def test_releases_and_their_pages(spark):
    select = lambda part, v: f'<select id="ContentPlaceHolder1_ddl{part}"><option value="1">a</option><option selected="selected" value="{v}">b</option></select>'
    page = select("day", 7) + select("Month", 3) + select("Year", 2024) + (
        '<h3>Ministry of  A</h3><ul><li><a href="/r.aspx?PRID=11" title="First release">x</a></li><li><a href="/r.aspx?PRID=12">Second &amp; <i>more</i></a></li></ul>'
        '<h3>Ministry of B</h3><ul><li><a href="?PRID=11">again</a></li><li><a href="/other">none</a></li><li><a href="?PRID=13">Third</a></li></ul>'
    )
    d = spark.createDataFrame([(1, "u", page), (2, "u", "<p>no list</p>"), (3, "u", None)], PAGE)
    got = [(r.page_id, r.place, r.ministry, r.release, r.title) for r in parsers.releases(d).orderBy("page_id", "place").collect()]
    assert got == [(1, 0, "Ministry of A", "11", "First release"), (1, 1, "Ministry of A", "12", "Second & more"), (1, 2, "Ministry of B", "13", "Third")]
    assert [r[0] for r in d.orderBy("page_id").select(parsers.listing_day(F.col("html"))).collect()] == [date(2024, 3, 7), None, None]
    body = '<div id="PdfDiv"><h2>Title</h2> Posted On: 07 MAR 2024  5:30PM by PIB Delhi <p>Text of it.</p> ***ABC/DE</div>'
    got = one(spark, parsers.release_body, body)
    assert (got.published, got.text) == (datetime(2024, 3, 7, 12, 0), "Text of it. ")
    assert one(spark, parsers.release_body, "<p>x</p>").text == ""


def test_channel_posts(spark):
    post = lambda k, body, extra="": f'<div class="tgme_widget_message js-x" data-post="c/{k}"><div class="tgme_widget_message_text js">{body}</div><a class="tgme_widget_message_date" href="https://t.me/c/{k}"><time datetime="2024-03-05T10:0{k}:00+00:00">x</time></a>{extra}</div>'
    page = post(1, "Short<br/>then a second line<br>and a third") + post(2, 'A first line that is long enough <a href="http://out.org/a">link</a><a href="https://t.me/b">t</a>') + '<div class="tgme_widget_message x"><p>no text</p></div>'
    got = parsers.channel_posts(spark.createDataFrame([(1, "u", page), (2, "u", None)], PAGE)).orderBy("place").collect()
    assert [(r.title, r.url, r.summary) for r in got] == [("A first line that is long enough", "https://t.me/c/2", "link t"), ("Short — then a second line", "https://t.me/c/1", "then a second line and a third")]
    assert got[0].links == ["http://out.org/a"] and got[0].published == datetime(2024, 3, 5, 10, 2)


def test_descriptions(spark):
    long = "A description that is certainly of forty characters or more."
    cases = {
        f'<head><meta property="og:description" content="short"><meta content="{long}" name=description></head>': long,
        f"<head><meta name='twitter:description' content='{long} &amp; x'>": long + " & x",
        f"<head></head><meta name=description content='{long}'>": "",
        "<p>": "",
    }
    for page, expected in cases.items():
        assert one(spark, parsers.description, page) == expected


def test_published_days(spark):
    cases = {
        '<meta property="article:published_time" content="2024-03-05T10:00:00Z"><script>{"datePublished": "2023-01-01"}</script>': date(2024, 3, 5),
        '<script type="application/ld+json">{"datePublished" : "2023-01-02T00:00"}</script>': date(2023, 1, 2),
        "<p>New Delhi, 5 January 2024: text</p>": date(2024, 1, 5),
        "<time datetime='2022-02-03'>x</time>": date(2022, 2, 3),
        "<p>none</p>": None,
    }
    for page, day in cases.items():
        assert one(spark, parsers.published_day, page) == day


def reference_matches(text, rules_):
    """Distinct terms by two alternations, longest term first, over the text."""
    out = set()
    for exact in (True, False):
        forms = {}
        for _, term, _ in rules_:
            for f in terms.forms_of(term):
                if f.is_exact == exact:
                    forms[f.form] = f.term
        if forms:
            by_term = sorted({f for f in forms}, key=lambda f: (-len(forms[f]), -len(f)))
            plain = re.sub(r"[\s\-]+", " ", text)
            rx = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, by_term)) + ")(?![A-Za-z0-9])", 0 if exact else re.I)
            for m in rx.finditer(plain):
                out.add((exact, forms[m[0] if exact else m[0].lower()]))
    return out


def test_terms_are_those_of_alternations(spark):
    table = [("a", "supreme court", 2.0), ("a", "court", 1.0), ("b", "SEBI", 3.0), ("b", "Act", 1.0), ("b", "tiger reserve", 2.0), ("c", "reserve bank", 1.5), ("c", "s&t", 1.0), ("c", "covid-19", 1.0), ("c", "tax", 1.0), ("d", "U.S.", 1.0), ("d", "Supreme Court", 4.0)]
    texts = ["The Supreme-Court and courts", "SEBI, sebi; SEBIs act Act Acts acting", "tiger reserves bank on tiger reserve bank", "S&T and s&ts, COVID 19 covid-19s", "taxes tax taxi U.S. u.s. U.S.A", "", None]
    rng = random.Random(3)
    words = "supreme court courts SEBI act Act tiger reserve reserves bank s&t covid 19 tax taxes U.S. - , x".split()
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    got = {}
    for r in terms.matched(d, table, {"x": 1.0}).collect():
        got.setdefault(r.id, set()).add(r.term)
    for k, x in enumerate(texts):
        assert got.get(k, set()) == {term for _, term in reference_matches(x or "", table)}, x
    first = rules.scored(terms.matched(d.where("id = 0"), table, {"x": 2.0})).collect()
    assert {r.bucket: r.score for r in first} == {"a": 6.0, "d": 8.0}  # "courts" is the plural of a term of its own
    assert terms.matched(d, [], {"x": 1.0}).count() == 0


def test_rules_from_files(spark, tmp_path):
    assert rule_files.config(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "r.json").write_text('{"polity": {"kw": {"supreme court": 2, "Act": 1.5}}, "x": {"kw": ["one"]}, "y": null}')
    found = rule_files.bucket_rules(rule_files.config(str(tmp_path / "r.json")))
    assert found == [("polity", "supreme court", 2.0), ("polity", "Act", 1.5), ("x", "one", 1.0)]
    assert sorted(rule_files.table_rules(rules.rule_table(spark, found))) == sorted(found)


def test_places_and_contained_sets(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 9) / 2) for k in range(300)]
    d = windows.places(spark.createDataFrame(rows, "id long, v double"), [-F.floor("v")], [F.desc("v"), F.col("id")], "place")
    assert [r.id for r in d.orderBy("place").collect()] == [k for k, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]
    assert {r.place for r in d.collect()} == set(range(1, 301))
    small = [(k, rng.sample("abcdefghij", rng.randint(1, 6))) for k in range(60)]
    large = [(100 + k, rng.sample("abcdefghijkl", rng.randint(1, 9))) for k in range(60)]
    schema = "id long, tokens array<string>"
    a, b = spark.createDataFrame(small, schema), spark.createDataFrame(large, schema)
    for share in (0.5, 0.6, 0.9, 1.0):
        got = {(r.a, r.b, r.shared) for r in similarity.contained(a, b, share=share).collect()}
        assert got == {(i, j, len({*x} & {*y})) for i, x in small for j, y in large if len({*x} & {*y}) >= share * len(x)}


def test_settings_and_guards(spark):
    from quillstream import settings

    assert settings.Settings.of(spark).keep_days == 400
    spark.conf.set("spark.quillstream.keep_days", "30")
    assert settings.Settings.of(spark).keep_days == 30
    spark.conf.unset("spark.quillstream.keep_days")
    assert settings.day_range("2024-01-01", "2024-04-03") and settings.rows_asked(9999) == 500 and settings.ids_asked(["a", "a"]) == ["a"] and settings.inside("/x", "a/b") == "/x/a/b"
    for call in (lambda: settings.day_range("2024-01-01", "2024-04-04"), lambda: settings.day_range("2024-1", "x"), lambda: settings.ids_asked(["a"] * 1001), lambda: settings.note_given("x" * 5001), lambda: settings.inside("/x", "../y"), lambda: settings.inside("/x", "/y")):
        try:
            call()
        except ValueError:
            continue
        raise AssertionError(call)
