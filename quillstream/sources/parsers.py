"""Landed pages as rows: listing links, official releases, channel previews and descriptions, as column expressions.

Markup is read by what these pages have in common, not as a tree: an element without others of its
name inside runs up to its end tag. All functions take pages with `page_id`, `url` and `html`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import reading
from quillstream.functions import text as t

#: Parts of a listing page that hold no headlines.
FRAME = r"(?is)<(script|style|nav|footer|header|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
#: Texts of links that lead to no article.
JUNK_TEXT = (
    r"(?i)(login|sign ?in|sign ?up|register|subscribe|privacy|terms|cookie|contact|about us|careers|advertise|download (the )?app|facebook|twitter|"
    r"instagram|linkedin|youtube|whatsapp|telegram|home$|read more$|click here|view all|see all)"
)
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
RELEASE = "PRID=([0-9]+)"
#: How a release page says when it was posted, and how it is signed.
POSTED = r"(?i)Posted On:\s*([0-9]{1,2} [A-Z]{3} [0-9]{4}\s+[0-9]{1,2}:[0-9]{2}\s*[AP]M)\s*by PIB\s+\w+"
SIGNED = r"\*+\s*[A-Z]{2,}/[A-Z/ .-]+$"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, decoded; empty without it."""
    found = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return t.unescape(F.concat(*(F.regexp_extract(tag, found, k) for k in (1, 2, 3))))


def anchors(html: Column) -> Column:
    """Array of (tag, inside): the links in a text of markup, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), lambda a: F.struct(F.regexp_extract(a, ANCHOR, 1).alias("tag"), F.regexp_extract(a, ANCHOR, 2).alias("inside")))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URL, without its fragment."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#/]*)*/)[^/?#]*", 1)
    plain = F.regexp_replace(base, "[?#].*$", "")
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(plain, link))
        .when(link == "", base)
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), link))
    )
    # dots in paths: x/./y is x/y, x/../y is y
    return F.regexp_replace(F.regexp_replace(full, r"/(?:\./)+", "/"), r"(?<=[^/:])/(?!\.\.)[^/]+/\.\./", "/")


def listing_links(pages: DataFrame, *, pattern: str | None = None, least: int = 25, most: int = 240, limit: int = 60) -> DataFrame:
    """page_id, place, title, url: links of listing pages to pages of the same host with a headline's length, once each."""
    p = pages.select("page_id", F.col("url").alias("base"), F.posexplode(anchors(F.regexp_replace("html", FRAME, " "))).alias("at", "a"))
    titled = attribute(F.col("a.tag"), "title")
    p = p.select("page_id", "base", "at", t.collapse(F.when(titled != "", titled).otherwise(t.strip_tags(F.col("a.inside")))).alias("title"), resolved(attribute(F.col("a.tag"), "href"), F.col("base")).alias("url"), attribute(F.col("a.tag"), "href").alias("href"))
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    host = lambda c: F.lower(F.regexp_extract(c, r"^https?://([^/?#:]*)", 1))
    fit = F.length("title").between(least, most) & ~F.col("title").rlike(JUNK_TEXT) & (F.col("href") != "") & (host(F.col("url")) == host(F.col("base"))) & (host(F.col("url")) != "")
    fit = fit & (bare(F.col("url")) != bare(F.col("base")))
    if pattern:
        fit = fit & F.col("url").rlike(pattern)
    first = p.where(fit).groupBy("page_id", "url").agg(F.min_by(F.struct("title", "at"), "at").alias("f"))
    # a page's links, at most as many as the page has
    ranked = first.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("f.at", "f.title", "url"))), 1, limit).alias("l"))
    return ranked.select("page_id", F.posexplode("l").alias("place", "l")).select("page_id", "place", "l.title", "l.url")


def releases(pages: DataFrame) -> DataFrame:
    """page_id, place, ministry, release and title: the releases of an official list under its ministries' headings, once each."""
    parts = F.split(F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " "), r"(?i)(?=<h3\b)")
    p = pages.select("page_id", F.posexplode(F.filter(parts, lambda x: x.rlike("(?i)^<h3"))).alias("part", "x"))
    inside = F.regexp_extract("x", r"(?is)</h3\s*>.*?<ul\b[^>]*>(.*?)</ul\s*>", 1)
    p = p.select("page_id", "part", t.strip_tags(F.regexp_extract("x", r"(?is)^<h3\b[^>]*>(.*?)</h3\s*>", 1)).alias("ministry"), F.posexplode(anchors(inside)).alias("at", "a"))
    titled = attribute(F.col("a.tag"), "title")
    p = p.select("page_id", F.struct("part", "at").alias("place"), "ministry", F.regexp_extract(attribute(F.col("a.tag"), "href"), RELEASE, 1).alias("release"), t.collapse(F.when(titled != "", titled).otherwise(t.strip_tags(F.col("a.inside")))).alias("title"))
    first = p.where("release <> ''").groupBy("page_id", "release").agg(F.min_by(F.struct("place", "ministry", "title"), "place").alias("f"))
    listed = first.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("f.place", "f.ministry", "release", "f.title"))).alias("l"))
    return listed.select("page_id", F.posexplode("l").alias("place", "l")).select("page_id", "place", "l.ministry", "l.release", "l.title")


def listing_day(html: Column) -> Column:
    """The day that the list's three selections say; null unless all are there."""
    chosen = lambda part: F.regexp_extract(html, rf"""(?is)<select\b[^>]*\bid=["']?ContentPlaceHolder1_ddl{part}\b[^>]*>(?:(?!</select).)*?<option\b(?=[^>]*\bselected)[^>]*\bvalue=["']?([0-9]+)""", 1)
    return F.when((chosen("day") != "") & (chosen("Month") != "") & (chosen("Year") != ""), F.try_to_timestamp(F.concat_ws("-", chosen("Year"), chosen("Month"), chosen("day")), F.lit("yyyy-M-d")).cast("date"))


def release_body(html: Column) -> Column:
    """(published, text) of a release page; text is empty without its box."""
    box = F.regexp_extract(html, r"""(?is)<div\b[^>]*(?:\bid=["']?PdfDiv\b|\bclass=["'][^"']*innner-page-main-about-us-content-right-part)[^>]*>(.*)""", 1)
    text = t.strip_tags(box)
    posted = t.collapse(F.upper(F.regexp_extract(text, POSTED, 1)))
    # as wall time at +05:30
    when = F.coalesce(F.try_to_timestamp(F.initcap(F.lower(F.regexp_replace(posted, r"\s*([AP]M)$", ""))), F.lit("d MMM yyyy h:mm")), F.lit(None).cast("timestamp"))
    hour = F.when(posted.endswith("PM") & ~posted.rlike(r" 12:[0-9]{2}\s*PM$"), F.expr("INTERVAL 12 HOURS")).when(posted.rlike(r" 12:[0-9]{2}\s*AM$"), F.expr("INTERVAL -12 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    rest = F.when(posted != "", F.trim(F.regexp_replace(text, rf"(?s)^.*?{POSTED}", ""))).otherwise(text)
    return F.struct((when + hour - F.expr("INTERVAL 330 MINUTES")).alias("published"), F.regexp_replace(rest, SIGNED, "").alias("text"))


def channel_posts(pages: DataFrame, *, limit: int = 40) -> DataFrame:
    """page_id, place, title, url, summary, published and links: the posts of a channel's preview page, newest first."""
    begin = r"""(?i)(?=<div\b[^>]*\bclass=["'](?:[^"']*\s)?tgme_widget_message[\s"'])"""
    parts = F.filter(F.split("html", begin), lambda x: x.rlike(begin.replace("(?i)", "(?i)^")))
    p = pages.select("page_id", F.posexplode(parts).alias("at", "x"))
    body = F.regexp_extract("x", r"""(?is)<div\b[^>]*\bclass=["'](?:[^"']*\s)?tgme_widget_message_text[\s"'][^>]*>(.*?)</div\s*>""", 1)
    p = p.withColumn("body", body)
    marked = F.regexp_replace("body", "<[^>]*>", "\n")  # every piece of text is a line
    p = p.withColumn("lines", F.filter(F.transform(F.split(marked, "\n"), t.strip_tags), lambda x: x != "")).where(F.size("lines") > 0)
    head = F.left(F.get("lines", F.lit(0)), F.lit(180))
    title = F.when((F.length(head) < 20) & (F.size("lines") > 1), F.left(F.concat_ws(" — ", head, F.get("lines", F.lit(1))), F.lit(180))).otherwise(head)
    outward = F.filter(F.transform(anchors(F.col("body")), lambda a: attribute(a["tag"], "href")), lambda u: (u != "") & ~u.contains("t.me/"))
    own = attribute(F.regexp_extract("x", r"""(?is)<a\b([^>]*\btgme_widget_message_date\b[^>]*)>""", 1), "href")
    p = p.select(
        "page_id", "at", title.alias("title"), F.when(own != "", own).otherwise(F.coalesce(F.get(outward, F.lit(0)), F.lit(""))).alias("url"),
        F.left(F.array_join(F.slice("lines", 2, 1 << 30), " "), F.lit(700)).alias("summary"),
        F.try_to_timestamp(F.regexp_extract("x", r"""(?is)<time\b[^>]*\bdatetime=["']([^"']+)["']""", 1)).alias("published"), F.slice(outward, 1, 5).alias("links"),
    ).where("url <> ''")
    newest = p.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "title", "url", "summary", "published", "links")), asc=False), 1, limit).alias("l"))
    return newest.select("page_id", F.posexplode("l").alias("place", "l")).select("page_id", "place", "l.title", "l.url", "l.summary", "l.published", "l.links")


def description(html: Column, *, least: int = 40, most: int = 700) -> Column:
    """The first description of a page's head that is long enough, clipped; empty without one."""
    head = F.regexp_extract(html, r"(?is)^(.*?)(?:</head\s*>|\Z)", 1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))

    def named(attr: str, value: str) -> Column:
        found = F.filter(tags, lambda m: F.lower(attribute(m, attr)) == value)
        return t.clip(t.strip_tags(attribute(F.coalesce(F.get(found, F.lit(0)), F.lit("")), "content")), most)

    every = F.array(named("property", "og:description"), named("name", "description"), named("name", "twitter:description"))
    return F.coalesce(F.get(F.filter(every, lambda x: F.length(x) >= least), F.lit(0)), F.lit(""))


#: Names of tags that say when a page was published, in the order they are believed.
PUBLISHED = (("property", "article:published_time"), ("name", "publish-date"), ("name", "pubdate"), ("name", "date"), ("itemprop", "datepublished"))


def published_day(html: Column) -> Column:
    """The day of a page by its tags, else by its structured data, else as written near the beginning of its text."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1))

    def tagged(attr: str, value: str) -> Column:
        return attribute(F.coalesce(F.get(F.filter(tags, lambda m: F.lower(attribute(m, attr)) == value), F.lit(0)), F.lit("")), "content")

    iso = lambda c: F.try_to_timestamp(F.nullif(F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    structured = F.regexp_extract(html, r'''(?is)"datePublished"\s*:\s*"([^"]+)"''', 1)
    timed = F.regexp_extract(html, r"""(?is)<time\b[^>]*\bdatetime=["']([^"']+)["']""", 1)
    written = reading.text_day(F.left(t.strip_tags(html), F.lit(400)))
    return F.coalesce(*(iso(tagged(a, v)) for a, v in PUBLISHED), iso(structured), iso(timed), written)
