"""Landed files as rows: feeds, listing pages, channel previews, release pages, mail, notes and folders of documents."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as t

#: Paths of a listing page that lead to no article.
JUNK_LINK = r"(?i)/(login|tag|author|page)(/|$)"
ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def registry(public: DataFrame, *more: DataFrame) -> DataFrame:
    """Sources by id; of equal ids the first given counts, disabled ones are left out."""
    every = public.withColumn("given", F.lit(0))
    for k, m in enumerate(more, 1):
        every = every.unionByName(m.withColumn("given", F.lit(k)), allowMissingColumns=True)
    first = every.groupBy("id").agg(F.min_by(F.struct(*public.columns), "given").alias("s"))
    return first.select("s.*").where(F.coalesce("enabled", F.lit(True)))


def chain(primary: Column, fallbacks: Column, site: Column) -> Column:
    """The steps of a source: its own, its fallbacks, and a news search of its site unless one is among them."""
    steps = F.concat(F.array(primary), F.coalesce(fallbacks, F.array().cast("array<string>")))
    return F.when(site.isNotNull() & ~F.exists(steps, lambda s: s.startswith("search:")), F.concat(steps, F.array(F.concat(F.lit("search:site:"), site)))).otherwise(steps)


def due(sources: DataFrame, state: DataFrame, now: Column, *, grace: int = 30) -> DataFrame:
    """Sources never tried, or tried an interval (less a grace of seconds) ago."""
    s = sources.join(state.select("id", "last_attempt"), "id", "left")
    return s.where(F.col("last_attempt").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_attempt") >= F.col("interval_s") - grace)).drop("last_attempt")


def feed(spark: SparkSession, path: str, *, limit: int = 100) -> DataFrame:
    """Entries of RSS and Atom files: title, url, summary, published; at most `limit` of each file, in file order."""
    reader = spark.read.format("xml")
    rss = reader.option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    rss = rss.select(F.input_file_name().alias("file"), "title", F.col("link").alias("url"), F.col("description").alias("summary"), F.col("pubDate").alias("date"))
    link = "struct<_href:string,_rel:string>"
    atom = reader.option("rowTag", "entry").schema(f"title string, link array<{link}>, summary string, content string, published string, updated string").load(path)
    # the first link that is no edition of another kind
    href = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    atom = atom.select(F.input_file_name().alias("file"), "title", href.alias("url"), F.coalesce("summary", "content").alias("summary"), F.coalesce("published", "updated").alias("date"))
    from pyspark.sql import Window

    e = rss.union(atom).withColumn("at", F.monotonically_increasing_id()).where("title is not null and url is not null")
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("rn") <= limit)
    plain = F.regexp_replace("date", r"^[A-Za-z]{3,9},?\s*|\s+(GMT|UTC?|Z|\+00:?00)$", "")
    zone = F.regexp_extract("date", r"([+-][0-9]{2}):?([0-9]{2})$", 0)
    minutes = F.coalesce(F.substring(F.replace(zone, F.lit(":")), 2, 2).try_cast("int") * 60 + F.substring(F.replace(zone, F.lit(":")), 4, 2).try_cast("int"), F.lit(0)) * F.when(zone.startswith("-"), -1).otherwise(1)
    local = F.trim(F.regexp_replace(plain, r"\s*[+-][0-9]{2}:?[0-9]{2}$", ""))
    mail = F.coalesce(*(F.try_to_timestamp(local, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")))
    published = F.when(F.col("date").rlike("^[0-9]{4}-"), F.try_to_timestamp("date")).otherwise(mail - F.make_dt_interval(mins=minutes))
    return e.select(t.clean_title(F.col("title")).alias("title"), "url", t.clip(t.clean_summary(t.strip_tags(F.col("summary"))), 700).alias("summary"), published.alias("published"), "file")


def links(pages: DataFrame, *, least: int = 25, most: int = 240) -> DataFrame:
    """Links of listing pages with a headline's length, once each and without junk: page_id, href, title and place."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("title"))
    a = pages.select("page_id", F.posexplode(found).alias("place", "a")).select("page_id", "place", "a.href", "a.title")
    a = a.where(F.length("title").between(least, most) & ~F.col("href").rlike(JUNK_LINK))
    return a.groupBy("page_id", "href").agg(F.min_by(F.struct("title", "place"), "place").alias("f")).select("page_id", "href", "f.title", "f.place")


def mails(spark: SparkSession, path: str, *, most: int = 40) -> DataFrame:
    """Newsletters and their headline-like links: message_id, subject, url (null for the letter itself), title."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in it:
            rows = []
            for content in pdf["content"]:
                m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                body = m.get_body(("html", "plain"))
                text = body.get_content() if body else ""
                rows.append((m["Message-ID"], m["Subject"], None, m["Subject"]))
                found = [(u, re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", s)).strip()) for u, s in re.findall(r'<a[^>]+href="(https?://[^"]+)"[^>]*>(.*?)</a>', text, re.S)]
                rows += [(m["Message-ID"], m["Subject"], u, s) for u, s in [x for x in dict(found).items() if len(x[1]) >= 30 and len(x[1].split()) >= 5][:most]]
            yield pd.DataFrame(rows, columns=["message_id", "subject", "url", "title"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "message_id string, subject string, url string, title string")


def folder(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Sections of Markdown and text files, new or changed since `known` (path, modified): path, modified, section, heading, text."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("text"))
    if known is not None:
        f = f.join(known, ["path", "modified"], "left_anti")
    parts = F.split("text", r"(?m)^(?=#{1,3} )")
    s = f.select("path", "modified", F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("section", "text"))
    return s.withColumn("heading", F.regexp_extract("text", r"^#{1,3} ([^\n]*)", 1))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes written elsewhere, one JSON object of story id to note per file; those without the two mandatory fields are left out."""
    n = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<what:string,why:string,points:array<string>>>")).alias("story_id", "note"))
    return n.select("story_id", "note.what", "note.why", F.slice("note.points", 1, 8).alias("points")).where("what is not null and why is not null")
