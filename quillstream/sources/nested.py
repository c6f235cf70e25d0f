"""Values by their key at any depth of JSON: articles in JSON-LD, videos in search pages.

JSON is parsed once to VARIANT. The walk goes down one level of all rows at a time with variant_explode, keeps what has a
wanted key and goes on with objects and arrays, so the number of rounds is the depth of the deepest text, whatever their
number. Text that is not JSON, and null, have no values. Below a wanted key the walk goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.clusters import durable

#: Where a page's JSON-LD stands, and how many videos of a search are taken.
LINKED_DATA = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
VIDEOS = 15


def found(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, key, depth, path, value) of JSON texts (id, json): every value under one of the keys, as VARIANT.

    Paths sort like the values stand: places in arrays have six digits, keys of an object their alphabetical order.
    """
    spark = rows.sparkSession
    level = rows.select("id", F.try_parse_json("json").alias("v"), F.lit("").alias("path")).where("v is not null")
    out, depth = None, 0
    while True:
        depth += 1
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            "id", F.col("key"), F.col("value"), F.concat("path", F.lit("/"), F.coalesce("key", F.lpad(F.col("pos").cast("string"), 6, "0"))).alias("path")
        )
        below = durable(below.withColumn("kind", F.substring(F.schema_of_variant("value"), 1, 5)))
        hits = below.where(F.col("key").isin(*keys)).select("id", "key", F.lit(depth).alias("depth"), "path", "value")
        out = hits if out is None else out.union(hits)
        level = below.where("kind in ('OBJEC', 'ARRAY')").select("id", F.col("value").alias("v"), "path")
        if level.isEmpty():
            return out


def text_of(value: Column) -> Column:
    """A scalar as it is; arrays of scalars joined by blank lines; null for what else there is."""
    kind = F.schema_of_variant(value)
    many = F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n\n")
    return F.when(kind.startswith("OBJECT"), None).when(kind.startswith("ARRAY"), many).otherwise(F.try_variant_get(value, "$", "string"))


def articles(pages: DataFrame) -> DataFrame:
    """(id, body, published, headline) of pages (id, html) with JSON-LD: the longest articleBody, the first datePublished and headline, at any depth."""
    scripts = pages.select("id", F.explode(F.regexp_extract_all("html", F.lit(LINKED_DATA), F.lit(1))).alias("json"))
    f = found(scripts, ["articleBody", "datePublished", "headline"]).select("id", "key", "path", text_of(F.col("value")).alias("text")).where("text is not null")
    first = lambda k: F.min_by("text", F.when(F.col("key") == k, F.struct("path", "text")))
    longest = F.max_by("text", F.when(F.col("key") == "articleBody", F.struct(F.length("text"), "text")))
    return f.groupBy("id").agg(longest.alias("body"), first("datePublished").alias("published"), first("headline").alias("headline"))


def videos(pages: DataFrame) -> DataFrame:
    """(id, place, video, title, channel, length) of search pages (id, json): the first VIDEOS renderers with an id and a title."""
    v = found(pages, ["videoRenderer"])
    get = lambda path: F.try_variant_get("value", path, "string")
    either = lambda name: F.coalesce(get(f"$.{name}.runs[0].text"), get(f"$.{name}.simpleText"))
    d = v.select("id", "path", get("$.videoId").alias("video"), either("title").alias("title"), either("ownerText").alias("channel"), either("lengthText").alias("length"))
    d = d.where("video is not null and title is not null").groupBy("id", "video").agg(F.min(F.struct("path", "title", "channel", "length")).alias("x"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("x.path"))).where(F.col("place") <= VIDEOS)
    return d.select("id", "place", "video", "x.title", "x.channel", "x.length")
