"""Articles found in JSON-LD at any depth, over the documents as pages that carry it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources import nested
from quillstream.sources.tables import ITEMS_SQL, items


@query(f"WITH {ITEMS_SQL} SELECT id, body, 'day ' || day AS published, title AS headline FROM items WHERE NOT contains(lower(body || title), '</script>')")
def linked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page with its text in a list, in an object or in both, three to six levels down."""
    i = items(spark, sf_dir).where(~F.contains(F.lower(F.concat("body", "title")), F.lit("</script>")))
    article = F.struct(F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("body").alias("articleBody"), F.concat(F.lit("day "), F.col("day").cast("string")).alias("datePublished"))
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), article.alias("mainEntity"))).alias("@graph")))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(article.alias("item")).alias("entry"))).alias("list")).alias("page")))
    text = F.when(F.col("id") % 3 == 0, F.to_json(article)).when(F.col("id") % 3 == 1, graph).otherwise(deep)
    page = F.concat(F.lit('<html><script>var a = "{}";</script><script type="application/ld+json">'), text, F.lit("</script><p>text</p>"))
    return nested.articles(i.select("id", page.alias("html")))
