"""Tables as items of the record model: documents become classified reports with a day, kind, tier and publisher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as t

TIERS = ("official", "premium", "quality", "general")
#: The DuckDB form of items(), for the queries' SQL.
ITEMS_SQL = """items AS (
  SELECT doc_id AS id, substr(split_part(text, chr(10), 1), 1, 120) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body,
         source AS publisher, lang, CASE doc_id % 10 WHEN 0 THEN 'editorial' WHEN 1 THEN 'explained' ELSE 'news' END AS kind,
         CASE doc_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'premium' WHEN 2 THEN 'quality' ELSE 'general' END AS tier,
         CAST(doc_id % 30 AS BIGINT) AS day
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, body, publisher, lang, kind, tier and day (days since the first) of each document."""
    first = F.substring_index("text", "\n", 1)
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("doc_id") % 10 == 0, "editorial").when(F.col("doc_id") % 10 == 1, "explained").otherwise("news")
    d = read(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    return d.select(
        F.col("doc_id").alias("id"), F.substring(first, 1, 120).alias("title"), F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)").alias("body"),
        F.col("source").alias("publisher"), "lang", kind.alias("kind"), tier.alias("tier"), (F.col("doc_id") % 30).alias("day"),
    )


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("tokens", t.tokens(F.col("title")))
