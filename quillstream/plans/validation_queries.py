"""Verdicts, terms, topics and notes of a model, made here of the documents themselves, through one validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.validated import Field, validated
from quillstream.plans.registry import query
from quillstream.sources.tables import ITEMS_SQL, items, read

SCHEMA = [
    Field("verdict", "number", 3, mandatory=True),
    Field("note", "text", 60, mandatory=True),
    Field("terms", "list", 6, grounded=True),
    Field("topics", "list", 2, among="topics"),
]


@query(f"""WITH {ITEMS_SQL}, v AS (SELECT id, title, id % 6 - 1 AS verdict, CASE WHEN id % 11 <> 0 THEN title END AS note, regexp_extract_all(title, '[A-Za-z]+') AS ws, publisher FROM items),
  a AS (SELECT *, CASE WHEN verdict BETWEEN 0 AND 3 THEN verdict END AS v2, nullif(trim(regexp_replace(note, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), '') AS n1,
    [x FOR x IN list_concat(ws[2:9], ['zzqqy', upper(ws[2])]) IF x IS NOT NULL AND x <> ''] AS t1, [x FOR x IN [upper(publisher), publisher, 'src0', 'src1', 'src2', 'nowhere'] IF x IS NOT NULL] AS p1 FROM v),
  b AS (SELECT *, [x FOR x IN t1 IF contains(lower(title), lower(x))] AS t2, [x FOR x IN p1 IF list_contains(k, lower(x))] AS p2 FROM a, (SELECT list(DISTINCT lower(source)) AS k FROM documents)),
  c AS (SELECT *, list_filter(t2, lambda x, i: list_position(list_transform(t2, lambda y: lower(y)), lower(x)) = i) AS t3, list_filter(p2, lambda x, i: list_position(list_transform(p2, lambda y: lower(y)), lower(x)) = i) AS p3 FROM b)
  SELECT id, v2 AS verdict, CASE WHEN length(n1) > 60 THEN regexp_replace(substr(n1, 1, 60), '[\\x20]+[^\\x20]*$', '') || '…' ELSE n1 END AS note, array_to_string(t3[1:6], ',') AS terms, array_to_string(p3[1:2], ',') AS topics,
    concat_ws('; ', CASE WHEN NOT verdict BETWEEN 0 AND 3 THEN 'verdict: out of bounds' END, CASE WHEN v2 IS NULL THEN 'verdict: missing' END, CASE WHEN length(n1) > 60 THEN 'note: clipped' END, CASE WHEN n1 IS NULL THEN 'note: missing' END,
      CASE WHEN len(t1) > len(t2) THEN 'terms: not in the source ' || (len(t1) - len(t2)) END, CASE WHEN len(t2) > len(t3) THEN 'terms: repeated ' || (len(t2) - len(t3)) END, CASE WHEN len(t3) > 6 THEN 'terms: beyond the cap ' || (len(t3) - 6) END,
      CASE WHEN len(p1) > len(p2) THEN 'topics: not of topics ' || (len(p1) - len(p2)) END, CASE WHEN len(p2) > len(p3) THEN 'topics: repeated ' || (len(p2) - len(p3)) END, CASE WHEN len(p3) > 2 THEN 'topics: beyond the cap ' || (len(p3) - 2) END) AS faults,
    v2 IS NOT NULL AND n1 IS NOT NULL AS is_valid FROM c""")
def checked_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    ws = F.regexp_extract_all("title", F.lit("([A-Za-z]+)"), F.lit(1))
    terms = F.concat(F.slice(ws, 2, 8), F.array(F.lit("zzqqy"), F.upper(F.get(ws, F.lit(1)))))
    topics = F.array(F.upper("publisher"), F.col("publisher"), F.lit("src0"), F.lit("src1"), F.lit("src2"), F.lit("nowhere"))
    rows = i.select("id", "title", (F.col("id") % 6 - 1).alias("verdict"), F.when(F.col("id") % 11 != 0, F.col("title")).alias("note"), F.filter(terms, lambda x: x.isNotNull()).alias("terms"), F.filter(topics, lambda x: x.isNotNull()).alias("topics"))
    known = read(spark, sf_dir, "documents").select(F.lower("source").alias("value")).where("value is not null").distinct()
    d = validated(rows, SCHEMA, {"topics": known}, "title")
    return d.select("id", "verdict", "note", F.array_join("terms", ",").alias("terms"), F.array_join("topics", ",").alias("topics"), F.array_join("faults", "; ").alias("faults"), "is_valid")
