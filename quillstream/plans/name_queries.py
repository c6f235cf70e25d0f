"""Names of a gazetteer, read from a table, in the order in which titles and summaries have them, and which names go together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import names
from quillstream.plans.registry import query
from quillstream.sources.tables import ITEMS_SQL, items, read

_FIELD = "concat(title, ' ', left(coalesce(body, ''), 400))"
TITLES = ["of", "the", "mr", "la", "der"]
#: The benchmark's words as a gazetteer: long ones are places, two in a row bodies, three in a row schemes.
_NAMES_SQL = """bw AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
  bi AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM bw),
  gaz AS (SELECT name, min(kind) AS kind FROM (SELECT w[i] AS name, 'place' AS kind FROM bi WHERE length(w[i]) >= 7 UNION ALL SELECT w[i] || ' ' || w[i + 1], 'body' FROM bi WHERE i % 2 = 1 AND i < len(w)
    UNION ALL SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 'scheme' FROM bi WHERE i % 3 = 1 AND i + 1 < len(w)) GROUP BY name)"""
_HITS_SQL = f"""{_NAMES_SQL}, iw AS (SELECT id, regexp_extract_all(title || ' ' || substr(coalesce(body, ''), 1, 400), '[A-Za-z0-9]+') AS w FROM items),
  runs AS (SELECT id, i - 1 AS start, i - 1 + n AS stop, lower(array_to_string(w[i:i + n - 1], ' ')) AS run FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM iw), (VALUES (1), (2), (3)) v(n) WHERE i + n - 1 <= len(w)),
  m AS (SELECT id, start, max(stop) AS stop, arg_max(name, stop) AS name, arg_max(kind, stop) AS kind FROM runs JOIN gaz ON run = name GROUP BY id, start),
  hits AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.id = b.id AND b.start < a.start AND b.stop >= a.stop))"""


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark").where("text is not null").select(F.transform(names.words_of(F.col("text")), F.lower).alias("w")).where("size(w) > 0")
    i = b.select("w", F.posexplode("w").alias("i", "one"))
    run = lambda n: F.array_join(F.slice("w", F.col("i") + 1, F.lit(n)), " ").alias("name")
    long = i.where(F.length("one") >= 7).select(F.col("one").alias("name"), F.lit("place").alias("kind"))
    two = i.where((F.col("i") % 2 == 0) & (F.col("i") + 2 <= F.size("w"))).select(run(2), F.lit("body").alias("kind"))
    three = i.where((F.col("i") % 3 == 0) & (F.col("i") + 3 <= F.size("w"))).select(run(3), F.lit("scheme").alias("kind"))
    return long.union(two).union(three).groupBy("name").agg(F.min("kind").alias("kind"))


@query(f"WITH {ITEMS_SQL}, {_HITS_SQL}, f AS (SELECT id, name, kind, min(start) AS start FROM hits GROUP BY ALL) SELECT id, row_number() OVER (PARTITION BY id ORDER BY start, name) AS place, name, kind FROM f")
def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names.hits(items(spark, sf_dir), _FIELD, gazetteer(spark, sf_dir))
    return names.in_order(found).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {ITEMS_SQL}, {_HITS_SQL}, nx AS (SELECT *, lead(name) OVER w AS partner, lead(kind) OVER w AS next_kind, lead(start) OVER w AS next_start FROM hits WINDOW w AS (PARTITION BY id ORDER BY start)),
  c AS (SELECT name, partner, count(DISTINCT id) AS n FROM nx WHERE kind = 'place' AND next_kind = 'body' AND next_start - stop <= 8 GROUP BY ALL)
  SELECT name, partner, n, rivals FROM (SELECT *, count(*) OVER (PARTITION BY name) - 1 AS rivals, row_number() OVER (PARTITION BY name ORDER BY n DESC, partner) AS rn FROM c) WHERE rn = 1""")
def name_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body that most texts name next to a place."""
    found = names.hits(items(spark, sf_dir), _FIELD, gazetteer(spark, sf_dir))
    return names.partners(names.neighbours(found, "place", "body", 8))


@query(f"""WITH {ITEMS_SQL}, iw AS (SELECT id, regexp_extract_all(title || ' ' || substr(coalesce(body, ''), 1, 400), '[A-Za-z0-9]+') AS w FROM items),
  s AS (SELECT id, w, i, list_transform([1, 2, 3], lambda k: coalesce(regexp_matches(w[i + k], '^[A-Z]'), false)) AS c FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM iw) WHERE lower(w[i]) IN ({", ".join(f"'{x}'" for x in TITLES)})),
  n AS (SELECT *, CASE WHEN NOT c[1] THEN 0 WHEN NOT c[2] THEN 1 WHEN NOT c[3] THEN 2 ELSE 3 END AS n FROM s)
  SELECT id, i - 1 AS start, array_to_string(w[i + 1:i + n], ' ') AS name FROM n WHERE n > 0""")
def titled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = names.titled(items(spark, sf_dir), _FIELD, TITLES)
    return d.select("id", F.col("start").cast("long").alias("start"), "name")
