"""Product queries: audits, heat maps, insights, quotas, guards, signatures, batches and review views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import facets, windows
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import _RANKED, GRADED_SQL, graded, rules, subject_scores
from quillstream.sources.tables import ITEMS_SQL, items, read

_SUBJ = f"{_RANKED}, sub AS (SELECT id, bucket AS subject FROM ranked WHERE rank = 1)"


def first_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.leading_buckets(subject_scores(spark, sf_dir), least=2.5, most=1).select("id", F.col("bucket").alias("subject"))


@query(f"""{_SUBJ} SELECT subject, count(*) AS n, count(*) FILTER (WHERE day >= 23) AS last7, max(day) AS last_day, CASE WHEN count(*) = 0 THEN 0 WHEN count(*) <= 2 THEN 1 WHEN count(*) <= 5 THEN 2 WHEN count(*) <= 10 THEN 3 ELSE 4 END AS heat FROM sub JOIN items USING (id) GROUP BY subject""")
def syllabus_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = first_subjects(spark, sf_dir).join(items(spark, sf_dir).select("id", "day"), "id")
    h = d.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("day") >= 23).alias("last7"), F.max("day").alias("last_day"))
    return h.withColumn("heat", facets.heat(F.col("n")))


@query(f"""{_SUBJ}, c AS (SELECT day, subject, count(*) AS n FROM sub JOIN items USING (id) GROUP BY ALL), k AS (SELECT DISTINCT day, s AS subject FROM items, (VALUES ('economy'), ('polity'), ('science'), ('world'), ('culture')) v(s))
  SELECT day, subject, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (day, subject)""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("id", "day")
    c = first_subjects(spark, sf_dir).join(i, "id").groupBy("day", "subject").agg(F.count(F.lit(1)).alias("n"))
    every = i.select("day").distinct().withColumn("subject", F.explode(F.array(*map(F.lit, ("economy", "polity", "science", "world", "culture")))))
    return every.join(c, ["day", "subject"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""{GRADED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, id) AS rn FROM g), v AS (SELECT day, id, rn, CASE WHEN rn <= 2 THEN 'top' WHEN rn <= 5 THEN 'prelims' WHEN rn <= 6 THEN 'more' END AS tier FROM r) SELECT day, id, tier, row_number() OVER (PARTITION BY day, tier ORDER BY rn) AS place FROM v WHERE tier IS NOT NULL""")
def quota_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.top_n(graded(spark, sf_dir), ["day"], [F.desc("score"), F.col("id")], 6)
    r = r.withColumn("tier", F.when(F.col("rank") <= 2, "top").when(F.col("rank") <= 5, "prelims").otherwise("more"))
    return r.select("day", "id", "tier", F.row_number().over(Window.partitionBy("day", "tier").orderBy("rank")).cast("long").alias("place"))


@query(f"""{GRADED_SQL}, p AS (SELECT lower(title) AS k, count(DISTINCT publisher) AS pubs FROM g GROUP BY 1), z AS (SELECT g.id, g.day, CASE grade WHEN 'NOTE' THEN 3 WHEN 'SKIM' THEN 2 WHEN 'READ' THEN 1 ELSE 0 END AS gr, score, pubs FROM g JOIN p ON k = lower(title)),
  o AS (SELECT id, row_number() OVER (ORDER BY gr DESC, score DESC, pubs DESC, id) AS by_grade, row_number() OVER (ORDER BY round(score + 0.4 * pubs, 4) DESC, id) AS by_period FROM z) SELECT * FROM o""")
def sorted_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir)
    pubs = g.groupBy(F.lower("title").alias("k")).agg(F.countDistinct("publisher").alias("pubs"))
    s = g.join(pubs, F.lower("title") == F.col("k")).withColumn("gr", F.when(F.col("grade") == "NOTE", 3).when(F.col("grade") == "SKIM", 2).when(F.col("grade") == "READ", 1).otherwise(0))
    s = s.withColumn("period", F.round(F.col("score") + 0.4 * F.col("pubs"), 4))
    s = windows.places(s, [-F.col("gr"), -F.floor(F.col("score") * 100)], [F.desc("gr"), F.desc("score"), F.desc("pubs"), F.col("id")], "by_grade")
    return windows.places(s, [-F.floor(F.col("period") * 100)], [F.desc("period"), F.col("id")], "by_period").select("id", "by_grade", "by_period")


_FIG = "SELECT DISTINCT {} AS k, replace(unnest(regexp_extract_all({}, '[0-9]+(?:,[0-9]{{2,3}})*(?:\\.[0-9]+)?')), ',', '') AS n FROM {}"


@query(f"""WITH c AS ({_FIG.format("conv_id", "text", "conversations WHERE turn % 2 = 1")}), s AS ({_FIG.format("conv_id", "text", "conversations WHERE turn % 2 = 0")})
  SELECT k AS conv_id, count(*) AS figures, count(*) FILTER (WHERE NOT (regexp_matches(n, '^[0-9]+$') AND length(n) <= 2 AND CAST(n AS DOUBLE) <= 12) AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = c.k AND s.n = c.n)) AS ungrounded FROM c GROUP BY 1""")
def fact_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures in answers that the rest of the conversation does not have; small whole numbers are allowed."""
    own = F.col("turn") % 2 == 1
    n = read(spark, sf_dir, "conversations").select("conv_id", own.alias("own"), F.explode(t.numbers(F.col("text"))).alias("n")).distinct()
    c, s = n.where("own").drop("own"), n.where("not own").select("conv_id", "n", F.lit(True).alias("known"))
    small = F.col("n").rlike("^[0-9]{1,2}$") & (F.col("n").cast("double") <= 12)
    return c.join(s, ["conv_id", "n"], "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("figures"), F.count_if(~small & F.col("known").isNull()).alias("ungrounded"))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT day, id // 4096 AS part, sha1(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS s, count(*) AS n FROM items GROUP BY ALL)
  SELECT day, sha1(string_agg(s, ',' ORDER BY part)) AS signature, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY day""")
def day_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature over signatures of parts of at most 4,096 ids, so that no day's ids are gathered."""
    signed = lambda c: F.sha1(F.array_join(c, ","))
    p = items(spark, sf_dir).groupBy("day", F.expr("id div 4096").alias("part")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    p = p.select("day", "part", signed(F.col("ids").cast("array<string>")).alias("s"), F.size("ids").alias("n"))
    d = p.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("part", "s"))).alias("parts"), F.sum("n").alias("n"))
    return d.select("day", signed(F.col("parts.s")).alias("signature"), "n")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) SELECT user_id, CAST(floor(rn / 40) AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY ALL""")
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor(rn / 40).alias("batch"))
    return e.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH m AS (SELECT user_id, event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, date_diff('hour', last, TIMESTAMP '2024-02-01 00:00:00') >= 6 AS due FROM m""")
def retry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    hours = F.expr("timestampdiff(HOUR, date_trunc('hour', last), timestamp_ntz'2024-02-01 00:00:00')")
    return e.select("user_id", "event_type", "n", (hours >= 6).alias("due"))


@query("""SELECT event_type AS source, count(*) AS runs, count(DISTINCT user_id) AS readers, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, round(avg(value), 4) AS mean, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("user_id").alias("readers"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.round(F.avg("value"), 4).alias("mean"), F.sum(k).alias("k")
    )


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT id, w, pos FROM (SELECT id, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS w, generate_subscripts(regexp_split_to_array(lower(title), '[^a-z0-9]+'), 1) AS pos FROM items)),
  g(w, meaning) AS (VALUES ('the', 'article'), ('of', 'genitive'), ('and', 'conjunction'), ('der', 'Artikel')), m AS (SELECT id, w, meaning, row_number() OVER (PARTITION BY id, w ORDER BY pos) AS rn, pos FROM w JOIN g USING (w)) SELECT id, w AS term, meaning, CAST(pos AS BIGINT) AS place FROM m WHERE rn = 1""")
def glossary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.broadcast(spark.createDataFrame([("the", "article"), ("of", "genitive"), ("and", "conjunction"), ("der", "Artikel")], "term string, meaning string"))
    w = items(spark, sf_dir).select("id", F.posexplode(F.split(F.lower("title"), "[^a-z0-9]+")).alias("p", "term"))
    return w.join(g, "term").groupBy("id", "term", "meaning").agg((F.min("p") + 1).cast("long").alias("place"))


@query("""WITH e AS (SELECT user_id, event_type AS card, CAST(ts AS DATE) AS d, event_id FROM events), l AS (SELECT user_id, card, max(d) AS last, count(*) AS seen FROM e GROUP BY ALL),
  q AS (SELECT *, date_diff('day', last, DATE '2024-02-01') > seen AS overdue FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY overdue DESC, last, card) AS rn FROM q) SELECT user_id, card, overdue, rn AS place FROM r WHERE rn <= 3""")
def flashcard_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("card")).agg(F.max(F.to_date("ts")).alias("last"), F.count(F.lit(1)).alias("seen"))
    q = last.withColumn("overdue", F.datediff(F.lit("2024-02-01"), "last") > F.col("seen"))
    return windows.top_n(q, ["user_id"], [F.desc("overdue"), F.col("last"), F.col("card")], 3).select("user_id", "card", "overdue", F.col("rank").cast("long").alias("place"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '/([0-9]+)(\\.html|/|\\?|#|$)', 1) AS code, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS part FROM pages WHERE url IS NOT NULL) SELECT page_id, code, part, code <> '' AND length(code) = 3 AS dated FROM p""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").where("url is not null").select("page_id", F.regexp_extract("url", r"/([0-9]+)(\.html|/|\?|#|$)", 1).alias("code"), F.regexp_extract("url", r"[?&]page=([0-9]+)", 1).alias("part"))
    return p.withColumn("dated", (F.col("code") != "") & (F.length("code") == 3))


@query(f"""{_SUBJ}, k AS (SELECT subject, publisher, count(*) AS n FROM sub JOIN items USING (id) GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY publisher) AS total FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY n DESC, subject) AS rn FROM s WHERE n >= 0.34 * total)
  SELECT publisher, subject, n, round(n / total, 4) AS share FROM r WHERE rn <= 2""")
def topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = first_subjects(spark, sf_dir).join(items(spark, sf_dir).select("id", "publisher"), "id").groupBy("subject", "publisher").agg(F.count(F.lit(1)).alias("n"))
    k = k.withColumn("total", F.sum("n").over(Window.partitionBy("publisher"))).where("n >= 0.34 * total")
    return windows.top_n(k, ["publisher"], [F.desc("n"), F.col("subject")], 2).select("publisher", "subject", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("""SELECT o_orderkey, to_json(struct_pack(s := o_orderstatus, p := o_orderpriority)) AS doc FROM orders""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))).alias("doc"))
