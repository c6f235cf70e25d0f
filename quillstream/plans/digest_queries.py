"""Daily digests and what is made from them: clusters, tiers, folds, audits, focus, repetition, practice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import clusters, digest, memory, products, rules, windows
from quillstream.operators import similarity as sim
from quillstream.operators.similarity import durable
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import GRADED_SQL, SUBJECTS, _terms_sql, graded, subject_scores
from quillstream.sources.tables import items, read, tokenised

_NEWS = f"""{GRADED_SQL}, e AS ({_terms_sql([("event", "on", 1.5), ("event", "thion", 2.0), ("event", "it", 1.0), ("talk", "as", 1.0), ("talk", "be", 1.0)], {"title": 1.0})}),
  x AS (SELECT g.*, coalesce(max(e.score) FILTER (WHERE bucket = 'event'), 0) AS event, coalesce(max(e.score) FILTER (WHERE bucket = 'talk'), 0) AS talk FROM g LEFT JOIN e USING (id) GROUP BY ALL),
  n AS (SELECT id, day, round(score + 0.6 * least(event, 4.0) - 0.8 * talk, 4) AS bs, grade, event, talk FROM x WHERE kind = 'news' AND grade <> 'LOW'),
  r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY bs DESC, id) AS place FROM n)"""
_TIERS = f"""{_NEWS}, t AS (SELECT *, CASE WHEN NOT (bs >= 3.4 OR (place <= 3 AND bs >= 2.0)) THEN NULL WHEN bs >= 4.2 AND grade IN ('NOTE', 'SKIM') AND talk < 1 THEN 'top' WHEN bs >= 3.4 AND event >= 1.5 AND talk = 0 THEN 'prelims' ELSE 'more' END AS tier FROM r)"""


#: Stands for titles of a place's own routine.
_LOCAL = "^(The|Of|And) "


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir).where("kind = 'news' and grade <> 'LOW'")
    return digest.with_signals(g, digest.SIGNALS)


@query(f"{_TIERS} SELECT id, day, bs, place, tier FROM t WHERE tier IS NOT NULL")
def digest_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest.tiers(news(spark, sf_dir)).where("tier is not null")
    return d.select("id", "day", "bs", F.col("place").cast("long").alias("place"), "tier")


@query(f"""{_TIERS}, c AS ({_terms_sql(SUBJECTS, {"title": 2.0, "body": 1.0})}), f AS (SELECT id, arg_max(bucket, score * 1000 - ascii(bucket)) AS subject FROM (SELECT id, bucket, round(score, 4) AS score FROM c) GROUP BY id),
  q AS (SELECT t.id, t.day, subject, tier, bs FROM t JOIN f USING (id)), m AS (SELECT *, row_number() OVER (PARTITION BY day, subject ORDER BY bs DESC, id) AS rn FROM q WHERE tier IS NULL AND NOT EXISTS (SELECT 1 FROM q p WHERE p.day = q.day AND p.subject = q.subject AND p.tier IS NOT NULL))
  SELECT day, subject, id FROM m WHERE rn = 1""")
def coverage_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = subject_scores(spark, sf_dir).withColumn("score", F.round("score", 4)).withColumn("key", F.col("score") * 1000 - F.ascii("bucket"))
    s = s.groupBy("id").agg(F.max_by("bucket", "key").alias("subject"))
    return digest.coverage(digest.tiers(news(spark, sf_dir)).join(s, "id")).select("day", "subject", "id")


@query()
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and lines of each day, folded by event, with dense ranks: leads first, then what is folded into them."""
    d = durable(digest.tiers(news(spark, sf_dir)).where("tier is not null").select("id", "day", "bs", "tier"))  # read three times
    sets, same_day = sim.rarity_sets(tokenised(spark, sf_dir).select("id", "tokens"), among=d.select("id", "day"), block=["day"], least=0.25)
    f = clusters.folds(d.select("id", "day", F.col("bs").alias("score")), same_day, sets=sets)
    return digest.ranked(d.join(f, "id"))


@query()
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with a memory of three days over the whole history."""
    return memory.assigned(tokenised(spark, sf_dir)).select("id", "story")


@query("""WITH m AS (SELECT doc_id AS id, doc_id - doc_id % 7 AS story, CASE doc_id % 10 WHEN 0 THEN 'editorial' WHEN 1 THEN 'explained' ELSE 'news' END AS kind FROM documents WHERE doc_id IS NOT NULL),
  f AS (SELECT *, max(CASE WHEN id = story THEN kind END) OVER (PARTITION BY story) AS founder, min(id) OVER (PARTITION BY story, kind) AS first FROM m) SELECT id, kind, CASE WHEN kind = founder THEN story ELSE first END AS story FROM f""")
def split_mixed_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 10 == 0, "editorial").when(F.col("doc_id") % 10 == 1, "explained").otherwise("news")
    d = read(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), kind.alias("kind"), (F.col("doc_id") - F.col("doc_id") % 7).alias("story"))
    return clusters.split_by_kind(d)


@query(f"""{_TIERS}, v AS (SELECT t.id, t.day, tier AS rules, CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN 'more' ELSE tier END AS ai FROM t LEFT JOIN labels ON doc_id = t.id)
  SELECT day, coalesce(rules, 'out') AS rules, coalesce(ai, 'out') AS ai, count(*) AS n FROM v GROUP BY ALL""")
def digest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    d = digest.tiers(news(spark, sf_dir)).select("id", "day", "tier").join(lab, "id", "left")
    ai = F.when(F.col("quality") == 0, None).when(F.col("toxic") == 1, "more").otherwise(F.col("tier"))
    return d.groupBy("day", F.coalesce("tier", F.lit("out")).alias("rules"), F.coalesce(ai, F.lit("out")).alias("ai")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_NEWS}, p AS (SELECT lower(title) AS k, count(DISTINCT publisher) AS pubs FROM items GROUP BY 1), y AS (SELECT x.*, pubs, CASE WHEN quality = 1 AND toxic = 0 THEN 2 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END AS up FROM x JOIN p ON k = lower(title) LEFT JOIN labels ON doc_id = id)
  SELECT id, round(CASE up WHEN 2 THEN 3.6 WHEN 1 THEN 1.6 WHEN 0 THEN 0.0 ELSE CASE grade WHEN 'NOTE' THEN 4.8 WHEN 'SKIM' THEN 3.2 WHEN 'READ' THEN 1.6 ELSE 0.5 END END + 0.5 * least(event, 3.0) - 0.6 * least(talk, 2.0) + 0.12 * pow(greatest(1, least(pubs, 10)) - 1, 0.8)
    + CASE tier WHEN 'official' THEN 0.3 ELSE 0 END - CASE WHEN contains(title, '?') THEN 0.6 ELSE 0 END - CASE WHEN contains(title, '!!') THEN 4.0 WHEN regexp_matches(title, '{_LOCAL}') THEN 2.0 ELSE 0 END - CASE WHEN contains(title, ' | ') THEN 1.5 ELSE 0 END, 4) AS value,
    CAST(CASE kind WHEN 'editorial' THEN 6 WHEN 'explained' THEN 5 ELSE 3 END + CASE WHEN grade = 'NOTE' THEN 1 ELSE 0 END + CASE WHEN pubs >= 5 THEN 1 ELSE 0 END AS INTEGER) AS minutes FROM y""")
def focus_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = digest.with_signals(graded(spark, sf_dir), digest.SIGNALS)
    pubs = items(spark, sf_dir).groupBy(F.lower("title").alias("k")).agg(F.countDistinct("publisher").alias("pubs"))
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).alias("up"))
    d = g.join(pubs, F.lower("title") == F.col("k")).join(lab, "id", "left")
    c = F.col
    title = c("title")
    facts = {"event": c("event"), "talk": c("talk"), "official": c("tier") == "official", "soft": title.contains("?"), "notice": title.contains("!!"), "local": title.rlike(_LOCAL), "routine": title.contains(" | ")}
    value = products.focus_value(c("up"), c("grade"), c("pubs"), facts)
    return d.select("id", F.round(value, 4).alias("value"), products.reading_minutes(c("kind"), c("grade"), c("pubs")).alias("minutes"))


@query()
def focus_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits in thirty minutes a day, best value first, passing over what no longer fits."""
    v = focus_value(spark, sf_dir).join(items(spark, sf_dir).select("id", "day"), "id").withColumn("worse", -F.col("value"))
    return clusters.skip_ahead_budget(v, ["day"], ["worse", "id"], "minutes", 30).drop("worse")


@query()
def focus_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pick's part in a day's focus: cards; what is attached to a card; lines and facts of worth; twins of these."""
    d = durable(digest.tiers(news(spark, sf_dir)).where("tier is not null").select("id", "day", "tier").join(focus_value(spark, sf_dir).select("id", "value"), "id"))  # read four times
    sets, pairs = sim.rarity_sets(tokenised(spark, sf_dir).select("id", "tokens"), among=d.select("id", "day"), block=["day"], least=products.ATTACHED_FROM)
    return products.focus_layout(d, pairs, sets)


@query("""WITH f AS (SELECT conv_id, turn, text, regexp_extract(text, '[0-9]+(?:\\.[0-9]+)?', 0) AS n FROM conversations WHERE text IS NOT NULL),
  o AS (SELECT *, coalesce(lead(n) OVER w, first_value(n) OVER w) AS other FROM f WHERE n <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, true AS holds, text AS statement FROM o UNION ALL SELECT conv_id, turn, false, substr(text, 1, instr(text, n) - 1) || other || substr(text, instr(text, n) + length(n)) FROM o WHERE other <> n""")
def swapped_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    return products.swapped_statements(s, ["conv_id"], "turn")


@query()
def srs_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced repetition: each reader's cards (event types) after all reviews."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("card"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("day"), F.col("event_id").alias("at"), (F.floor(F.col("value") / 25) % 4 + 1).cast("int").alias("grade"))
    return products.srs_state(e, ["user_id", "card"])


@query()
def cloze_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("text is not null")
    s = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.posexplode(t.sentences(F.col("text"), 20)).alias("place", "text"))
    names = spark.createDataFrame([("the",), ("that",), ("with",), ("this",), ("from",), ("have",)], "name string")
    return products.cloze(s, names)


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS running, count(*) OVER (PARTITION BY user_id) AS days FROM d)
  SELECT user_id, strftime(d, '%Y-%m-%d') AS day, n, CAST(running AS BIGINT) AS running, CASE WHEN running <= 20 THEN 'core' WHEN running <= 60 THEN 'extra' ELSE 'optional' END AS phase FROM c""")
def study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("running", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("phase", F.when(F.col("running") <= 20, "core").when(F.col("running") <= 60, "extra").otherwise("optional"))


@query(f"""{GRADED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY CAST(floor(day / 7) AS BIGINT), day ORDER BY score DESC, id) AS rn FROM g WHERE grade <> 'LOW')
  SELECT CAST(floor(day / 7) AS BIGINT) AS week, count(*) AS n, string_agg(id, ',' ORDER BY score DESC, id) AS ids FROM r WHERE rn <= 2 GROUP BY 1""")
def weekly_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = windows.top_n(graded(spark, sf_dir).where("grade <> 'LOW'"), ["day"], [F.desc("score"), F.col("id")], 2)
    w = top.groupBy(F.floor(F.col("day") / 7).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("x"))
    return w.select("week", "n", F.array_join(F.transform("x", lambda e: e["id"]), ",").alias("ids"))
