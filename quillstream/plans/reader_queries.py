"""Story tables and readers' views: stories of reports, rejections, radar, mock, dossiers, notebook, freshness, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import memory, rules, stories, windows
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import _RANKED, _SCORES, _TAG_SQL, GRADED_SQL, TAGS, WATCH, graded, subject_scores
from quillstream.sources.tables import ITEMS_SQL, items, read, tokenised

TIER_RANKS = {"official": 7, "premium": 6, "quality": 5, "general": 3}
_TIER_RANK = "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TIER_RANKS.items()) + " ELSE 0 END"
_TAG_LIST = ", ".join(f"CASE WHEN regexp_matches(title, '{p}') THEN '{n}' END" for n, p in TAGS.items())


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with score, subjects in order, and tags."""
    ranked = rules.leading_buckets(subject_scores(spark, sf_dir), least=2.5)
    subjects = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "bucket"))), lambda x: x["bucket"]).alias("subjects"))
    g = graded(spark, sf_dir).select("id", "score")
    i = items(spark, sf_dir).withColumn("tags", rules.matching_tags(F.col("title"), TAGS))
    return i.join(g, "id").join(subjects, "id", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def _listed(d: DataFrame) -> DataFrame:
    """Arrays as text, so that rows compare."""
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in ("publishers", "subjects", "tags", "days") else F.col(c) for c in d.columns]
    return d.select(*joined).withColumn("base", F.round("base", 4))


@query(f"""{GRADED_SQL}, rk AS (SELECT id, bucket, row_number() OVER (PARTITION BY id ORDER BY score DESC, bucket) AS rank FROM scores WHERE score >= 2.5),
  m AS (SELECT i.*, g.score, i.id - i.id % 7 AS story, {_TIER_RANK.replace("tier", "i.tier")} AS trank, trim(coalesce(i.body, ''), ' ') AS summary FROM items i JOIN g ON g.id = i.id),
  o AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY trank DESC, (summary = '')::INT, day, id) AS rn FROM m),
  pub AS (SELECT story, string_agg(publisher, ',' ORDER BY rn) AS publishers FROM (SELECT story, publisher, min(rn) AS rn FROM o WHERE publisher IS NOT NULL GROUP BY ALL) GROUP BY story),
  sw AS (SELECT story, bucket, sum(CASE rank WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END) AS w FROM m JOIN rk ON rk.id = m.id WHERE rank <= 3 GROUP BY ALL),
  sub AS (SELECT story, string_agg(bucket, ',' ORDER BY r) AS subjects FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY w DESC, bucket) AS r FROM sw) WHERE r <= 3 GROUP BY story),
  tw AS (SELECT story, t, count(*) AS w FROM (SELECT story, unnest([{_TAG_LIST}]) AS t FROM m) WHERE t IS NOT NULL GROUP BY ALL),
  tg AS (SELECT story, string_agg(t, ',' ORDER BY r) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY w DESC, t) AS r FROM tw) WHERE r <= 6 GROUP BY story),
  a AS (SELECT story, count(*) AS n_items, max(score) AS best, count(*) FILTER (WHERE score <= 0) AS rejected, string_agg(DISTINCT day, ',' ORDER BY day) AS days, bool_and(kind = 'editorial') AS is_editorial, bool_or(lang <> 'en') AS any_foreign FROM m GROUP BY story)
  SELECT a.story, o.id AS lead, o.title, left(o.summary, 700) AS summary, n_items, coalesce(publishers, '') AS publishers, coalesce(subjects, '') AS subjects, coalesce(tags, '') AS tags, round(CASE WHEN 2 * rejected > n_items THEN 0.0 ELSE best END, 4) AS base, days, is_editorial, any_foreign
  FROM a JOIN o ON o.story = a.story AND o.rn = 1 LEFT JOIN pub ON pub.story = a.story LEFT JOIN sub ON sub.story = a.story LEFT JOIN tg ON tg.story = a.story""")
def story_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of given members."""
    return _listed(stories.aggregated(reports(spark, sf_dir).withColumn("story", F.col("id") - F.col("id") % 7), TIER_RANKS))


@query()
def story_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the reports that were clustered together."""
    of = memory.assigned(tokenised(spark, sf_dir)).select("id", "story")
    return _listed(stories.aggregated(reports(spark, sf_dir).join(of, "id"), TIER_RANKS))


@query(f"""{_SCORES}, f AS (SELECT id FROM items WHERE lang <> 'en') SELECT id, CASE WHEN id IN (SELECT id FROM f) AND bucket IN ('economy', 'polity') THEN 'world' ELSE bucket END AS bucket, round(sum(score), 4) AS score FROM scores GROUP BY ALL""")
def foreign_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    foreign = items(spark, sf_dir).where("lang <> 'en'").select("id")
    return stories.moved(subject_scores(spark, sf_dir), foreign, ("economy", "polity"), "world")


@query(f"""{GRADED_SQL}, r AS (SELECT DISTINCT id FROM scores WHERE score >= 2.5)
  SELECT id, CASE WHEN publisher = 'src9' THEN 'blocked outlet' WHEN length(regexp_replace(title, '[^\\x{{0980}}-\\x{{0DFF}}\\x{{0590}}-\\x{{06FF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) >= 3 THEN 'other script' WHEN day > 20 THEN 'dated' WHEN score <= 0 THEN 'noise' WHEN id NOT IN (SELECT id FROM r) THEN 'no subject' END AS reason FROM g""")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = subject_scores(spark, sf_dir).where("score >= 2.5").select("id", F.lit(True).alias("known")).distinct()
    g = graded(spark, sf_dir).join(known, "id", "left")
    odd = F.length(F.regexp_replace("title", r"[^ঀ-෿֐-ۿ一-鿿]", "")) >= 3
    reasons = [("blocked outlet", F.col("publisher") == "src9"), ("other script", odd), ("dated", F.col("day") > 20), ("noise", F.col("score") <= 0), ("no subject", F.col("known").isNull())]
    return g.select("id", stories.rejection(reasons).alias("reason"))


@query(f"""{GRADED_SQL}, c AS (SELECT *, {_TAG_SQL} AS tags, {" AND ".join(f"regexp_matches(title, '{p}')" for p in WATCH)} AS watched FROM g WHERE grade IN ('NOTE', 'SKIM')),
  r AS (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY score DESC, id) AS place FROM c WHERE tags > 0 OR watched) SELECT * FROM r WHERE place <= 4""")
def exam_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best cards of each day that have a tag or are watched."""
    g = graded(spark, sf_dir).where("grade in ('NOTE', 'SKIM')")
    told = (F.size(rules.matching_tags(F.col("title"), TAGS)) > 0) | rules.all_groups(F.col("title"), WATCH)
    return windows.top_n(g.where(told), ["day"], [F.desc("score"), F.col("id")], 4).select("day", "id", F.col("rank").cast("long").alias("place"))


@query(f"""WITH {ITEMS_SQL}, q AS (SELECT id, day, EXISTS (SELECT 1 FROM labels WHERE doc_id = id) AS seen FROM items WHERE day >= 23), r AS (SELECT *, row_number() OVER (ORDER BY seen, day DESC, id) AS place FROM q) SELECT id, day, seen, place FROM r WHERE place <= 50""")
def weekly_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty questions of the last seven days, unseen ones first."""
    seen = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("s")).distinct()
    q = items(spark, sf_dir).where("day >= 23").select("id", "day").join(seen, "id", "left").withColumn("seen", F.coalesce("s", F.lit(False))).drop("s")
    best = q.orderBy("seen", F.desc("day"), "id").limit(50)
    return best.withColumn("place", F.expr("row_number() over (order by seen, day desc, id)").cast("long")).select("id", "day", "seen", "place")


@query(f"""WITH {ITEMS_SQL}, f AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND doc_id % 3 = 0), d AS (SELECT publisher, count(*) AS n, max(day) AS last_day, bool_or(contains(lower(publisher || ' ' || title), 'the')) AS fits FROM items WHERE publisher IS NOT NULL GROUP BY 1)
  SELECT publisher, n, last_day, publisher IN (SELECT source FROM f) AS followed, last_day >= 28 AS is_new, row_number() OVER (ORDER BY publisher IN (SELECT source FROM f) DESC, last_day DESC, n DESC, publisher) AS place FROM d WHERE fits""")
def dossier_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers whose name or titles hold a word: followed ones first, then by their last day and size."""
    good = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0 and doc_id % 3 = 0").select("doc_id")
    followed = read(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select(F.col("source").alias("publisher"), F.lit(True).alias("f")).distinct()
    fits = F.bool_or(F.contains(F.lower(F.concat("publisher", F.lit(" "), "title")), F.lit("the")))
    d = items(spark, sf_dir).where("publisher is not null").groupBy("publisher").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last_day"), fits.alias("fits")).where("fits")
    d = d.join(followed, "publisher", "left").withColumn("followed", F.coalesce("f", F.lit(False)))
    d = windows.places(d, [(~F.col("followed")).cast("int"), -F.col("last_day")], [F.desc("n"), F.col("publisher")], "place")
    return d.select("publisher", "n", "last_day", "followed", (F.col("last_day") >= 28).alias("is_new"), "place")


_REVIEW = "SELECT user_id, event_type AS question, event_id, CAST(floor(value / 25) AS BIGINT) % 4 = 0 AS wrong FROM events"


@query(f"""WITH r AS ({_REVIEW}), g AS (SELECT user_id, question, arg_max(wrong, event_id) AS last_wrong, max(event_id) FILTER (WHERE NOT wrong) AS last_right FROM r GROUP BY ALL)
  SELECT g.user_id, g.question, count(*) AS misses, round(CAST(count(*) AS DOUBLE) * CAST(-0.66 AS DOUBLE), 2) AS marks FROM g JOIN r ON r.user_id = g.user_id AND r.question = g.question AND r.wrong AND (last_right IS NULL OR r.event_id > last_right) WHERE last_wrong GROUP BY ALL""")
def mistake_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered wrong last, with the misses since they were last right."""
    r = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("question"), "event_id", (F.floor(F.col("value") / 25) % 4 == 0).alias("wrong"))
    g = r.groupBy("user_id", "question").agg(F.max_by("wrong", "event_id").alias("last_wrong"), F.max(F.when(~F.col("wrong"), F.col("event_id"))).alias("last_right")).where("last_wrong")
    m = r.where("wrong").join(g, ["user_id", "question"]).where("last_right is null or event_id > last_right").groupBy("user_id", "question").agg(F.count(F.lit(1)).alias("misses"))
    return m.withColumn("marks", F.round(F.col("misses") * -0.66, 2))


@query("""WITH u AS (SELECT user_id, max(ts) AS updated FROM events GROUP BY 1) SELECT user_id, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated FROM u WHERE updated > TIMESTAMP '2024-01-15 00:00:00'""")
def fresh_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was updated since a moment; partitions that ended before it need not be read."""
    u = read(spark, sf_dir, "events").where("ts > timestamp_ntz'2024-01-15 00:00:00'").groupBy("user_id").agg(F.max("ts").alias("updated"))
    return u.select("user_id", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query(f"""{GRADED_SQL} SELECT 'items' AS key, CAST(count(*) AS VARCHAR) AS value FROM g UNION ALL SELECT 'days', CAST(min(day) AS VARCHAR) || '-' || CAST(max(day) AS VARCHAR) FROM g UNION ALL SELECT 'grade ' || grade, CAST(count(*) AS VARCHAR) FROM g GROUP BY grade
  UNION ALL SELECT 'kind ' || kind, CAST(count(*) AS VARCHAR) FROM g GROUP BY kind UNION ALL SELECT 'outlets', CAST(count(DISTINCT publisher) AS VARCHAR) FROM g""")
def meta_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ranges and labels of the whole store as key and value; grades and kinds are counted in one pass each."""
    g = graded(spark, sf_dir).select("day", "grade", "kind", "publisher")
    parts = g.groupBy("grade", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    text = lambda c: c.cast("string")
    whole = parts.agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    rows = whole.select(F.expr("inline(array(struct('items' as key, string(n) as value), struct('days' as key, concat(a, '-', b) as value)))"))
    for c in ("grade", "kind"):
        rows = rows.union(parts.groupBy(c).agg(F.sum("n").alias("n")).select(F.concat(F.lit(c + " "), c), text(F.col("n"))))
    return rows.union(g.agg(F.countDistinct("publisher").alias("n")).select(F.lit("outlets"), text(F.col("n"))))


@query("""WITH t AS (SELECT user_id AS source, event_id % 5 AS step, max(value) > 60 AS ok FROM events GROUP BY ALL), a AS (SELECT DISTINCT user_id AS source, user_id % 3 AS active FROM events),
  j AS (SELECT a.source, active, step, ok FROM a LEFT JOIN t ON t.source = a.source AND step >= active), u AS (SELECT source, active, min(step) FILTER (WHERE ok) AS used FROM j GROUP BY ALL)
  SELECT u.source, u.active, used, count(step) FILTER (WHERE NOT ok AND (used IS NULL OR step < used)) AS failed FROM u JOIN j USING (source, active) GROUP BY ALL""")
def fallback_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    attempts = e.groupBy(F.col("user_id").alias("source"), (F.col("event_id") % 5).alias("step")).agg((F.max("value") > 60).alias("ok"))
    return stories.walked(attempts, e.select(F.col("user_id").alias("source"), (F.col("user_id") % 3).alias("active")).distinct())
