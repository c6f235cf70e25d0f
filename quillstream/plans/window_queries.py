"""Aggregations, windows, quotas, trackers, activity and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import facets, search, windows
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import GRADED_SQL, graded
from quillstream.plans.text_queries import _STOP, TOKENS_SQL
from quillstream.sources.tables import ITEMS_SQL, items, read, tokenised


@query(f"""WITH {TOKENS_SQL}, k AS (SELECT id, string_agg(w, ' ' ORDER BY w) AS k FROM tok GROUP BY id), x AS (SELECT items.*, k FROM items JOIN k USING (id))
  SELECT k AS story, count(*) AS n_items, count(DISTINCT publisher) AS n_publishers, arg_max(id, CASE tier WHEN 'official' THEN 7 WHEN 'premium' THEN 6 WHEN 'quality' THEN 5 ELSE 3 END * CAST(1000000000000 AS BIGINT) - id) AS lead,
  min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, bool_and(kind = 'editorial') AS is_editorial, bool_or(lang <> 'en') AS any_foreign FROM x GROUP BY k""")
def story_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tokenised(spark, sf_dir).where(F.size("tokens") > 0).withColumn("story", F.array_join(F.array_sort("tokens"), " "))
    rank = F.when(F.col("tier") == "official", 7).when(F.col("tier") == "premium", 6).when(F.col("tier") == "quality", 5).otherwise(3)
    return x.groupBy("story").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("publisher").alias("n_publishers"), F.max_by("id", F.struct(rank, -F.col("id"))).alias("lead"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.countDistinct("day").alias("days"), F.bool_and(F.col("kind") == "editorial").alias("is_editorial"), F.bool_or(F.col("lang") != "en").alias("any_foreign"),
    )


@query("""WITH c AS (SELECT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal > 0 AS rich, c_custkey % 2 = 0 AS even FROM customer)
  SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM c WHERE rich AND even GROUP BY segment UNION ALL SELECT 'nation', nation, count(*) FROM c WHERE segment IN ('BUILDING', 'MACHINERY') AND even GROUP BY nation""")
def facet_counts_skip_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    ok = {"segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "nation": F.col("c_acctbal") > 0, "even": F.col("c_custkey") % 2 == 0}
    return facets.facet_counts(c, {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}, ok)


@query(f"""{GRADED_SQL} SELECT count(*) AS pool, count(*) FILTER (WHERE grade = 'NOTE') AS notes, count(DISTINCT publisher) AS outlets, count(*) FILTER (WHERE kind = 'editorial') AS editorials, min(day) AS first_day, max(day) AS last_day FROM g""")
def kpi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(F.col("grade") == "NOTE").alias("notes"), F.countDistinct("publisher").alias("outlets"), F.count_if(F.col("kind") == "editorial").alias("editorials"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


@query("""WITH c AS (SELECT n_nationkey AS k, count(*) FILTER (WHERE s_acctbal > 5000) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT r_name, n_name, n, CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 ELSE 4 END AS heat FROM c JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey""")
def coverage_with_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    d = facets.with_zeros(n, read(spark, sf_dir, "nation"), "n_nationkey")
    return d.join(F.broadcast(read(spark, sf_dir, "region")), d["n_regionkey"] == F.col("r_regionkey")).select("r_name", "n_name", "n", facets.heat(F.col("n")).alias("heat"))


@query(f"""WITH {TOKENS_SQL}, n AS (SELECT count(*) AS n FROM items) SELECT w AS token, count(*) AS df, round(ln((max(n) + 1.0) / (count(*) + 1.0)), 6) AS idf, round(ln(1 + max(n) / count(*)), 6) AS idf_summary FROM tok, n GROUP BY w""")
def df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstream.operators.similarity import frequencies

    d = tokenised(spark, sf_dir)
    n = d.count()
    return frequencies(d).select("token", "df", F.round(F.log((n + 1.0) / (F.col("df") + 1.0)), 6).alias("idf"), F.round(F.log(1 + n / F.col("df")), 6).alias("idf_summary"))


@query("""SELECT r_name AS area, n_name AS place, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY r_name) AS BIGINT) AS area_n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def places_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.broadcast(read(spark, sf_dir, "nation")), F.broadcast(read(spark, sf_dir, "region"))
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")).join(n, "n_nationkey").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("r_name").alias("area"), F.col("n_name").alias("place"), "n", F.sum("n").over(Window.partitionBy("r_name")).alias("area_n"))


@query(f"""WITH {TOKENS_SQL} SELECT w AS topic, count(*) AS n, count(DISTINCT day) AS days, min(day) AS first_day, max(day) AS last_day FROM tok JOIN items USING (id) GROUP BY w HAVING count(*) >= 2 AND count(DISTINCT day) >= 2 AND max(day) >= 10""")
def dossier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokenised(spark, sf_dir).select("day", F.explode("tokens").alias("topic"))
    d = d.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return d.where("n >= 2 and days >= 2 and last_day >= 10")


@query("""WITH e AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS BIGINT) AS edition, round(max(o_totalprice), 2) AS score FROM orders GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY edition DESC) AS rn, lead(score) OVER (PARTITION BY k ORDER BY edition DESC) AS previous, count(*) OVER (PARTITION BY k) AS editions FROM e)
  SELECT k, edition, score, previous, editions, CASE WHEN previous IS NULL THEN 'new' WHEN score > previous THEN 'up' WHEN score < previous THEN 'down' ELSE 'same' END AS movement FROM r WHERE rn = 1""")
def latest_previous_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("edition")).agg(F.round(F.max("o_totalprice"), 2).alias("score"))
    w = Window.partitionBy("k").orderBy(F.desc("edition"))
    e = e.withColumn("previous", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w)).withColumn("editions", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("rn = 1").drop("rn")
    move = F.when(F.col("previous").isNull(), "new").when(F.col("score") > F.col("previous"), "up").when(F.col("score") < F.col("previous"), "down").otherwise("same")
    return e.withColumn("movement", move)


@query("""WITH x AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS BIGINT) AS edition, o_orderstatus = 'F' AS official, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS note FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY k, edition ORDER BY official DESC, id) AS rn FROM x) SELECT k, edition, max(id) FILTER (WHERE rn = 1) AS report, arg_min(note, rn) FILTER (WHERE note IS NOT NULL) AS note FROM r GROUP BY 1, 2""")
def rankings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").cast("long").alias("edition"), (F.col("o_orderstatus") != "F").alias("late"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"))
    order = F.struct("late", "id")
    return x.groupBy("k", "edition").agg(F.min_by("id", order).alias("report"), F.min_by("note", F.when(F.col("note").isNotNull(), order)).alias("note"))


@query("""SELECT source, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("open"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
  SELECT user_id, round(avg(value) FILTER (WHERE rn <= 3), 4) AS last3, round(avg(value) FILTER (WHERE rn BETWEEN 4 AND 6), 4) AS before3, count(*) FILTER (WHERE rn <= 10) AS points FROM r GROUP BY user_id""")
def trend_last3_vs_prev3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.top_n(read(spark, sf_dir, "events").select("user_id", "value", "event_id"), ["user_id"], [F.desc("event_id")], 10)
    mean = lambda a, b: F.round(F.avg(F.when(F.col("rank").between(a, b), F.col("value"))), 4)
    return r.groupBy("user_id").agg(mean(1, 3).alias("last3"), mean(4, 6).alias("before3"), F.count(F.lit(1)).alias("points"))


@query("""SELECT event_type AS subject, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS hits, round(count(*) FILTER (WHERE value >= 50) / count(*), 4) AS accuracy FROM events GROUP BY 1""")
def practice_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("hits"))
    return e.withColumn("accuracy", F.round(F.col("hits") / F.col("n"), 4))


@query(f"""{GRADED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY day, publisher ORDER BY score DESC, id) AS own FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN own > 3 THEN 1 ELSE 0 END, score DESC, id) AS rank FROM a) SELECT day, rank, id FROM b WHERE rank <= 5""")
def spread_publisher_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.spread(graded(spark, sf_dir), ["day"], "publisher", [F.desc("score"), F.col("id")], 5).select("day", F.col("rank").cast("long").alias("rank"), "id")


@query(f"""{GRADED_SQL}, f AS (SELECT *, grade IN ('NOTE', 'SKIM') AS taken, grade = 'READ' AS fit FROM g), r AS (SELECT *, CAST(5 - sum(CASE WHEN taken THEN 1 ELSE 0 END) OVER (PARTITION BY day) AS BIGINT) AS lack, row_number() OVER (PARTITION BY day, fit AND NOT taken ORDER BY score DESC, id) AS rn FROM f)
  SELECT day, id, taken, fit AND NOT taken AND rn <= lack AS filled FROM r""")
def floor_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graded(spark, sf_dir)
    return windows.floor_fill(g, ["day"], F.col("grade").isin("NOTE", "SKIM"), F.col("grade") == "READ", [F.desc("score"), F.col("id")], 5).select("day", "id", F.col("grade").isin("NOTE", "SKIM").alias("taken"), "filled")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate) AS rn FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_suppkey, round(spent, 2) AS spent FROM x WHERE spent <= 60 OR rn <= 1""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")]
    return windows.prefix_budget(li, ["l_orderkey"], order, F.col("l_quantity"), 60, 1).select("l_orderkey", "l_linenumber", "l_suppkey", F.round("spent", 2).alias("spent"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT user_id, d, date_diff('day', DATE '2000-01-01', d) - row_number() OVER (PARTITION BY user_id ORDER BY d) AS run FROM d), r AS (SELECT user_id, run, count(*) AS n, max(d) AS last FROM g GROUP BY 1, 2)
  SELECT user_id, max(n) AS best, arg_max(n, last) AS latest, count(*) AS runs FROM r GROUP BY 1""")
def activity_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.islands(read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d")), ["user_id"], "d")
    return r.groupBy("user_id").agg(F.max("length").alias("best"), F.max_by("length", "last").alias("latest"), F.count(F.lit(1)).alias("runs"))


@query("""WITH x AS (SELECT user_id, event_id, value, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 40 THEN 1 ELSE 0 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM x),
  z AS (SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM y GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_event) AS rn FROM z) SELECT user_id, n, first_event FROM q WHERE rn = 1""")
def densest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.runs(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], F.col("event_id"), 40)
    r = r.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return windows.keep_first(r, ["user_id"], [F.desc("n"), F.col("first_event")]).select("user_id", "n", "first_event")


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS within FROM events""")
def sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("within"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id AS id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), n AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM d),
  p AS (SELECT id, len(words) AS l, w, count(*) AS tf FROM (SELECT id, words, unnest(words) AS w FROM d) WHERE w IN ('the', 'in', 'reand') GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
  s AS (SELECT id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))) AS score FROM p JOIN f USING (w), n WHERE w IN ('the', 'in') GROUP BY id HAVING count(*) = 2)
  SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, id LIMIT 200""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("id"), F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "").alias("words"))
    return search.bm25(d, ["the", "in"]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(200)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("text is not null")
    key = F.concat_ws("-", "conv_id", "turn")
    s = c.select(key.alias("id"), F.posexplode(t.sentences(F.col("text"), 20)).alias("place", "text"))
    return s.withColumn("words", t.words(F.col("text"))).where(F.size("words") > 0)


@query(rf"""WITH c AS (SELECT concat_ws('-', conv_id, turn) AS id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[\s\x{{00A0}}]+', ' ', 'g')), '\b(Mr|Mrs|Dr|St|No|vs|Rs|Sh|U|Art|Sec)\.', '\1․', 'g'), '([0-9])\.([0-9])', '\1․\2', 'g') AS t FROM conversations WHERE text IS NOT NULL),
  l AS (SELECT id, list_filter(list_transform(regexp_extract_all(t, '[^.!?]+[.!?]*'), lambda x: trim(replace(x, '․', '.'))), lambda x: length(x) > 20) AS l FROM c), s AS (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS place FROM l),
  w AS (SELECT DISTINCT id, place, left(w, 5) AS w FROM (SELECT id, place, unnest(regexp_extract_all(lower(s), '[a-z0-9\x{{0900}}-\x{{097F}}]+')) AS w FROM s) WHERE length(w) > 1 AND w NOT IN {_STOP}),
  n AS (SELECT id, count(DISTINCT place) AS n FROM w GROUP BY id), d AS (SELECT *, count(*) OVER (PARTITION BY id, w) AS df, count(*) OVER (PARTITION BY id, place) AS len FROM w),
  x AS (SELECT id, place, round(sum(ln(1 + n / df) * CASE WHEN df > 1 THEN 1.4 ELSE 1.0 END) / sqrt(max(len)) * CASE place WHEN 0 THEN 1.5 WHEN 1 THEN 1.15 ELSE 1.0 END, 6) AS score FROM d JOIN n USING (id) GROUP BY id, place),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS rank FROM x) SELECT id, CAST(place AS BIGINT) AS place, score FROM r WHERE rank <= 3""")
def extractive_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.ranked_sentences(_points(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return windows.top_n(s, ["id"], [F.desc("score"), F.col("place")], 3).select("id", F.col("place").cast("long").alias("place"), "score")


@query()
def pruned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each text without those that repeat an earlier one; greedy in order of score."""
    p = _points(spark, sf_dir)
    s = p.join(search.ranked_sentences(p), ["id", "place"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.round("score", 6)).alias("s"), "place", "words", "text"))).alias("p"))
    s = s.select("id", F.transform("p", lambda x: F.struct(x["place"].alias("place"), x["words"].alias("words"), x["text"].alias("text"))).alias("p"))
    return s.select("id", F.array_join(F.transform(search.pruned(F.col("p"), 3), lambda x: x["text"]), "\n").alias("points"))
