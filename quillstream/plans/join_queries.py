"""Join and set queries: lookups, semi and anti joins, set similarity, ranges, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators import similarity as sim
from quillstream.operators import upserts, windows
from quillstream.plans.registry import query
from quillstream.plans.rule_queries import GRADED_SQL, graded
from quillstream.plans.text_queries import TOKENS_SQL
from quillstream.sources.tables import ITEMS_SQL, items, read, tokenised

_PAIRS = """n AS (SELECT id, count(*) AS n FROM tok GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM tok a JOIN tok b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
  s AS (SELECT p.*, x.n AS na, y.n AS nb FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b)"""


@query("""SELECT o_orderkey, o_orderstatus, (SELECT string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_shipdate, l_linenumber, l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders WHERE o_orderstatus = 'F'""")
def story_sources_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber", "l_suppkey").alias("s"))
    own = line.join(o.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["l_linenumber"], s["l_suppkey"])), ",")
    return o.join(own, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", text.alias("lines"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-07-01')""")
def range_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where("o_orderdate >= DATE'1995-01-01' and o_orderdate < DATE'1995-07-01'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.event_id < e.event_id)")
def unseen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return windows.keep_first(e, ["user_id", "event_type"], [F.col("event_id")]).select("event_id", "user_id")


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT id, publisher, EXISTS (SELECT 1 FROM labels WHERE doc_id = id AND quality = 0) AS flagged,
  (SELECT min(toxic) FROM labels WHERE doc_id = id) AS toxic FROM items) SELECT id, flagged, toxic, row_number() OVER (ORDER BY flagged DESC, publisher, id) AS place FROM x""")
def flagged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 0).alias("f"), F.min("toxic").alias("toxic"))
    x = items(spark, sf_dir).select("id", "publisher").join(lab, "id", "left").withColumn("flagged", F.coalesce("f", F.lit(False)))
    x = windows.places(x, [(~F.col("flagged")).cast("int"), F.coalesce("publisher", F.lit("")), F.expr("id div 65536")], [F.col("id")], "place")
    return x.select("id", "flagged", "toxic", "place")


@query(f"""{GRADED_SQL}, picks AS (SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY score DESC, id) AS rank FROM g WHERE grade <> 'LOW')
  SELECT items.id, picks.rank, coalesce(picks.rank <= 5, false) AS is_card FROM items LEFT JOIN picks ON picks.id = items.id AND picks.rank <= 20""")
def latest_pick_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = windows.top_n(graded(spark, sf_dir).where("grade <> 'LOW'"), ["day"], [F.desc("score"), F.col("id")], 20).select("id", F.col("rank").cast("long").alias("rank"))
    return items(spark, sf_dir).select("id").join(picks, "id", "left").withColumn("is_card", F.coalesce(F.col("rank") <= 5, F.lit(False)))


@query(f"""{GRADED_SQL}, r AS (SELECT id, CASE WHEN grade IN ('NOTE', 'SKIM') THEN 'in' END AS rules FROM g WHERE grade IN ('NOTE', 'SKIM')), l AS (SELECT doc_id AS id, 'in' AS ai FROM labels WHERE quality = 1)
  SELECT coalesce(r.id, l.id) AS id, CASE WHEN rules IS NULL THEN 'added' WHEN ai IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM r FULL JOIN l ON r.id = l.id""")
def rules_vs_labels_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = graded(spark, sf_dir).where("grade in ('NOTE', 'SKIM')").select("id", F.lit(1).alias("rules"))
    ai = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("ai"))
    return r.join(ai, "id", "full_outer").select("id", F.when(F.col("rules").isNull(), "added").when(F.col("ai").isNull(), "dropped").otherwise("kept").alias("change"))


@query(f"""WITH {TOKENS_SQL}, {_PAIRS}, v AS (SELECT a, b, CASE WHEN shared = na AND shared = nb THEN 2.0 WHEN shared >= 3 AND (shared / (na + nb - shared) >= 0.5 OR (shared / least(na, nb) >= 0.75 AND shared >= 4)) THEN shared / (na + nb - shared) + shared / least(na, nb) ELSE 0.0 END AS s FROM s WHERE shared >= 2)
  SELECT a, b, round(s, 6) AS similarity FROM v WHERE s > 0""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokenised(spark, sf_dir).select("id", "tokens")
    return sim.similar_stories(d, digits=6)


@query(f"""WITH {TOKENS_SQL}, k AS (SELECT id, string_agg(w, ' ' ORDER BY w) AS k FROM tok GROUP BY id HAVING count(*) >= 3), x AS (SELECT items.id, kind, day, k FROM items JOIN k USING (id)),
  f AS (SELECT k, id AS piece, kind AS as_kind, row_number() OVER (PARTITION BY k ORDER BY day, id) AS rn FROM x WHERE kind <> 'news')
  SELECT id, piece, as_kind FROM x JOIN f USING (k) WHERE x.kind = 'news' AND rn = 1""")
def exact_token_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tokenised(spark, sf_dir).where(F.size("tokens") >= 3).withColumn("k", F.array_join(F.array_sort("tokens"), " "))
    first = windows.keep_first(x.where("kind <> 'news'"), ["k"], [F.col("day"), F.col("id")]).select("k", F.col("id").alias("piece"), F.col("kind").alias("as_kind"))
    return x.where("kind = 'news'").join(first, "k").select("id", "piece", "as_kind")


_RARITY = f"""WITH {TOKENS_SQL}, c AS (SELECT count(*) AS n FROM items), d AS (SELECT w, count(*) AS df FROM tok GROUP BY w),
  x AS (SELECT tok.id, tok.w, ln((n + 1.0) / (df + 1.0)) AS idf, df <= greatest(3.0, 0.025 * n) AND NOT regexp_matches(tok.w, '^[0-9]+$') AS anchor, df <= greatest(2.0, 0.0042 * n) AND NOT regexp_matches(tok.w, '^[0-9]+$') AS twin FROM tok JOIN d USING (w), c),
  t AS (SELECT id, sum(idf) AS total FROM x GROUP BY id),
  p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, sum(a.idf) AS common, count(*) FILTER (WHERE a.anchor) AS anchors, count(*) FILTER (WHERE a.twin) AS twins FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
  r AS (SELECT a, b, shared, CASE WHEN twins >= 2 THEN 1.0 ELSE common / (ta.total + tb.total - common) END AS s FROM p JOIN t ta ON ta.id = a JOIN t tb ON tb.id = b WHERE shared >= 2 AND anchors >= 1)"""


@query(f"{_RARITY} SELECT a, b, shared, round(s, 6) AS similarity FROM r")
def rarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.rarity_pairs(tokenised(spark, sf_dir).select("id", "tokens"), digits=6)


@query(f"{_RARITY}, q AS (SELECT a, b, round(s, 6) AS s FROM r WHERE s >= 0.15), k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rn FROM q) SELECT b AS piece, a AS card FROM k WHERE rn = 1")
def best_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, pairs = sim.rarity_groups(tokenised(spark, sf_dir).select("id", "tokens"), least=0.149)  # before rounding
    return sim.best_earlier(groups, pairs.withColumn("similarity", F.round("similarity", 6)), least=0.15).select(F.col("b").alias("piece"), F.col("a").alias("card"))


@query("""SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS d FROM events) e
  JOIN (SELECT o_orderkey, o_custkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 31 AS BIGINT) AS d FROM orders) o ON o.o_custkey = e.user_id AND o.d BETWEEN e.d - 2 AND e.d + 4""")
def date_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.datediff("ts", F.lit("2024-01-01")).alias("d"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.datediff("o_orderdate", F.lit("1992-01-01")) % 31).alias("od"))
    near = e.withColumn("od", F.explode(F.expr("sequence(d - 2, d + 4)")))  # the range as days, so that the join is on equal days
    return near.join(o, ["user_id", "od"]).select("event_id", "o_orderkey")


ALIASES = [("red", "antique red"), ("red", "red"), ("blue", "blue"), ("blue", "light blue"), ("steel", "steel"), ("tin", "tin"), ("part", "part"), ("pn", "part 1")]


@query("WITH a(key, alias) AS (VALUES " + ", ".join(f"('{k}', '{a}')" for k, a in ALIASES) + """), x AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS t FROM part),
  m AS (SELECT id, key, alias, row_number() OVER (PARTITION BY id ORDER BY length(alias) DESC, key) AS rn FROM x JOIN a ON contains(' ' || t || ' ', ' ' || alias || ' ')) SELECT id, key, alias FROM m WHERE rn = 1""")
def alias_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return sim.longest_alias(p, spark.createDataFrame(ALIASES, "key string, alias string"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS w FROM lineitem), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.w = b.w AND a.id < b.id GROUP BY ALL) SELECT a, b, shared FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared >= 2 AND shared >= 0.6 * least(x.n, y.n)""")
def overlapping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("tokens"))
    return sim.overlapping(s, share=0.6).select("a", "b", "shared")


_BENCH = r"regexp_extract_all(lower(%s), '[a-z0-9]+')"


@query(f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_BENCH % "text"}) AS w FROM documents WHERE doc_id IS NOT NULL), b AS (SELECT DISTINCT item_id, unnest({_BENCH % "text"}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
  SELECT doc_id, item_id, round(count(*) / max(n), 4) AS share FROM d JOIN b USING (w) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 2 AND count(*) >= 0.9 * max(n)""")
def free_copy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lambda d, i: d.select(F.col(i).alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("tokens")).where("id is not null and tokens is not null")
    d, b = split(read(spark, sf_dir, "documents"), "doc_id"), split(read(spark, sf_dir, "benchmark"), "item_id")
    p = sim.contained(b, d, share=0.9).where("shared >= 2")
    return p.select(F.col("b").alias("doc_id"), F.col("a").alias("item_id"), F.round(F.col("shared") / F.col("na"), 4).alias("share"))


@query(f"""WITH {ITEMS_SQL}, m AS (SELECT DISTINCT id, day, lower(left(title, 90)) AS h FROM items WHERE regexp_matches(' ' || lower(title), '[^a-z0-9]the') AND regexp_matches(' ' || lower(title), '[^a-z0-9]er')),
  r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY day, id) AS rn FROM m) SELECT id, day FROM r WHERE rn = 1""")
def topic_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit(" "), F.lower("title"))
    m = items(spark, sf_dir).where(title.rlike("[^a-z0-9]the") & title.rlike("[^a-z0-9]er")).withColumn("h", F.lower(F.left("title", F.lit(90))))
    return windows.keep_first(m, ["h"], [F.col("day"), F.col("id")]).select("id", "day")


_SNAP = "SELECT user_id, max(value) AS best, CAST(count(*) AS BIGINT) AS n, bool_or(event_type = 'purchase') AS bought, max(event_id) AS at FROM events WHERE event_id % 2 = {} GROUP BY user_id"


@query(f"WITH a AS ({_SNAP.format(0)}), b AS ({_SNAP.format(1)}) SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(a.best, b.best) AS best, coalesce(a.bought, false) OR coalesce(b.bought, false) AS bought, CASE WHEN a.at IS NULL OR b.at > a.at THEN b.n ELSE a.n END AS n FROM a FULL JOIN b ON a.user_id = b.user_id")
def progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    snap = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.max("event_id").alias("at"))
    return upserts.unite(snap(0), snap(1), "user_id", {"best": "greatest", "bought": "any", "n": "latest"})


_STATE = "SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer WHERE c_custkey % 5 <> 0"
_DELTA = "SELECT c_custkey AS k, 'new' AS seg, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 5 <= 1"


@query(f"""WITH b AS ({_STATE}), d AS ({_DELTA}) SELECT coalesce(b.k, d.k) AS k, CASE WHEN d.k IS NULL THEN b.seg ELSE d.seg END AS replaced, CASE WHEN b.k IS NULL THEN d.seg ELSE b.seg END AS kept, round(coalesce(b.bal, d.bal), 2) AS filled FROM b FULL JOIN d ON b.k = d.k""")
def upsert_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    b = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    d = c.where("c_custkey % 5 <= 1").select(F.col("c_custkey").alias("k"), F.lit("new").alias("seg"), (F.col("c_acctbal") + 1).alias("bal"))
    r, i, f = (upserts.upsert(b, d, ["k"], p) for p in ("replace", "ignore", "fill"))
    return r.select("k", F.col("seg").alias("replaced")).join(i.select("k", F.col("seg").alias("kept")), "k").join(f.select("k", F.round("bal", 2).alias("filled")), "k")


@query("""WITH kept AS (SELECT * FROM lineitem WHERE NOT (l_discount >= 0.09 AND l_quantity < 5)), a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount >= 0.09 AND l_quantity < 5)
  SELECT l_orderkey, count(*) AS left_lines FROM kept JOIN a USING (l_orderkey) GROUP BY 1""")
def delete_and_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, hurt = upserts.removed(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_quantity"), (F.col("l_discount") >= 0.09) & (F.col("l_quantity") < 5), "l_orderkey")
    return kept.join(hurt, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("left_lines"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
  UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (read(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "intersect")).union(count(a.subtract(b), "except"))
