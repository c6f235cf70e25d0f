"""Normalisation queries: titles, texts, URLs, ids, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.plans.registry import query
from quillstream.sources.tables import ITEMS_SQL, items, read

_STOP = "(" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + ")"
#: Plural folding of the word w in SQL.
_STEM = r"""CASE WHEN length(w) <= 3 OR regexp_matches(w, '^[0-9]+$') OR regexp_matches(w, '(ss|us|is)$') THEN w
  WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN left(w, length(w) - 2)
  WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"""
_FOLD = f"regexp_replace(translate(%s, '{t.ACCENTED}', '{t.FOLDED}'), '{t.MARKS}', '', 'g')"
#: tok(id, w): the distinct tokens of each item.
TOKENS_SQL = rf"""{ITEMS_SQL}, raw AS (SELECT id, unnest(regexp_extract_all(lower({_FOLD % "title"}), '[a-z0-9]+(?:\.[0-9]+)?')) AS w FROM items),
  tok AS (SELECT DISTINCT id, {_STEM} AS w FROM raw WHERE w NOT IN {_STOP} AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')))"""


@query(f"WITH {TOKENS_SQL} SELECT items.id, string_agg(w, ' ' ORDER BY w) AS tokens, count(w) AS n FROM items LEFT JOIN tok USING (id) GROUP BY items.id")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir).select("id", F.array_sort(t.tokens(F.col("title"))).alias("k"))
    return d.select("id", F.nullif(F.array_join("k", " "), F.lit("")).alias("tokens"), F.size("k").cast("long").alias("n"))


@query(rf"""WITH {ITEMS_SQL}, raw AS (SELECT id, unnest(regexp_extract_all({_FOLD % "title"}, '[A-Za-z0-9][A-Za-z0-9.''\-]*')) AS r, generate_subscripts(regexp_extract_all({_FOLD % "title"}, '[A-Za-z0-9][A-Za-z0-9.''\-]*'), 1) AS i FROM items),
  marked AS (SELECT id, lower(trim(r, '.-''')) AS w FROM raw WHERE regexp_matches(r, '[0-9]') OR regexp_matches(trim(r, '.-'''), '^[^a-z]*[A-Z][^a-z]+$') OR (i > 1 AND regexp_matches(trim(r, '.-'''), '^[A-Z]'))),
  k AS (SELECT DISTINCT id, {_STEM} AS w FROM marked) SELECT id, string_agg(w, ' ' ORDER BY w) AS keys FROM k WHERE w <> '' AND w NOT IN {_STOP} GROUP BY id""")
def key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.array_join(t.key_tokens(F.col("title")), " ").alias("keys")).where("keys <> ''")


@query(rf"""WITH raw AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{{0900}}-\x{{097F}}]+')) AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
  SELECT id, count(DISTINCT left(w, 5)) AS n_words, min(left(w, 5)) AS first_word FROM raw WHERE length(w) > 1 AND w NOT IN {_STOP} GROUP BY id""")
def words_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), t.words(F.col("text")).alias("w"))
    return d.where(F.size("w") > 0).select("id", F.size("w").cast("long").alias("n_words"), F.array_min("w").alias("first_word"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages WHERE url IS NOT NULL),
  p AS (SELECT page_id, split_part(u, '?', 1) AS base, CASE WHEN instr(u, '?') > 0 THEN substr(u, instr(u, '?') + 1) ELSE '' END AS q FROM u),
  s AS (SELECT *, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)', 1) AS root FROM p),
  r AS (SELECT *, substr(base, length(root) + 1) AS path FROM s),
  k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|fbclid|gclid|dclid|mc_cid|mc_eid|_gl|ref|ref_src|cmp|ito|s_cid|from|source|ncid|campaign|pfrom|pgtype|ocid|sref|share|amp)(=|$)')), '&') AS kept FROM r)
  SELECT page_id, lower(root) || CASE WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM k""")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where("url is not null").select("page_id", t.canonical_url(F.col("url")).alias("canonical"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages WHERE html IS NOT NULL),
  b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM a)
  SELECT page_id, length(trim(regexp_replace(t, '[\s\x{00A0}]+', ' ', 'g'))) AS n_chars, md5(trim(regexp_replace(t, '[\s\x{00A0}]+', ' ', 'g'))) AS digest FROM b""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").where("html is not null").select("page_id", t.strip_tags(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t")).alias("digest"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS title, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'), 1) AS i FROM pages),
  g AS (SELECT page_id, href, title, i, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS rn FROM a WHERE length(title) BETWEEN 4 AND 240 AND NOT regexp_matches(href, '(?i)/(login|tag|author|page)(/|$)'))
  SELECT page_id, href, title FROM g WHERE rn = 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstream.sources.landing import links

    return links(read(spark, sf_dir, "pages"), least=4).select("page_id", "href", "title")


@query(f"WITH {ITEMS_SQL} SELECT id, substr(sha1(title || chr(31) || coalesce(publisher, '')), 1, 20) AS item_id FROM items")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", t.make_id(F.col("title"), F.col("publisher")).alias("item_id"))


@query(r"""WITH n AS (SELECT s_suppkey, regexp_replace(lower(trim('The ' || s_name || '.com')), '^the\s+', '') AS n FROM supplier)
  SELECT s_suppkey, regexp_replace(regexp_replace(n, '\.(co\.in|gov\.in|com|in|org|net)$', ''), '[^a-z0-9]', '', 'g') AS key FROM n""")
def publisher_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", t.publisher_key(F.concat(F.lit("The "), "s_name", F.lit(".com"))).alias("key"))


@query(rf"""WITH {ITEMS_SQL}, c AS (SELECT id, trim(trim(regexp_replace(title, '[\s\x{{00A0}}]+', ' ', 'g')), ' -|–—') AS c FROM items)
  SELECT id, c AS title, CASE WHEN length(c) <= 40 THEN c ELSE coalesce(nullif(regexp_extract(c, '(?s)^(.{{0,40}})\s', 1), ''), substr(c, 1, 40)) || '…' END AS short, trim(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM c""")
def clipped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = items(spark, sf_dir).select("id", t.clean_title(F.col("title")).alias("c"))
    return c.select("id", F.col("c").alias("title"), t.clip(F.col("c"), 40).alias("short"), t.slug(F.col("c")).alias("slug"))


@query(r"""WITH s AS (SELECT doc_id AS id, split_part(text, chr(10), 1) || ' - ' || source AS t, source FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL)
  SELECT id, CASE WHEN id % 2 = 0 THEN trim(left(t, length(t) - length(source) - 3)) WHEN length(regexp_extract(t, '^(.*\S)\s+[-–|]\s+[^-–|]{2,40}$', 1)) > 25 THEN regexp_extract(t, '^(.*\S)\s+[-–|]\s+[^-–|]{2,40}$', 1) ELSE t END AS title FROM s""")
def without_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("doc_id is not null and text is not null and source is not null")
    d = d.select(F.col("doc_id").alias("id"), F.concat(F.substring_index("text", "\n", 1), F.lit(" - "), "source").alias("t"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("p"))
    return d.select("id", t.strip_publisher(F.col("t"), F.col("p")).alias("title"))


@query(r"""WITH n AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]+)?')) AS n FROM documents)
  SELECT id, count(DISTINCT replace(n, ',', '')) AS n_figures, min(replace(n, ',', '')) AS least FROM n GROUP BY id""")
def figures_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), t.numbers(F.col("text")).alias("n")).where(F.size("n") > 0)
    return d.select("id", F.size("n").cast("long").alias("n_figures"), F.element_at("n", 1).alias("least"))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')), '\b(Mr|Mrs|Dr|St|No|vs|Rs|Sh|U|Art|Sec)\.', '\1․', 'g'), '([0-9])\.([0-9])', '\1․\2', 'g') AS t FROM conversations WHERE text IS NOT NULL),
  s AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '[^.!?]+[.!?]*')) AS s FROM c)
  SELECT conv_id, turn, count(*) AS n, CAST(sum(length(trim(s))) AS BIGINT) AS chars FROM s WHERE length(trim(s)) > 30 GROUP BY ALL""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.explode(t.sentences(F.col("text"))).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query("""SELECT strftime(CAST(ts AS TIMESTAMP) + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type <> 'error' GROUP BY 1""")
def ist_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.groupBy(t.ist_day(F.col("ts")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, CAST(weekofyear(o_orderdate) AS BIGINT) AS iso_week,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def calendar_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.groupBy(F.to_date(F.date_trunc("week", day)).cast("string").alias("week"), F.last_day(day).cast("string").alias("month_end"), F.weekofyear(day).cast("long").alias("iso_week")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(r"""SELECT regexp_extract(lower(url), '://(?:www\.)?([^/?#:]*)', 1) AS host, count(*) AS pages, CAST(count(*) FILTER (WHERE regexp_matches(lower(url), '://(www\.)?([^/?#:]*\.)?example\.(com|org)([/?#:]|$)') AND NOT regexp_matches(url, '/premium/')) AS BIGINT) AS allowed FROM pages WHERE url IS NOT NULL GROUP BY 1""")
def host_suffix_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstream.operators.filters import on_list

    p = read(spark, sf_dir, "pages").where("url is not null").withColumn("host", t.host(F.col("url")))
    ok = on_list(F.col("host"), ("example.com", "example.org")) & ~F.col("url").rlike("/premium/")
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("allowed"))
