"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, fill_middle, filter_audit, jaccard, language, line_dedup, main_text, packing, personal_data, pieces, quality, token_counts, url_filter
from quillstream.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, added = personal_data.KINDS, personal_data.ADDED
    count = lambda k: F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, kinds), F.sha2(personal_data.joined("found", kinds), 256).alias("base_sha256"), personal_data.joined("found", kinds + added).alias("spans"), *map(count, added))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path through the lattice by the pieces' scores, which need not be the ids that the model's own merges give, and its N best."""
    found = pieces.segmented(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "score",
        F.expr("get(others, 0).score").alias("second_score"),
        (F.size("others") + 1).cast("long").alias("n_paths"),
        F.sha2(F.to_json("others"), 256).alias("others_sha256"),
        "decodes",
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        "longest",
        "longest_start",
        "longest_item",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_removed").alias("n_removed"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=1)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_personal_data": op2_personal_data,
    "op3_pieces": op3_pieces,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_jaccard": op8_jaccard,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_middle": op12_fill_middle,
    "op13_packing": op13_packing,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0),
winp AS (SELECT DISTINCT item_id, k, i AS p, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM p)),
win AS (SELECT DISTINCT item_id, k, g FROM winp),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
m AS (SELECT doc_id, item_id, k, i FROM dw JOIN win USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
dg AS (SELECT doc_id, item_id, i, i - p AS diagonal, max(k) AS k FROM dw JOIN winp USING (k, g) GROUP BY ALL),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM dg),
rn AS (SELECT doc_id, item_id, max(i + k) - min(i) AS size, min(i) - 1 AS start FROM isl GROUP BY doc_id, item_id, diagonal, run),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start, item_id) AS place FROM rn) WHERE place = 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated, coalesce(l.size, 0) AS longest, l.start AS longest_start, l.item_id AS longest_item
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "op8_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, ways.b FROM r JOIN ways ON ways.a = r.reached)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.reached) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.id = d.doc_id GROUP BY d.doc_id""",
    "op11_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS q, max(CAST(toxic = 1 AS INTEGER)) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(q) AS q, sum(x) AS x FROM f GROUP BY ALL),
letters(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT concat(a.k, b.k, c.k, d.k, e.k) AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS k, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) AS r(step)),
r AS (SELECT c.*, s.*, contains(fails, k) AS failing, translate(earlier, fails, '') <> earlier AS gone FROM c, s),
g AS (SELECT part, filter_order, step, k, sum(n) FILTER (WHERE NOT gone AND NOT failing) AS kept, sum(n) FILTER (WHERE NOT gone AND failing) AS removed, sum(n) FILTER (WHERE gone AND failing) AS redundant,
  sum(n) FILTER (WHERE fails = k) AS unique_fails, sum(q) FILTER (WHERE NOT gone AND failing) AS good_lost, sum(x) FILTER (WHERE NOT gone AND failing) AS toxic_lost FROM r GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM g""",
    "op12_fill_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, len(us) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f),
p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
