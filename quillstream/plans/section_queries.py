"""Sections of pages under their headings, and of documents between empty lines or under Markdown's signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.plans.registry import query
from quillstream.sources import landed
from quillstream.sources.tables import read

_ASIDE = "|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in landed.ASIDE)
_HOLD, _ANY = "|".join(landed.HOLD), "|".join(landed.HOLD + landed.END)


def _plain(x: str) -> str:
    """SQL of the text of markup, for the character references that the tables hold."""
    out = rf"regexp_replace(regexp_replace({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for ref, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{char}')"
    return rf"trim(regexp_replace({out}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@query(rf"""WITH m AS (SELECT page_id, string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is){_ASIDE}|<!--.*?-->', ' ', 'g'), '(?i)<(h[1-3])([\s>])', chr(1) || '<\1\2', 'g'), chr(1)) AS parts FROM pages),
  s AS (SELECT page_id, i - 1 AS n, parts[i] AS part FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM m WHERE len(parts) > 1) WHERE i > 1),
  b AS (SELECT page_id, n, {_plain(r"regexp_extract(part, '(?is)^<h[1-3][^>]*>(.*?)</h[1-3]', 1)")} AS heading,
    list_filter(string_split(regexp_replace(part, '(?i)<(/?)({_ANY})([\s>])', chr(2) || '<\1\2\3', 'g'), chr(2)), lambda x: regexp_matches(x, '(?i)^<({_HOLD})[\s>]')) AS blocks FROM s),
  t AS (SELECT page_id, n, heading, array_to_string(list_filter(list_transform(blocks, lambda x: {_plain("x")}), lambda x: x <> ''), chr(10)) AS body FROM b)
  SELECT page_id, n, heading, length(body) AS n_chars, md5(body) AS digest FROM t WHERE length(body) > {landed.LEAST}
  UNION ALL SELECT page_id, 1, NULL, length(body), md5(body) FROM (SELECT page_id, {_plain("parts[1]")} AS body FROM m WHERE len(parts) = 1)""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every page: their headings, and the paragraphs, list items and cells below them."""
    s = read(spark, sf_dir, "pages").select("page_id", F.explode(landed.html_sections(F.col("html"))).alias("s"))
    return s.select("page_id", F.col("s.n").cast("long").alias("n"), "s.heading", F.length("s.body").cast("long").alias("n_chars"), F.md5("s.body").alias("digest"))


_TRIMMED = r"trim({}, ' ' || chr(9) || chr(13) || chr(10))"
_COLLAPSED = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@query(rf"""WITH m AS (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(coalesce(text, ''), '(?m)^(#{{1,3}}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
  h AS (SELECT doc_id, i - 1 AS n, {_COLLAPSED.format(r"regexp_extract(parts[i], '^#{1,3}[ \t]+([^\n]*)', 1)")} AS heading, regexp_replace(parts[i], '^#{{1,3}}[^\n]*\n?', '') AS body
    FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM m WHERE len(parts) > 1)),
  k AS (SELECT doc_id, list_filter(string_split_regex(t, '\n\s*\n'), lambda x: length({_TRIMMED.format("x")}) > {landed.LEAST}) AS blocks FROM m WHERE len(parts) = 1),
  b AS (SELECT doc_id, n, blocks[n] AS body FROM (SELECT doc_id, blocks, unnest(range(1, len(blocks) + 1)) AS n FROM k)),
  l AS (SELECT doc_id, n, body, list_transform(string_split_regex(body, '\r\n|\r|\n')[1:{landed.LINE_LOOKED_AT}], lambda x: {_COLLAPSED.format("x")}) AS lines FROM b),
  f AS (SELECT doc_id, n, body, list_filter(lines, lambda x: len(string_split(x, ' ')) BETWEEN {landed.LINE_WORDS[0]} AND {landed.LINE_WORDS[1]} AND length(x) BETWEEN {landed.LINE_CHARS[0]} AND {landed.LINE_CHARS[1]}
      AND NOT regexp_matches(x, '[.,;]$') AND length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= 0.7 * length(regexp_replace(x, '\s', '', 'g'))
      AND (upper(x) = x AND lower(x) <> x OR len(list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= 0.6 * len(string_split(x, ' '))))[1] AS line FROM l)
  SELECT doc_id, n, heading, length(body) AS n_chars, md5(body) AS digest FROM h WHERE length({_TRIMMED.format("body")}) > {landed.LEAST}
  UNION ALL SELECT doc_id, n, CASE WHEN upper(line) = line THEN array_to_string(list_transform(string_split(line, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') ELSE line END, length(body), md5(body) FROM f""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document under its Markdown headings; without any, its blocks, each with the first line that looks like a heading."""
    s = read(spark, sf_dir, "documents").select("doc_id", F.explode(landed.text_sections(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.n").cast("long").alias("n"), "s.heading", F.length("s.body").cast("long").alias("n_chars"), F.md5("s.body").alias("digest"))
