"""Items analysed by a file of rules: phrases, capitals and plurals, other countries, watched areas, rejections, grades and topics."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import analysis, rules, terms
from quillstream.operators.rules import Rule
from quillstream.plans.registry import query
from quillstream.sources import rule_files
from quillstream.sources.tables import ITEMS_SQL, items

CONFIG = rule_files.config(str(Path(__file__).with_name("analysis_rules.json")))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(names: list[str]) -> str:
    return "(" + ", ".join(map(_q, names)) + ")"


def sets_sql(sets: dict[str, tuple[list[Rule], dict[str, float]]]) -> str:
    """CTEs up to hit(id, set_, field, bucket, term, weight, factor): leftmost longest terms of each set in each of its fields."""
    forms = sorted({(name, f.form, f.is_exact, f.term, len(f.form.split(" ")) * 2 - 1) for name, (table, _) in sets.items() for _, t, _ in table for f in terms.forms_of(t)})
    weights = sorted({(name, f.term, f.is_exact, b, w) for name, (table, _) in sets.items() for b, t, w in table for f in terms.forms_of(t)})
    fields = sorted({c for _, own in sets.values() for c in own})
    most = max(x[-1] for x in forms)
    heads = _list(sorted({x[1].lower().split(" ")[0] for x in forms}))
    texts = " UNION ALL ".join(f"SELECT id, {_q(c)} AS field, regexp_extract_all(regexp_replace(coalesce({c}, ''), '[\\s\\-]+', ' ', 'g'), '[A-Za-z0-9]+|[^A-Za-z0-9]') AS p FROM items" for c in fields)
    return f"""f(set_, form, exact, term, n) AS (VALUES {", ".join(f"({_q(s)}, {_q(f)}, {x}, {_q(t)}, {n})" for s, f, x, t, n in forms)}),
  sf(set_, field, factor) AS (VALUES {", ".join(f"({_q(s)}, {_q(c)}, CAST({k} AS DOUBLE))" for s, (_, own) in sets.items() for c, k in own.items())}),
  wt(set_, term, exact, bucket, weight) AS (VALUES {", ".join(f"({_q(s)}, {_q(t)}, {x}, {_q(b)}, CAST({w} AS DOUBLE))" for s, t, x, b, w in weights)}),
  p AS ({texts}), lens AS (SELECT DISTINCT n FROM f), w AS (SELECT id, field, unnest(p) AS x0, generate_subscripts(p, 1) AS i FROM p),
  l AS (SELECT *, {", ".join(f"lead(x0, {k}) OVER (PARTITION BY id, field ORDER BY i) AS x{k}" for k in range(1, most))} FROM w),
  runs AS (SELECT id, field, i, n, CASE n {" ".join(f"WHEN {n} THEN {' || '.join(f'x{k}' for k in range(n))}" for n in range(1, most + 1))} END AS run FROM l, lens WHERE lower(x0) IN {heads}),
  hits AS (SELECT DISTINCT id, f.set_, runs.field, factor, f.exact, i, runs.n, term FROM runs JOIN f ON runs.n = f.n AND ((f.exact AND run = form) OR (NOT f.exact AND lower(run) = form)) JOIN sf ON sf.set_ = f.set_ AND sf.field = runs.field),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, set_, field, exact, i ORDER BY length(term) DESC, n DESC) AS rn FROM hits) WHERE rn = 1),
  ways AS (SELECT id, set_, field, factor, exact, list_reduce(list({{'i': i, 'stop': i + n, 'terms': [term]}} ORDER BY i), lambda a, x: CASE WHEN x.i < a.stop THEN a ELSE {{'i': x.i, 'stop': x.stop, 'terms': list_concat(a.terms, x.terms)}} END) AS w FROM best GROUP BY ALL),
  m AS (SELECT DISTINCT id, set_, field, factor, exact, unnest(w.terms) AS term FROM ways),
  hit AS (SELECT id, set_, field, bucket, term, weight, factor FROM m JOIN wt USING (set_, term, exact))"""


_SETS = {name: (table, analysis.FIELDS[name]) for name, table in analysis.term_sets(CONFIG).items()}
_P = CONFIG["penalties"]
_WATCH = ", ".join(
    f"CASE WHEN {' AND '.join(f'coalesce(list_contains(groups, {_q(analysis.watch_bucket(name, k))}), false)' for k in range(len(a['groups'])))}{'' if a['regional'] else ' AND at_home'} THEN {_q(name)} END"
    for name, a in sorted(CONFIG["watch"].items())
)
_NOISE = " + ".join(f"CASE WHEN regexp_matches(coalesce(title, ''), {_q('(?i)' + p)}) THEN {w} ELSE 0 END" for p, w in CONFIG["noise_patterns"])
_LETTERS = "length(regexp_replace(coalesce(title, ''), " + _q(analysis.OTHER_SCRIPT.replace("[", "[^", 1)) + ", '', 'g'))"
ANALYSED_SQL = f"""{ITEMS_SQL}, {sets_sql(_SETS)},
  fl AS (SELECT id, count(*) FILTER (set_ = 'links') > 0 AS linked, count(*) FILTER (set_ = 'links' AND term NOT IN {_list(CONFIG["ambiguous"])}) > 0 AS sure, count(*) FILTER (set_ = 'foreign') > 0 AS abroad,
    count(DISTINCT bucket) FILTER (set_ = 'foreign') AS countries, count(*) FILTER (set_ = 'neighbours') > 0 AS near, count(*) FILTER (set_ = 'exempt' AND field = 'title') > 0 AS spared, count(*) FILTER (set_ = 'exempt') > 0 AS exempt,
    count(*) FILTER (set_ = 'wide') > 0 AS wide, count(*) FILTER (set_ IN ('home', 'links')) > 0 AS at_home, round(sum(weight * factor) FILTER (set_ = 'signals'), 4) AS signal, round(sum(weight * factor) FILTER (set_ = 'noise'), 4) AS noise,
    list(DISTINCT bucket) FILTER (set_ = 'watch') AS groups FROM hit GROUP BY id),
  a1 AS (SELECT items.*, coalesce(abroad, false) AS abroad, coalesce(countries, 0) AS countries, coalesce(wide, false) AS wide, coalesce(exempt, false) AS exempt, coalesce(at_home, false) AS at_home, groups, coalesce(signal, 0) AS signal, coalesce(noise, 0) AS term_noise,
    lower(trim(coalesce(publisher, ''))) AS outlet, coalesce((linked AND (sure OR NOT abroad)) OR spared, false) AS kept_home, coalesce(near, false) AS near, {_LETTERS} >= {analysis.OTHER_LETTERS} AS script FROM items LEFT JOIN fl USING (id)),
  a2 AS (SELECT *, CASE WHEN kept_home THEN '' WHEN abroad THEN CASE WHEN near THEN 'near' ELSE 'world' END ELSE CASE outlet {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in CONFIG["publishers"].items())} ELSE '' END END AS elsewhere FROM a1),
  sub AS (SELECT id, bucket, round(sum(weight * factor), 4) AS score FROM hit WHERE set_ = 'subjects' GROUP BY ALL),
  mv AS (SELECT id, round(sum(score), 4) AS moved FROM sub JOIN a2 USING (id) WHERE elsewhere <> '' AND bucket IN {_list(CONFIG["moves"])} GROUP BY id),
  aft AS (SELECT id, bucket, round(sum(score), 4) AS score FROM (SELECT id, bucket, score FROM sub JOIN a2 USING (id) WHERE elsewhere = '' OR bucket NOT IN {_list(CONFIG["moves"])} UNION ALL SELECT id, {_q(CONFIG["moved_to"])}, moved FROM mv) GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, bucket) AS rank FROM aft),
  sj AS (SELECT id, max(score) AS best, list(bucket ORDER BY rank) FILTER (score >= {CONFIG["threshold"]} AND rank <= {CONFIG["most"]}) AS subjects FROM rk GROUP BY id),
  a3 AS (SELECT a2.*, coalesce(moved, 0) AS moved, coalesce(best, 0) AS best, coalesce(subjects, []) AS subjects, elsewhere <> '' AND countries < 2 AND NOT wide AND (elsewhere = 'world' OR coalesce(moved, 0) <> 0) AS local,
    round(term_noise + {_NOISE} + CASE WHEN outlet IN {_list(CONFIG["low_value"]["names"])} THEN {CONFIG["low_value"]["penalty"]} ELSE 0 END + CASE WHEN outlet <> '' AND lower(trim(coalesce(title, ''))) = outlet THEN {CONFIG["bare_name"]} ELSE 0 END
      + (CAST(outlet IN {_list(CONFIG["blocked"])} AS INT) + CAST(script AS INT)) * {CONFIG["blocked_noise"]}, 4) AS noise, concat_ws(',', {_WATCH}) AS watch FROM a2 LEFT JOIN mv USING (id) LEFT JOIN sj USING (id)),
  a4 AS (SELECT *, coalesce(tier IN {_list(CONFIG["curated_tiers"])}, false) AS curated, CASE tier {" ".join(f"WHEN {_q(k)} THEN {v}" for k, v in rules.TIER_WEIGHT.items())} ELSE 1.0 END + least(signal, 4.0) + CASE WHEN len(subjects) > 0 THEN least(best / 4.0, 2.0) ELSE -{CONFIG["no_subject"]} END - noise AS raw FROM a3),
  a5 AS (SELECT *, CASE WHEN local AND NOT curated THEN least(raw - {_P["local"]}, {CONFIG["reject_score"]}) WHEN elsewhere <> '' AND kind = 'news' AND NOT curated THEN raw - CASE elsewhere WHEN 'near' THEN {_P["near"]} ELSE {_P["world"]} END
    WHEN NOT (at_home OR watch <> '' OR exempt) AND tier IN {_list(CONFIG["home_tiers"])} AND kind = 'news' THEN raw - {_P["home"]} ELSE raw END AS lowered FROM a4),
  analysed AS (SELECT *, CASE WHEN script THEN '{analysis.SCRIPT}' WHEN outlet IN {_list(CONFIG["blocked"])} THEN '{analysis.BLOCKED}' WHEN noise >= {CONFIG["reject_noise"]} THEN '{analysis.NOISY}' WHEN local AND NOT curated THEN '{analysis.LOCAL}' ELSE '' END AS rejected,
    round(CASE WHEN noise >= {CONFIG["reject_noise"]} OR len(subjects) = 0 THEN least(lowered, {CONFIG["reject_score"]}) ELSE lowered END, 4) AS score FROM a5)"""


@query(f"""WITH {ANALYSED_SQL} SELECT id, array_to_string(subjects, ',') AS subjects, elsewhere, local, CAST(signal AS DOUBLE) AS signal, CAST(noise AS DOUBLE) AS noise, watch, rejected, CAST(score AS DOUBLE) AS score,
  CASE {" ".join(f"WHEN score >= {cut} THEN '{name}'" for name, cut in rules.GRADES)} ELSE 'LOW' END AS grade FROM analysed""")
def analysed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with what the rules of the file make of it."""
    d = analysis.analysed(items(spark, sf_dir), CONFIG)
    return d.select("id", F.array_join("subjects", ",").alias("subjects"), "elsewhere", "local", "signal", "noise", F.array_join("watch", ",").alias("watch"), "rejected", "score", "grade")


_T = CONFIG["topic"]
_FITS = " ".join(f"WHEN {_q(name)} THEN len(list_intersect(subjects, [{', '.join(map(_q, t['subj']))}])) > 0" for name, t in CONFIG["topics"].items())


@query(f"""WITH {ANALYSED_SQL}, s0 AS (SELECT id, subjects FROM analysed), t0 AS (WITH {sets_sql({"topics": (rule_files.bucket_rules(CONFIG["topics"]), analysis.TOPIC_FIELDS)})}
    SELECT id, bucket, term, max(factor) AS factor, max(weight) AS weight FROM hit GROUP BY ALL),
  t1 AS (SELECT id, bucket, sum(weight * factor) AS score, max(weight) >= {_T["strong"]} AS strong, count(*) AS terms FROM t0 GROUP BY ALL),
  t2 AS (SELECT id, bucket AS topic, round(score + CASE WHEN CASE bucket {_FITS} ELSE false END THEN {_T["bonus"]} ELSE 0 END, 4) AS score, strong, terms FROM t1 JOIN s0 USING (id)),
  t3 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS rank, max(score) OVER (PARTITION BY id) AS top FROM t2 WHERE score >= {_T["least"]} AND (strong OR terms >= 2))
  SELECT id, topic, score, rank FROM t3 WHERE rank <= {_T["most"]} AND score >= top * {_T["second"]}""")
def ruled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every item by the file's terms and the subjects found before."""
    return analysis.analysed_topics(items(spark, sf_dir), CONFIG).withColumn("rank", F.col("rank").cast("long"))
