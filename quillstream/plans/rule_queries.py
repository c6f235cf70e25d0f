"""Classification queries: term scores, subjects, grades, tags, routing. The rules are of words that the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import filters, rules, terms
from quillstream.plans.registry import query
from quillstream.sources.tables import ITEMS_SQL, items, read

SUBJECTS = [
    ("economy", "the", 0.6), ("economy", "thion", 2.0), ("economy", "erat", 1.5), ("polity", "of", 0.7), ("polity", "that", 1.2), ("polity", "was", 1.0),
    ("science", "it", 0.9), ("science", "with", 1.4), ("science", "this", 1.8), ("world", "la", 1.0), ("world", "der", 1.0), ("world", "die", 0.8),
    ("world", "que", 1.1), ("culture", "and", 0.5), ("culture", "from", 1.6), ("culture", "les", 1.2), ("culture", "und", 0.9),
]
SIGNALS = [("signal", "is", 0.8), ("signal", "for", 0.7), ("signal", "en", 0.6), ("signal", "by", 1.1)]
NOISE = [("noise", "be", 0.6), ("noise", "not", 1.0), ("noise", "as", 0.4)]
SYLLABUS = [("growth", "the", 1.0), ("growth", "erat", 2.5), ("rights", "that", 1.5), ("rights", "of", 1.0), ("space", "it", 1.5), ("space", "on", 1.0), ("history", "and", 1.0), ("history", "from", 2.0)]
PAPERS = {"economy": "GS3", "science": "GS3", "polity": "GS2", "world": "GS2", "culture": "GS1"}
ORDER = ("GS1", "GS2", "GS3", "GS4")
#: Words stand between spaces, as engines differ in what a word boundary is beside accented letters.
TAGS = {"report": r"(?i)(^|\s)(er|re|in)[ .,]", "act": r"(?i)(^|\s)the .* of ", "court": r"(?i)(^|\s)(la|das|el) "}
WATCH = [r"(?i)(^|\s)(the|der|la) ", r"(?i)(^|\s)(of|und|de) "]
INTENTS = [(r"(?i)(^|\s)(what|who|where) |\?$", "ask"), (r"(?i)(^|\s)(the|of) .* and ", "explain"), (r"(?i) for ", "plan"), (r"(?i)^[a-z]+ ", "search")]


def _values(table: list[tuple[str, str, float]]) -> str:
    return "(VALUES " + ", ".join(f"('{b}', '{t}', CAST({w} AS DOUBLE))" for b, t, w in table) + ") AS r(bucket, term, weight)"


def _terms_sql(table: list[tuple[str, str, float]], fields: dict[str, float]) -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT id, unnest(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+')) AS term, CAST({f} AS DOUBLE) AS factor, {k} AS field FROM items" for k, (c, f) in enumerate(fields.items()))
    return f"SELECT id, bucket, round(sum(weight * factor), 4) AS score, count(DISTINCT term) AS terms FROM ({parts}) JOIN {_values(table)} USING (term) GROUP BY id, bucket"


_BOTH = {"title": 2.0, "body": 1.0}
#: Signals count half in the body, noise three tenths in its beginning.
_SIGNAL_FIELDS, _NOISE_FIELDS = {"title": 1.0, "body": 0.5}, {"title": 1.0, "left(body, 400)": 0.3}
_SCORES = f"WITH {ITEMS_SQL}, scores AS ({_terms_sql(SUBJECTS, _BOTH)})"
_RANKED = f"{_SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, bucket) AS rank FROM scores WHERE score >= 2.5)"
_TAG_SQL = " + ".join(f"CASE WHEN regexp_matches(title, '{p}') THEN 1 ELSE 0 END" for p in TAGS.values())
_TIER = "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TIER_WEIGHT.items()) + " ELSE 1.0 END"
GRADED_SQL = f"""{_SCORES}, best AS (SELECT id, max(score) AS best FROM scores GROUP BY id), sig AS ({_terms_sql(SIGNALS, _SIGNAL_FIELDS)} UNION ALL {_terms_sql(NOISE, _NOISE_FIELDS)}),
  s AS (SELECT id, sum(score) FILTER (WHERE bucket = 'signal') AS signal, sum(score) FILTER (WHERE bucket = 'noise') AS noise FROM sig GROUP BY id),
  graded AS (SELECT items.id, day, kind, tier, publisher, title, round({_TIER} + least(coalesce(signal, 0), 4.0) + CASE WHEN coalesce(best, 0) > 0 THEN least(best / 4.0, 2.0) ELSE -1.5 END
    + least(({_TAG_SQL}) * 0.5, 1.5) - coalesce(noise, 0), 4) AS score FROM items LEFT JOIN best USING (id) LEFT JOIN s USING (id)),
  g AS (SELECT *, CASE WHEN score >= 5.5 THEN 'NOTE' WHEN score >= 3.2 THEN 'SKIM' WHEN score >= 1.6 THEN 'READ' ELSE 'LOW' END AS grade FROM graded)"""


def subject_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.weighted_terms(items(spark, sf_dir), SUBJECTS, _BOTH)


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with score (4 places) and grade."""
    i = items(spark, sf_dir)
    best = subject_scores(spark, sf_dir).groupBy("id").agg(F.max("score").alias("best"))
    s = rules.weighted_terms(i, SIGNALS, _SIGNAL_FIELDS).union(rules.weighted_terms(i, NOISE, _NOISE_FIELDS))
    s = s.groupBy("id").agg(F.sum(F.when(F.col("bucket") == "signal", F.col("score"))).alias("signal"), F.sum(F.when(F.col("bucket") == "noise", F.col("score"))).alias("noise"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    d = i.join(best, "id", "left").join(s, "id", "left")
    score = rules.item_score(F.col("tier"), z("signal"), z("best"), F.size(rules.matching_tags(F.col("title"), TAGS)), z("noise"))
    return d.withColumn("score", F.round(score, 4)).withColumn("grade", rules.grade(F.col("score"))).drop("body", "best", "signal", "noise")


@query(f"{_SCORES} SELECT id, bucket, round(score, 4) AS score, terms FROM scores")
def weighted_term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_scores(spark, sf_dir).withColumn("score", F.round("score", 4))


@query(f"{_RANKED} SELECT id, bucket AS subject, rank FROM ranked WHERE rank <= 3")
def subject_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.leading_buckets(subject_scores(spark, sf_dir), least=2.5).select("id", F.col("bucket").alias("subject"), F.col("rank").cast("long").alias("rank"))


@query(f"{GRADED_SQL} SELECT id, score, grade FROM g")
def graded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("id", "score", "grade")


@query(f"""{GRADED_SQL}, n AS (SELECT day, count(DISTINCT publisher) AS sources FROM g GROUP BY day),
  r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, id) AS rank FROM g)
  SELECT day, rank, id, title, score, grade, sources FROM r JOIN n USING (day) WHERE rank <= 3""")
def top_stories_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstream.operators.windows import top_n

    g = graded(spark, sf_dir)
    n = g.groupBy("day").agg(F.countDistinct("publisher").alias("sources"))
    return top_n(g, ["day"], [F.desc("score"), F.col("id")], 3).join(n, "day").select("day", F.col("rank").cast("long").alias("rank"), "id", "title", "score", "grade", "sources")


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT lower(title) AS k, count(DISTINCT publisher) AS n FROM items GROUP BY 1)
  SELECT k, n, round(least(0.8 * log2(greatest(n, 1)), 3.0), 4) AS bonus, round(CASE WHEN n % 5 = 0 THEN 0.0 ELSE 2.0 + least(0.8 * log2(greatest(n, 1)), 3.0) END, 4) AS score FROM c""")
def coverage_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = items(spark, sf_dir).groupBy(F.lower("title").alias("k")).agg(F.countDistinct("publisher").alias("n"))
    best = F.when(F.col("n") % 5 == 0, 0.0).otherwise(2.0)
    return c.select("k", "n", F.round(rules.coverage_bonus(F.col("n")), 4).alias("bonus"), F.round(rules.story_score(best, F.col("n")), 4).alias("score"))


@query(f"""WITH {ITEMS_SQL} SELECT id, concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(title, '{p}') THEN '{n}' END" for n, p in TAGS.items())}) AS tags,
  {" AND ".join(f"regexp_matches(title, '{p}')" for p in WATCH)} AS watched FROM items""")
def tags_and_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    watched = rules.all_groups(F.col("title"), WATCH)
    return i.select("id", F.array_join(rules.matching_tags(F.col("title"), TAGS), ",").alias("tags"), watched.alias("watched"))


@query(f"""{_RANKED}, p AS (SELECT DISTINCT id, CASE bucket {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAPERS.items())} END AS paper FROM ranked WHERE rank <= 3)
  SELECT id, string_agg(paper, ',' ORDER BY paper) AS papers FROM p GROUP BY id""")
def papers_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rules.leading_buckets(subject_scores(spark, sf_dir), least=2.5).groupBy("id").agg(F.collect_list("bucket").alias("subjects"))
    return s.select("id", F.array_join(rules.papers(F.col("subjects"), PAPERS, ORDER), ",").alias("papers"))


@query(f"""WITH {ITEMS_SQL}, scores AS ({_terms_sql(SYLLABUS, _BOTH)}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, bucket) AS rank, max(score) OVER (PARTITION BY id) AS top FROM scores WHERE score >= 2.0 AND (terms >= 2 OR score >= 4.0)),
  t AS (SELECT id, bucket FROM r WHERE rank <= 2 AND score >= top / 2), ai AS (SELECT doc_id AS id, 'checked' AS bucket FROM labels WHERE quality = 0 AND toxic = 0)
  SELECT id, bucket AS topic, 'rules' AS origin FROM t WHERE id NOT IN (SELECT id FROM ai) UNION ALL SELECT id, bucket, 'ai' FROM ai""")
def syllabus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = rules.weighted_terms(items(spark, sf_dir), SYLLABUS, _BOTH).where("score >= 2.0 and (terms >= 2 or score >= 4.0)")
    s = s.withColumn("top", F.max("score").over(Window.partitionBy("id")))
    own = rules.leading_buckets(s, least=2.0, most=2).where("score >= top / 2").select("id", F.col("bucket").alias("topic"), F.lit("rules").alias("origin"))
    ai = read(spark, sf_dir, "labels").where("quality = 0 and toxic = 0").select(F.col("doc_id").alias("id"), F.lit("checked").alias("topic"), F.lit("ai").alias("origin"))
    return own.join(ai, "id", "left_anti").union(ai)


@query(f"""SELECT conv_id, turn, CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in INTENTS)} ELSE 'none' END AS intent FROM conversations WHERE text IS NOT NULL""")
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", rules.first_match(F.col("text"), INTENTS, "none").alias("intent"))


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT CASE WHEN kind <> 'news' AND id % 3 = 0 THEN kind WHEN regexp_matches(title, '(?i)^(opinion|editorial|column)\\b') THEN 'editorial'
    WHEN regexp_matches(title, '(?i)^(explained|what is|why|how)\\b') OR title LIKE '%?' THEN 'explained' WHEN id % 7 = 0 THEN 'editorial' WHEN id % 11 = 0 THEN 'explained' ELSE 'news' END AS k, publisher FROM items)
  SELECT k AS kind, count(*) AS n, count(DISTINCT publisher) AS sources FROM k GROUP BY 1""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("id") % 7 == 0, "/opinion/x").when(F.col("id") % 11 == 0, "/explained/x").otherwise("/news/x")
    own = F.when((F.col("kind") != "news") & (F.col("id") % 3 == 0), F.col("kind"))
    i = items(spark, sf_dir).withColumn("k", filters.content_kind(own, F.col("title"), path))
    return i.groupBy(F.col("k").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("publisher").alias("sources"))


@query(f"""WITH {ITEMS_SQL} SELECT id FROM items WHERE length(title) >= 8 AND day <= 20 AND contains(lower(title || ' ' || coalesce(body, '')), 'the') AND contains(lower(title || ' ' || coalesce(body, '')), 'and')""")
def admitted_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    hay = F.concat("title", F.lit(" "), F.coalesce("body", F.lit("")))
    return i.where(filters.admitted(F.col("title"), F.lit("u"), F.col("day"), most_days=20) & filters.all_words(hay, "the and")).select("id")


#: Phrases, words with a capital, and words with plurals, some inside others.
PHRASES = [
    ("places", "in the", 2.0), ("places", "of the", 1.5), ("places", "of the oran", 4.0), ("names", "The", 1.0), ("names", "And", 0.5), ("names", "A", 0.5),
    ("words", "thion", 2.0), ("words", "the", 0.25), ("words", "erat", 1.0), ("words", "on of", 1.0), ("words", "de la", 1.0), ("words", "la", 0.5),
]


def _phrases_sql(table: list[rules.Rule], fields: dict[str, float]) -> str:
    forms = sorted({(f.form, f.is_exact, f.term, b, w, len(f.form.split(" ")) * 2 - 1) for b, t, w in table for f in terms.forms_of(t)})
    values = ", ".join(f"('{f}', {x}, '{t}', '{b}', CAST({w} AS DOUBLE), {n})" for f, x, t, b, w, n in forms)
    most = max(x[-1] for x in forms)
    p = " UNION ALL ".join(f"SELECT id, '{c}' AS field, CAST({f} AS DOUBLE) AS factor, regexp_extract_all(regexp_replace(coalesce({c}, ''), '[\\s\\-]+', ' ', 'g'), '[A-Za-z0-9]+|[^A-Za-z0-9]') AS p FROM items" for c, f in fields.items())
    return f"""f(form, exact, term, bucket, weight, n) AS (VALUES {values}), p AS ({p}), lens AS (SELECT DISTINCT n FROM f),
  w AS (SELECT id, field, factor, unnest(p) AS x0, generate_subscripts(p, 1) AS i FROM p),
  l AS (SELECT *, {", ".join(f"lead(x0, {k}) OVER (PARTITION BY id, field ORDER BY i) AS x{k}" for k in range(1, most))} FROM w),
  runs AS (SELECT id, field, factor, i, n, CASE n {" ".join(f"WHEN {n} THEN {' || '.join(f'x{k}' for k in range(n))}" for n in range(1, most + 1))} END AS run FROM l, lens WHERE lower(x0) IN ({", ".join(sorted({f"'{x[0].lower().split(' ')[0]}'" for x in forms}))})),
  hits AS (SELECT DISTINCT id, field, factor, f.exact, i, runs.n, term FROM runs JOIN f ON runs.n = f.n AND ((f.exact AND run = form) OR (NOT f.exact AND lower(run) = form))),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, field, exact, i ORDER BY length(term) DESC, n DESC) AS rn FROM hits) WHERE rn = 1),
  ways AS (SELECT id, field, factor, exact, list_reduce(list({{'i': i, 'stop': i + n, 'terms': [term]}} ORDER BY i), lambda a, x: CASE WHEN x.i < a.stop THEN a ELSE {{'i': x.i, 'stop': x.stop, 'terms': list_concat(a.terms, x.terms)}} END) AS w FROM best GROUP BY ALL),
  m AS (SELECT DISTINCT id, field, factor, exact, unnest(w.terms) AS term FROM ways)
  SELECT id, bucket, round(sum(weight * factor), 4) AS score, count(DISTINCT term) AS terms FROM m JOIN (SELECT DISTINCT term, exact, bucket, weight FROM f) USING (term, exact) GROUP BY ALL"""


@query(f"WITH {ITEMS_SQL}, {_phrases_sql(PHRASES, _BOTH)}")
def phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by phrases, capitals and plurals, in title and body."""
    return rules.scored(terms.matched(items(spark, sf_dir), PHRASES, _BOTH))
