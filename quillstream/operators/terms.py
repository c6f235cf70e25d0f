"""Weighted terms of one or more words in texts: whole words, capitals where they tell, plurals, longest first.

A term of one word with a capital letter is matched as it is written, every other term in any case.
Spaces in terms stand for any white space and hyphens. Terms in lower case match their plural in -s
or -es too, single capitalised ones that in -s. Where terms overlap, the leftmost counts, of those
that begin together the longest. Each distinct term of a text counts once.

A text is split once into words and what stands between them. Only runs that begin with a term's first
word, and are as long as a term is, become rows and are joined with the terms on equal text; which of
them overlap is decided in the text's own array. So nothing is scanned once for each term, and the
terms, which are configuration, are broadcast.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.rules import Rule


class Form(NamedTuple):
    """One way to write a term: what to look for, exactly or in lower case, and the term it stands for."""

    form: str
    is_exact: bool
    term: str


def normal(text: str) -> str:
    return re.sub(r"[\s\-]+", " ", text.strip())


def forms_of(term: str) -> list[Form]:
    term = normal(term)
    exact = " " not in term and any(c.isupper() for c in term)
    key = term if exact else term.lower()
    endings = [""]
    if key and key[-1].isalpha() and (exact or key.islower()):
        endings += ["s", "es"] if key.islower() else ["s"]
    return [Form(key + e, exact, key) for e in endings] if term else []


#: Every place but those inside a word, inside a character of two units, and the end. Cutting there is half the work of listing what matches.
_BETWEEN = r"(?<![A-Za-z0-9](?=[A-Za-z0-9]))(?![\x{DC00}-\x{DFFF}]|\z)"


def pieces(text: Column) -> Column:
    """Words, and the single characters between them; white space and hyphens are one space."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\-]+", " ")
    return F.split(plain, _BETWEEN)


def matched(texts: DataFrame, rules: list[Rule], fields: dict[str, float]) -> DataFrame:
    """(id, field, factor, term, bucket, weight): the distinct terms of each field, a column or expression of `texts`."""
    return matched_sets(texts, {"": (rules, fields)}).drop("set")


def matched_sets(texts: DataFrame, sets: dict[str, tuple[list[Rule], dict[str, float]]]) -> DataFrame:
    """(id, set, field, factor, term, bucket, weight): `matched` for several sets of rules, each with its own fields.

    Texts are split once for all sets; terms overlap within a set only.
    """
    spark = texts.sparkSession
    forms = {(name, *f) for name, (rules, _) in sets.items() for _, term, _ in rules for f in forms_of(term)}
    if not forms:
        return spark.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, set string, field string, factor double, term string, bucket string, weight double")
    split = lambda s: re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]", s)
    lengths = sorted({len(split(form)) for _, form, _, _ in forms})
    heads = sorted({split(form)[0].lower() for _, form, _, _ in forms})
    fields = sorted({c for _, own in sets.values() for c in own})
    known = F.broadcast(spark.createDataFrame(sorted((*f, c, float(factor)) for f in forms for c, factor in sets[f[0]][1].items()), "set string, form string, is_exact boolean, term string, field string, factor double"))
    # all fields in one read of the table
    d = texts.select("id", F.inline_outer(F.array(*(F.struct(F.lit(c).alias("own"), F.expr(c).alias("text")) for c in fields)))).select("id", "own", pieces(F.col("text")).alias("p"))
    # rows instead of lambdas, which are not compiled; the outer form, as the plain one would split each text again to filter by it
    d = d.select("id", "own", "p", F.posexplode_outer("p").alias("at", "x")).where(F.lower("x").isin(heads))
    # null at the end of a text
    runs = F.array(*(F.struct(F.lit(n).alias("n"), F.concat(*(F.get("p", F.col("at") + k) for k in range(n))).alias("run")) for n in lengths))
    d = d.select("id", "own", (F.col("at") + 1).alias("start"), F.inline_outer(runs)).where("run is not null")
    found = d.join(known, (F.col("own") == F.col("field")) & (F.lower("run") == F.lower("form"))).where("not is_exact or run = form")
    # longest first among those that begin together, the term itself before a plural
    order = F.struct(F.col("start"), (-F.length("term")).alias("longest"), (-F.col("n")).alias("n"), F.col("term"))
    kept = found.groupBy("id", "set", "field", "factor", "is_exact").agg(F.array_sort(F.collect_list(order)).alias("m"))
    kept = kept.withColumn("m", F.expr("aggregate(m, struct(cast(array() as array<string>) as terms, 0 as stop), (a, x) -> if(x.start < a.stop, a, struct(if(array_contains(a.terms, x.term), a.terms, array_append(a.terms, x.term)) as terms, x.start - x.n as stop)), a -> a.terms)"))
    weighed = {(name, f.term, f.is_exact, bucket, float(w)) for name, (rules, _) in sets.items() for bucket, term, w in rules for f in forms_of(term)}
    weights = F.broadcast(spark.createDataFrame(sorted(weighed), "set string, term string, is_exact boolean, bucket string, weight double"))
    return kept.select("id", "set", "field", "factor", "is_exact", F.explode("m").alias("term")).join(weights, ["set", "term", "is_exact"]).select("id", "set", "field", "factor", "term", "bucket", "weight")
