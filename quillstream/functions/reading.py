"""Dates, paragraphs, sentences and names inside texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import text as t

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: What furniture of a page begins with.
FURNITURE = r"(?i)^(also read|read more|subscribe|sign up|follow us|advertisement|copyright|©|share this|comments|photo|image|tags?:)"


def text_day(c: Column) -> Column:
    """The first day written in English, 5 January 2024 or January 5, 2024, or as 2024-01-05 or 05.01.2024."""
    low = F.lower(c)
    iso = F.to_date(F.nullif(F.regexp_extract(low, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")))
    dotted = F.try_to_timestamp(F.regexp_extract(low, r"\b(\d{2}\.\d{2}\.\d{4})\b", 1), F.lit("dd.MM.yyyy")).cast("date")
    month = "(" + "|".join(MONTHS) + ")[a-z]*"
    number = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("int")

    def made(pattern: str, d: int, m: int) -> Column:
        get = lambda k: F.regexp_extract(low, pattern, k)
        return F.when(get(3) != "", F.try_to_timestamp(F.concat_ws("-", get(3), F.lpad(number(get(m)).cast("string"), 2, "0"), F.lpad(get(d), 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))

    first = made(rf"\b(\d{{1,2}})(?:st|nd|rd|th)? {month},? (\d{{4}})\b", 1, 2)
    second = made(rf"\b{month} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b", 2, 1)
    return F.coalesce(iso, first, second, dotted)


def relative_day(c: Column, today: Column) -> Column:
    """The day of "3 days ago", "yesterday", "2 weeks ago"."""
    n = F.regexp_extract(F.lower(c), r"(\d+) (day|week|month|hour)s? ago", 1)
    unit = F.regexp_extract(F.lower(c), r"(\d+) (day|week|month|hour)s? ago", 2)
    days = n.try_cast("int") * F.when(unit == "week", 7).when(unit == "month", 30).when(unit == "hour", 0).otherwise(1)
    return F.when(F.lower(c).rlike("yesterday"), F.date_sub(today, 1)).when(n != "", F.date_sub(today, F.coalesce(days, F.lit(0))))


def paragraph_ok(text: Column, link_chars: Column) -> Column:
    """Long enough, shaped like sentences, not furniture, and not more than half links."""
    n = F.length(text)
    return (n >= 60) & text.rlike(r"[.!?]") & ~text.rlike(FURNITURE) & (link_chars * 2 <= n)


def usable_sentence(s: Column) -> Column:
    """10 to 36 words with a figure or a name, no quotation, no leading pronoun, nobody speaking of themselves."""
    n = F.size(F.split(F.trim(s), r"\s+"))
    return n.between(10, 36) & (s.rlike("[0-9]") | s.rlike(r"\s[A-Z][a-z]+")) & ~s.rlike('["“”]') & ~s.rlike(r"(?i)^(he|she|it|they|this|these|that|we|i)\s") & ~s.rlike(r"(?i)(^|\s)(i|we|my|our)\s")


def search_query(title: Column, words: int = 6) -> Column:
    """The longest distinctive words of a title in their order, for asking a search engine."""
    k = t.tokens(title)
    longest = F.slice(F.array_sort(F.transform(k, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, words)
    chosen = F.transform(longest, lambda e: e["w"])
    return F.array_join(F.filter(k, lambda w: F.array_contains(chosen, w)), " ")


def named_in_order(text: Column, names: tuple[str, ...]) -> Column:
    """Names that stand in a text in the order of their first place, without those inside a longer name that is there too."""
    every = F.array(*(F.struct(F.locate(n, text).alias("at"), F.lit(n).alias("n")) for n in names))
    there = F.array_sort(F.filter(every, lambda e: e["at"] > 0))
    return F.transform(F.filter(there, lambda e: ~F.exists(there, lambda o: (o["n"] != e["n"]) & F.contains(o["n"], e["n"]))), lambda e: e["n"])


def spelled_out(text: Column, acronym: Column) -> Column:
    """The first run of capitalised words whose initials spell an acronym; small words may stand between."""
    runs = F.regexp_extract_all(text, F.lit(r"((?:[A-Z][a-z]+(?: (?:of|and|for|the|in))* ?){2,})"), F.lit(1))
    initials = lambda r: F.array_join(F.transform(F.filter(F.split(F.trim(r), " "), lambda w: w.rlike("^[A-Z]")), lambda w: F.left(w, F.lit(1))), "")
    return F.try_element_at(F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: initials(r) == acronym), F.lit(1))


def worth(verdict: Column, grade: Column) -> Column:
    """0 to 3: the verdict, else what the grade stands for."""
    return F.coalesce(verdict, F.when(grade == "NOTE", 3).when(grade == "SKIM", 2).when(grade == "READ", 1).otherwise(0))


def needs_verdict(title: Column, seen_key: Column, revision: Column, current: int) -> Column:
    """Whether a title changed since it was judged, or was judged by older rules."""
    return seen_key.isNull() | (seen_key != F.left(F.sha1(F.concat(F.lit(f"{current}:"), F.lower(title))), F.lit(10))) | (F.coalesce(revision, F.lit(0)) < current)
