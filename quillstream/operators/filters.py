"""Predicates of the record model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_list(host: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or lies under one."""
    ok = host.isin(*domains)
    for d in domains:
        ok = ok | host.endswith("." + d)
    return ok


def all_words(haystack: Column, needle: str) -> Column:
    """Every word of `needle` stands somewhere in the haystack; none asks for nothing."""
    ok = F.lit(True)
    for w in needle.lower().split():
        ok = ok & F.contains(F.lower(haystack), F.lit(w))
    return ok


def content_kind(own: Column, title: Column, path: Column) -> Column:
    """news, editorial or explained: the source's own mark, then the headline, then the URL's path."""
    return (
        F.when(own.isin("editorial", "explained"), own)
        .when(title.rlike(r"(?i)^(opinion|editorial|column)\b"), "editorial")
        .when(title.rlike(r"(?i)^(explained|what is|why|how)\b") | title.endswith("?"), "explained")
        .when(path.rlike(r"/(opinion|editorial)/"), "editorial")
        .when(path.rlike(r"/(explained|explainers)/"), "explained")
        .otherwise("news")
    )


def admitted(title: Column, url: Column, age_days: Column, *, most_days: int = 35) -> Column:
    """Long enough a title, an URL, and not too old."""
    return (F.length(F.coalesce(title, F.lit(""))) >= 8) & url.isNotNull() & (url != "") & (age_days <= most_days)


def near_day(a: Column, b: Column, days: int = 2) -> Column:
    """Within so many days of each other; an unknown day passes."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(True))


def text_language(title: Column) -> Column:
    """hi, en or other by script."""
    return F.when(title.rlike("[\\u0900-\\u097F]"), "hi").when(title.rlike("[A-Za-z]"), "en").otherwise("other")
