"""Dates, paragraphs, sentences and names in texts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.functions import reading as r


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["on 5th January 2024 at", "January 5, 2024:", "x 2024-01-05 y", "notice 05.01.2024"])
def test_text_day(spark, text):
    assert one(spark, r.text_day(F.lit(text))) == dt.date(2024, 1, 5)


def test_no_day(spark):
    assert one(spark, r.text_day(F.lit("May be 45 of them"))) is None
    assert one(spark, r.relative_day(F.lit("3 days ago"), F.lit("2024-01-10").cast("date"))) == dt.date(2024, 1, 7)
    assert one(spark, r.relative_day(F.lit("soon"), F.lit("2024-01-10").cast("date"))) is None


def test_paragraphs_and_sentences(spark):
    body = "The ministry said that the scheme would be extended to all of the districts by March."
    assert one(spark, r.paragraph_ok(F.lit(body), F.lit(10))) and not one(spark, r.paragraph_ok(F.lit(body), F.lit(60)))
    assert not one(spark, r.paragraph_ok(F.lit("Also read: " + body), F.lit(0)))
    assert one(spark, r.usable_sentence(F.lit("The new bridge over the Ganga was opened in 2024 by the minister.")))
    assert not one(spark, r.usable_sentence(F.lit("He opened the new bridge over the Ganga in 2024 with the minister.")))


def test_names(spark):
    assert one(spark, r.named_in_order(F.lit("From Goa to New Delhi and Pune"), ("Delhi", "New Delhi", "Pune", "Goa"))) == ["Goa", "New Delhi", "Pune"]
    assert one(spark, r.spelled_out(F.lit("the Reserve Bank of India said"), F.lit("RBI"))) == "Reserve Bank of India"
    assert one(spark, r.spelled_out(F.lit("nothing here"), F.lit("RBI"))) is None
    assert "semiconductor" in one(spark, r.search_query(F.lit("The Cabinet approves a semiconductor mission in Gujarat"), 3)).split()


def test_verdicts(spark):
    assert one(spark, r.worth(F.lit(None).cast("int"), F.lit("SKIM"))) == 2 and one(spark, r.worth(F.lit(0), F.lit("NOTE"))) == 0
    assert one(spark, r.needs_verdict(F.lit("T"), F.lit(None).cast("string"), F.lit(1), 1))
