"""Rows that a model returned, checked against a schema: what holds is kept, and a column says what fell out and why.

A schema is a list of fields. Numbers have bounds, texts a length to which they are clipped at a word, lists a cap, and
their entries may have to be of a dimension table, to stand in the source text, and to differ from each other. Questions need
four different options and an answer among them. Membership is a join with the dimension, so that
dimensions may be large; everything else is expressions of the row.

A fault is "field: reason"; of lists each reason counts its entries. A row whose mandatory fields are not all there is not valid.
Null rows of lists are empty; ids are unique.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """kind: number (least, most), text (most characters), list (most entries) or questions (most of them)."""

    name: str
    kind: str
    most: float
    least: float = 0
    mandatory: bool = False
    among: str | None = None  # the dimension of a list's entries
    grounded: bool = False  # entries stand in the source


QUESTION = "q string, options array<string>, answer int"


def _clip(text: Column, most: int) -> Column:
    """At most so many characters, whole words, with an ellipsis where something was cut."""
    cut = F.regexp_replace(F.left(text, F.lit(most)), r"\s+\S*$", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def _reason(name: str, reason: str, count: Column) -> Column:
    return F.when(count > 0, F.concat(F.lit(f"{name}: {reason} "), count.cast("string")))


def validated(rows: DataFrame, schema: list[Field], dimensions: dict[str, DataFrame], source: str) -> DataFrame:
    """`rows` (id, the fields, and the column `source`) with valid fields, `faults` (array) and `is_valid`.

    A dimension has one column, value, in lower case; entries are compared and differ in any case.
    """
    d = rows.withColumn("faults", F.array().cast("array<string>"))
    add = lambda df, *faults: df.withColumn("faults", F.concat("faults", F.filter(F.array(*faults), lambda x: x.isNotNull())))
    for f in schema:
        c = F.col(f.name)
        if f.kind == "number":
            d = add(d, F.when(c.isNotNull() & ~c.between(f.least, f.most), f"{f.name}: out of bounds"))
            d = d.withColumn(f.name, F.when(c.between(f.least, f.most), c))
        elif f.kind == "text":
            d = d.withColumn(f.name, F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")))
            d = add(d, F.when(F.length(f.name) > int(f.most), f"{f.name}: clipped"))
            d = d.withColumn(f.name, _clip(F.col(f.name), int(f.most)))
        elif f.kind == "questions":
            good = lambda q: (F.size(F.array_distinct(F.filter(q["options"], lambda o: F.trim(o) != ""))) == 4) & (F.size(q["options"]) == 4) & q["answer"].between(0, 3) & (F.trim(q["q"]) != "")
            kept = F.filter(F.coalesce(c, F.slice(f.name, 1, 0)), lambda q: F.coalesce(good(q), F.lit(False)))
            d = d.withColumn("_kept", F.coalesce(kept, F.filter(F.from_json(F.lit("[]"), d.schema[f.name].dataType), lambda q: F.lit(True))))
            d = add(d, _reason(f.name, "not four options and an answer", F.coalesce(F.size(c) - F.size("_kept"), F.lit(0))), _reason(f.name, "beyond the cap", F.size("_kept") - int(f.most)))
            d = d.withColumn(f.name, F.slice("_kept", 1, int(f.most))).drop("_kept")
        else:
            none = F.array().cast("array<string>")
            d = d.withColumn("_all", F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(x)), lambda x: x != ""))
            if f.among:
                e = d.select("id", F.explode(F.transform("_all", F.lower)).alias("value")).distinct().join(dimensions[f.among].select("value").distinct(), "value", "left_semi")
                d = d.join(e.groupBy("id").agg(F.collect_set("value").alias("_known")), "id", "left")
                known = F.coalesce("_known", none)
                d = d.withColumn("_in", F.filter("_all", lambda x: F.array_contains(known, F.lower(x)))).drop("_known")
            else:
                d = d.withColumn("_in", F.col("_all"))
            text = F.lower(F.coalesce(source, F.lit("")))
            d = d.withColumn("_stands", F.filter("_in", lambda x: F.contains(text, F.lower(x))) if f.grounded else F.col("_in"))
            first = F.filter(F.col("_stands"), lambda x, i: F.array_position(F.transform("_stands", F.lower), F.lower(x)) == i + 1)
            d = d.withColumn("_once", first)
            d = add(
                d, _reason(f.name, f"not of {f.among}", F.size("_all") - F.size("_in")), _reason(f.name, "not in the source", F.size("_in") - F.size("_stands")),
                _reason(f.name, "repeated", F.size("_stands") - F.size("_once")), _reason(f.name, "beyond the cap", F.size("_once") - int(f.most)),
            )
            d = d.withColumn(f.name, F.slice("_once", 1, int(f.most))).drop("_all", "_in", "_stands", "_once")
        if f.mandatory:
            there = F.col(f.name).isNotNull() if f.kind in ("number", "text") else F.size(f.name) > 0
            d = add(d, F.when(~there, f"{f.name}: missing"))
    return d.withColumn("is_valid", ~F.exists("faults", lambda x: x.endswith(": missing")))
