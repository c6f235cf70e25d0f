"""Audit of how filters interact: what each one removes, alone and in every order, by a CUBE over failure flags.

Each document gets its failure flags; documents with equal flags and part are counted. A CUBE over the
flags and the part gives, for every subset of filters, the row in which all flags of the subset are false
and the others are rolled up: what survives that subset. A step of an order of filters is then a pair of
subsets, before and after it, and everything else that is reported follows from such pairs.

Exact copies are found by the SHA-256 of the whole text. Each text and part is combined before it is
shuffled, so a text that a third of all documents share is one row of each task. No text is shuffled.

Defined cases: a null text counts as empty and a null part as the empty string; a document without an id is
neither the smaller nor the larger of two, so it is no copy and has no labels; rows of one id are counted
one by one and are copies of what has a smaller id only; labels of one id count if any row has them; an empty
table gives no rows; texts of any length are judged whole; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import written

#: What a word and a white space are.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
COUNTS = ["n", "good", "toxic"]


def failures(text: Column, words: Column, *, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, symbols: str = r"[#$%&*|]") -> dict[str, Column]:
    """The conditions of filters A to D on a text that is not null and the array of its words."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words),
        "C": 100 * capitals > capital_percent * F.length(text),
        "D": text.rlike(symbols),
    }


def flagged(docs: DataFrame, part: str = "lang", **limits: int | str) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) of each document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in failures(F.col("text"), F.col("words"), **limits).items()))


def counted(docs: DataFrame, labels: DataFrame, part: str = "lang", **limits: int | str) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents, and those of them with labels, by part and flags; E marks copies of a smaller id's text."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("q"), F.max(F.col("toxic") == 1).alias("t")).where("doc_id is not null")
    flags = ["A", "B", "C", "D"]
    one = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0)))
    d = flagged(docs, part, **limits).join(known, "doc_id", "left")
    rows = d.groupBy("doc_id", "digest", "part", *flags).agg(F.count(F.lit(1)).alias("n"), one("q").alias("good"), one("t").alias("toxic"))
    # of each text and part: all rows, those of the smallest id, and those without an id
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *COUNTS))).alias("first")
    without = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without")
    texts = rows.groupBy("digest", "part", *flags).agg(*(F.sum(c).alias(c) for c in COUNTS), first, without)
    least = texts.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    texts = texts.join(least, "digest")
    is_first = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    own = {c: F.when(is_first, F.col(f"first.{c}")).otherwise(0) + (F.col("without") if c == "n" else 0) for c in COUNTS}
    kinds = F.array(F.struct(F.lit(False).alias("E"), *(own[c].alias(c) for c in COUNTS)), F.struct(F.lit(True).alias("E"), *((F.col(c) - own[c]).alias(c) for c in COUNTS)))
    out = texts.select("part", *flags, F.inline(kinds)).groupBy("part", *flags, "E").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return out.where("n > 0")


def survivors(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, subset, n, good, toxic): what passes every subset of the filters, as bits in their order, zeros included."""
    names = list(filters)
    cube = counts.cube(*names, "part").agg(*(F.sum(c).alias(c) for c in COUNTS), F.grouping("part").alias("no_part"), *(F.grouping(k).alias(f"no_{k}") for k in names))
    for k in names:  # selected flags are false, the others rolled up
        cube = cube.where((F.col(f"no_{k}") == 1) | ~F.col(k))
    bits = sum((F.when(F.col(f"no_{k}") == 0, 1 << i).otherwise(0) for i, k in enumerate(names)), F.lit(0))
    found = cube.where("no_part = 0").select("part", bits.alias("subset"), *COUNTS)
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))


def steps(passing: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter, before, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each filter after each subset of the others."""
    names, every = list(filters), (1 << len(filters)) - 1
    ways = F.array(*(F.struct(F.lit(k).alias("filter"), F.lit(1 << i).alias("bit")) for i, k in enumerate(names)))
    at = lambda on, *cols: passing.select("part", F.col("subset").alias(on), *(F.col(c).alias(f"{on}_{c}") for c in cols))
    pairs = passing.select("part", F.col("subset").alias("before"), *COUNTS, F.inline(ways)).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    pairs = pairs.withColumns({"after": F.col("before").bitwiseOR(F.col("bit")), "alone": F.col("bit"), "others": every - F.col("bit"), "none": F.lit(0), "all": F.lit(every)})
    pairs = pairs.join(at("after", *COUNTS), ["part", "after"])
    for on in ("alone", "others", "none", "all"):
        pairs = pairs.join(at(on, "n"), ["part", on])
    removed = F.col("n") - F.col("after_n")
    pairs = pairs.select(
        "part", "filter", "before", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("none_n") - F.col("alone_n") - removed).alias("redundant"),
        (F.col("others_n") - F.col("all_n")).alias("unique_fails"), (F.col("good") - F.col("after_good")).alias("good_lost"), (F.col("toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )
    # a subset comes before a filter in as many orders as there are orders of the subset times orders of the rest
    before = F.bit_count("before")
    orders = F.factorial(before) * F.factorial(F.lit(len(names) - 1) - before)
    total = pairs.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return pairs.join(total, ["part", "filter"])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", **limits: int | str) -> DataFrame:
    """One row per part, order of the five filters and step; the flags' counts are written to the shared folder first."""
    filters = "ABCDE"
    at = {k: 1 << i for i, k in enumerate(filters)}
    rows = [("".join(order), i + 1, k, sum(at[x] for x in order[:i])) for order in permutations(filters) for i, k in enumerate(order)]
    orders = F.broadcast(docs.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before int"))  # 600 rows
    found = steps(survivors(written(counted(docs, labels, part, **limits)), filters), filters)
    return found.join(orders, ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
