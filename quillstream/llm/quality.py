"""Weak supervision of document quality: rules vote good, bad or nothing; EM learns how far to trust them.

Only DataFrame functions touch rows. The votes of all documents are counted by pattern (at most
3 ** 9 patterns, whatever the number of documents; those that fail the base rules have their verdict); expectation-maximisation of a two-class model on
those counts gives, for each rule and class, how often it votes good, bad or nothing, and so the
probability that a document is good. There are no labels and there is no sampling.

Defined cases: null text counts as empty; a document without words has zeros everywhere and fails;
rows with equal ids are judged one by one; an empty table has no patterns and no rows; texts of any
length are counted whole, and no rule asks for more or less of a long text; other columns are not
looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import written

SPACE = r"[\\x20\\x09-\\x0D]"
WINDOW, STRETCH = 8, 50


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts for each document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.expr(f"filter(split(text, '{SPACE}+'), w -> w <> '')").alias("words"), F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"))
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[.!?。؟।]", ""))).cast("long").alias("n_stops"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
    )
    # hashes of 1, 2, 4 and 8 neighbouring words
    for step in (1, 2, 4):
        of = f"h, {{}}, greatest(size(h) - {step}, 0)"
        if step == 1:  # distinct words of every stretch of so many words, which do not get fewer in a long text
            varied = f"aggregate(sequence(1, greatest(size(h), 1), {STRETCH}), 0L, (n, i) -> n + size(array_distinct(transform(sequence(i, least(i + {STRETCH - 1}, greatest(size(h), 1))), j -> get(h, j - 1)))))"
            d = d.withColumn("n_varied", F.expr(varied))
        d = d.withColumn("h", F.expr(f"zip_with(slice({of.format(1)}), slice({of.format(1 + step)}), (a, b) -> xxhash64(a, b))"))
    # most documents have no window twice; only the others are sorted
    d = d.withColumn("h", F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x, i))), null)"))
    d = d.withColumn("h", F.expr("sort_array(transform(filter(h, (e, k) -> e.x <=> get(h, k - 1).x or e.x <=> get(h, k + 1).x), e -> e.i))"))
    covered = f"aggregate(h, struct(0L as n, 0 as top), (a, i) -> struct(a.n + (i + {WINDOW} - greatest(i, a.top)) as n, i + {WINDOW} as top), a -> a.n)"
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))).drop("h")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _vote(bad: str, good: str) -> Column:
    return F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end")


#: Rules by name: a condition for bad and one for good; neither is an abstention, and most defects are not evidence of
#: quality where they are missing. Shares are of words, `n_stops` are sentence ends.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.1 * n_words", "false"),
    "marked_words": ("n_symbols > 0.3 * n_words", "false"),
    "dup_lines": ("n_dup_lines > 0.3 * n_lines", "false"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.02 * n_words and n_words >= 50"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 7 * n_words", "word_chars >= 4 * n_words and word_chars <= 6 * n_words"),
    "upper_case": ("n_upper > 0.4 * word_chars", "false"),
    "sentences": ("n_words >= 40 and 100 * n_stops < n_words", "40 * n_stops >= n_words and 4 * n_stops <= n_words"),
    "shouting": ("2 * n_stops > n_words and n_words >= 20", "false"),
    "variety": ("n_words >= 40 and 10 * n_varied < 3 * n_words", "n_words >= 20 and 2 * n_varied >= n_words"),
}
#: What is believed of every rule before any document is seen, and the share of all documents that this belief weighs.
BELIEF = {"good": {-1: 0.005, 1: 0.5}, "bad": {-1: 0.3, 1: 0.3}}
BELIEF_SHARE = 0.02


@dataclass
class Trust:
    """What EM learned: the log-odds of good before any vote, and what each vote of each rule adds."""

    prior: float
    weights: dict[str, dict[int, float]]

    def log_odds(self) -> Column:
        total = F.lit(self.prior)
        for name, by_vote in self.weights.items():
            v = F.col(f"vote_{name}")
            total = total + F.when(v == -1, by_vote[-1]).when(v == 1, by_vote[1]).otherwise(by_vote[0])
        return total


def em(patterns: dict[tuple[int, ...], int], names: list[str], *, rounds: int = 60) -> Trust:
    """Two classes, each with its own distribution of every rule's votes.

    BELIEF stands in for a share of the documents, which keeps rules apart that seldom vote. It starts from documents without
    bad votes as good ones, documents with several as bad ones, and others in between.
    """
    good = {p: 0.05 if p.count(-1) >= 2 else 0.5 if -1 in p else 0.95 for p in patterns}
    weight = 1 + BELIEF_SHARE * sum(patterns.values())
    prior, weights = 0.0, {}
    for _ in range(rounds):
        held = [weight + sum(n * good[p] for p, n in patterns.items()), weight + sum(n * (1 - good[p]) for p, n in patterns.items())]
        prior = math.log(held[0] / held[1])
        weights = {}
        for j, name in enumerate(names):
            count = {v: [weight * BELIEF[k].get(v, 1 - sum(BELIEF[k].values())) for k in ("good", "bad")] for v in (-1, 0, 1)}
            for p, n in patterns.items():
                count[p[j]][0] += n * good[p]
                count[p[j]][1] += n * (1 - good[p])
            total = [sum(c[k] for c in count.values()) for k in (0, 1)]
            weights[name] = {v: math.log(c[0] / total[0]) - math.log(c[1] / total[1]) for v, c in count.items()}
            # a rule may not turn against what it says
            weights[name][-1] = min(weights[name][-1], 0.0)
            weights[name][1] = max(weights[name][1], 0.0)
        before = good
        good = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(weights[n][v] for n, v in zip(names, p, strict=True)))))) for p in patterns}
        if max((abs(good[p] - before[p]) for p in patterns), default=0) < 1e-6:
            break
    return Trust(prior, weights)


def judged(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Counts, votes, base_failed, quality (the posterior probability of good) and kept for each document."""
    s = statistics(docs).withColumns({f"vote_{name}": _vote(*rule) for name, rule in RULES.items()})
    s = written(s)
    names = list(RULES)
    counted = s.where(~base_failed()).groupBy(*(f"vote_{n}" for n in names)).agg(F.count(F.lit(1)).alias("n")).collect()
    trust = em({tuple(r[:-1]): r[-1] for r in counted}, names)
    s = s.withColumn("quality", 1 / (1 + F.exp(-trust.log_odds()))).withColumn("base_failed", base_failed())
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
