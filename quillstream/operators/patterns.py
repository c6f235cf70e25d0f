"""Many regular expressions over texts in one pass: an index of the letters that each one needs decides which of them run.

From each pattern a set of literals is derived of which every match must contain one (the longest such set; none if
there is none). All literals make one pattern that finds, in one pass over a text, the longest of them at
every place. A rule is only run where one of its literals was found, so the cost of a text that few
rules concern does not grow with the number of rules. All of it is expressions of one projection: no join, no shuffle.

Patterns are those that Java and Python read alike, matched in any case unless they say otherwise; null texts match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_
from re import _constants as op  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Shorter literals stand in nearly every text and say nothing.
LEAST = 2


class PatternRule(NamedTuple):
    bucket: str
    pattern: str
    weight: float = 1.0


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of literals the one that says more: whose shortest is longer, then the smaller one."""
    if a is None or b is None:
        return a or b
    rank = lambda s: (min(map(len, s)), -len(s))
    return max(a, b, key=rank)


def _needed(tree: Iterable[tuple]) -> frozenset[str] | None:
    best, run = None, ""
    for kind, value in [*tree, (None, None)]:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        if kind is op.SUBPATTERN:
            best = _better(best, _needed(value[3]))
        elif kind is op.BRANCH:
            ways = [_needed(b) for b in value[1]]
            best = _better(best, None if None in ways else frozenset().union(*ways))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            best = _better(best, _needed(value[2]))
    return best


def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern contains one; None if there are none to name."""
    found = _needed(parser.parse(pattern))
    return found if found and min(map(len, found)) >= LEAST else None


def _longest(words: set[str]) -> str:
    """A pattern that matches the longest of the words at a place."""
    heads = sorted({w[0] for w in words if w})
    ways = [("\\" + h if not h.isalnum() else h) + _longest({w[1:] for w in words if w[:1] == h}) for h in heads]
    if not ways:
        return ""
    return f"(?:{'|'.join(ways)})" + ("?" if "" in words else "")


def with_matches(texts: DataFrame, field: str, rules: list[PatternRule], name: str) -> DataFrame:
    """Adds `name`: the numbers of the rules that a column or expression matches, in order."""
    needs = [needed(r.pattern) for r in rules]
    words = set().union(*(n for n in needs if n))
    text, found = f"_text_{name}", f"_found_{name}"
    d = texts.withColumn(text, F.coalesce(F.expr(field), F.lit("")))
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({_longest(words)}))"), F.lit(1))) if words else F.array().cast("array<string>")
    d = d.withColumn(found, hits)
    ways = []
    for k, (rule, need) in enumerate(zip(rules, needs, strict=True)):
        runs = F.col(text).rlike("(?i)" + rule.pattern)
        if need:  # what was found may be a longer literal that begins with one of the rule's
            runs = reduce(or_, (F.array_contains(found, w) for w in sorted(words) if any(w.startswith(n) for n in need))) & runs
        ways.append(F.when(runs, F.lit(k)))
    # inside a higher-order function, since one generated method for all rules would be too long to be compiled to machine code
    return d.withColumn(name, F.filter(F.array(*ways), lambda k: k.isNotNull())).drop(text, found)


def weight(matches: str, rules: list[PatternRule], bucket: str) -> Column:
    """The summed weights of the matched rules of a bucket."""
    own = F.array(*(F.lit(float(r.weight) if r.bucket == bucket else 0.0) for r in rules))
    return F.round(F.aggregate(matches, F.lit(0.0), lambda a, k: a + F.get(own, k)), 4)


def buckets(matches: str, rules: list[PatternRule]) -> Column:
    """The buckets of the matched rules, each once, in the order of the rules."""
    return F.array_distinct(F.transform(matches, lambda k: F.get(F.array(*(F.lit(r.bucket) for r in rules)), k)))
