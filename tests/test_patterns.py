"""Regular expressions by their literals: what is needed, and the same matches as running every pattern on every text."""

from __future__ import annotations

import random
import re

import pytest

from quillstream.operators import patterns
from quillstream.operators.patterns import PatternRule
from quillstream.plans.pattern_queries import TAG_RULES, TITLE_RULES


@pytest.mark.parametrize(("pattern", "literals"), [
    ("approv(?:ed|al)", {"approv"}), ("(?:bill|act) passed", {" passed"}), ("(?:bill|ordinance)s?", {"bill", "ordinance"}), ("(?:x|[0-9]+)y?", None), ("a*b+", None), ("a*(?:bb)+", {"bb"}), ("[A-Z]{3}", None),
    ("(?:Supreme|High) Court", {" court"}), ("(ab|cd){2,}e", {"ab", "cd"}), ("(?:ab)?", None), ("\\bexercise\\b", {"exercise"}), ("é[0-9]", None), ("(?-i:MoU) signed", {" signed"}), ("", None),
])
def test_what_a_match_must_contain(pattern, literals):
    assert patterns.needed(pattern) == (None if literals is None else frozenset(literals))


def test_rules_match_as_if_each_was_run(spark):
    rules = [PatternRule(b, p, w) for b, p, w in [
        ("law", "bill", 1.0), ("law", "bills? passed", 2.0), ("law", "(?:bill|billing) act", 4.0), ("court", "a.?b", 8.0), ("court", "[0-9]{2}", 16.0), ("odd", "\\.\\.\\.|\\*\\*", 32.0), ("odd", "^il", 64.0), ("odd", "(?-i:Bi)", 128.0),
    ]]
    rng = random.Random(1)
    texts = [None, "", "BILL", "Billing Act", "bills passed bill act", "a b ab 12", "..*** il", "ill Bi bi"] + ["".join(rng.choice(["bill", "ing", " act", "s passed", "a", "b", "1", "22", ".", "*", "il", "Bi", " ", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    out = patterns.with_matches(d, "t", rules, "m").withColumns({b: patterns.weight("m", rules, b) for b in ("law", "court", "odd")}).withColumn("names", patterns.buckets("m", rules))
    assert out.columns == ["id", "t", "m", "law", "court", "odd", "names"]
    for r in out.collect():
        hits = [k for k, rule in enumerate(rules) if re.search("(?i)" + rule.pattern, r.t or "") and r.t is not None]
        assert r.m == hits, r.t
        assert (r.law, r.court, r.odd) == tuple(sum(rules[k].weight for k in hits if rules[k].bucket == b) for b in ("law", "court", "odd"))
        assert r.names == list(dict.fromkeys(rules[k].bucket for k in hits))


def test_the_headline_rules_are_indexed():
    assert len(TITLE_RULES) + len(TAG_RULES) >= 70
    indexed = [r for r in TITLE_RULES if patterns.needed(r.pattern)]
    assert len(indexed) >= 0.85 * len(TITLE_RULES)
