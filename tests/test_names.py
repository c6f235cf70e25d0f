"""Names by a trie in a table, against plain Python; thousands of names make no longer plan."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillstream.operators import names


def found(text, gazetteer):
    w = re.findall("[A-Za-z0-9]+", text or "")
    own = {}
    for name, kind in gazetteer:
        key = tuple(x.lower() for x in re.findall("[A-Za-z0-9]+", name))
        if key:
            own[key] = min(own.get(key, (kind, name)), (kind, name))
    hits = []
    for i in range(len(w)):
        best = max((n for n in range(1, len(w) - i + 1) if tuple(x.lower() for x in w[i : i + n]) in own), default=0)
        if best:
            kind, name = own[tuple(x.lower() for x in w[i : i + best])]
            hits.append((i, i + best, name, kind))
    return [a for a in hits if not any(b[0] < a[0] and b[1] >= a[1] for b in hits)]


GAZETTEER = [("Delhi", "place"), ("New Delhi", "place"), ("New Delhi Declaration", "body"), ("Delhi Declaration Summit", "body"), ("Jammu and Kashmir", "state"), ("Kashmir", "place"), ("Kashmir", "body"), ("  ", "place"), ("Port-Blair", "place"), ("Blair", "person")]


def test_names_in_the_order_of_the_text(spark):
    rng = random.Random(3)
    words = ["new", "Delhi", "declaration", "Summit", "jammu", "and", "KASHMIR", "port", "Blair", "x", "-", ","]
    texts = [None, "", "In New Delhi, Delhi and Port Blair.", "New Delhi Declaration Summit"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    g = spark.createDataFrame([*GAZETTEER, (None, "place")], "name string, kind string")
    hits = names.hits(d, "t", g)
    got = {}
    for r in hits.collect():
        got.setdefault(r.id, []).append((r.start, r.stop, r.name, r.kind))
    expected = {i: f for i, t in enumerate(texts) if (f := found(t, GAZETTEER))}
    assert {i: sorted(x) for i, x in got.items()} == expected
    order = {}
    for r in sorted(names.in_order(hits).collect(), key=lambda r: r.place):
        order.setdefault(r.id, []).append(r.name)
    assert order == {i: list(dict.fromkeys(x[2] for x in f)) for i, f in expected.items()}
    near = sorted((r.id, r.name, r.partner) for r in names.neighbours(hits, "place", "person", 2).collect())
    assert near == sorted((i, a[2], b[2]) for i, f in expected.items() for a, b in zip(f, f[1:], strict=False) if (a[3], b[3]) == ("place", "person") and b[0] - a[1] <= 2)
    assert not names.hits(d, "t", g.limit(0)).collect()


def test_ten_thousand_names_are_a_table(spark):
    made = lambda n: spark.range(n).select(F.concat(F.lit("name"), F.col("id"), F.lit(" of place"), (F.col("id") % 97)).alias("name"), F.lit("k").alias("kind"))
    d = spark.createDataFrame([(1, "name77 of place77 and name9999 of place8"), (2, "name5 of place6")], "id long, t string")
    hits = names.hits(d, "t", made(10_000))
    assert sorted((r.id, r.name) for r in hits.collect()) == [(1, "name77 of place77"), (1, "name9999 of place8")]
    size = lambda n: len(names.hits(d, "t", made(n))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(10_000) == size(10)


def test_titled_persons(spark):
    d = spark.createDataFrame([(1, "Minister Asha Rao Devi Sen met the minister for home and Minister Li."), (2, None), (3, "minister")], "id long, t string")
    assert sorted((r.id, r.start, r.stop, r.name) for r in names.titled(d, "t", ["Minister"]).collect()) == [(1, 0, 4, "Asha Rao Devi"), (1, 11, 13, "Li")]


def test_partners(spark):
    r = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "a", "y"), (4, "b", "z"), (5, "b", "w")], "id long, name string, partner string")
    assert sorted(map(tuple, names.partners(r).collect())) == [("a", "y", 2, 1), ("b", "w", 1, 1)]
