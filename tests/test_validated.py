"""What a model returned, checked field by field against plain Python."""

from __future__ import annotations

import random

from quillstream.operators.validated import Field, validated

SCHEMA = [
    Field("up", "number", 3, mandatory=True), Field("why", "text", 20, mandatory=True), Field("terms", "list", 3, grounded=True), Field("places", "list", 2, among="places", mandatory=True),
    Field("mcqs", "questions", 2),
]
PLACES = ["delhi", "goa", "port blair"]
ROWS = "id long, title string, up int, why string, terms array<string>, places array<string>, mcqs array<struct<q:string,options:array<string>,answer:int>>"


def plain(r):
    faults, out = [], {}
    _, title, up, why, terms, places, mcqs = r
    if up is not None and not 0 <= up <= 3:
        faults.append("up: out of bounds")
    out["up"] = up if up is not None and 0 <= up <= 3 else None
    if out["up"] is None:
        faults.append("up: missing")
    why = " ".join((why or "").split()) or None
    if why and len(why) > 20:
        faults.append("why: clipped")
        cut = why[:20]
        why = (cut.rsplit(" ", 1)[0] if " " in cut else cut) + "…"
    out["why"] = why
    if why is None:
        faults.append("why: missing")
    for name, xs, ok, reason, cap in (("terms", terms, lambda x: x.lower() in (title or "").lower(), "not in the source", 3), ("places", places, lambda x: x.lower() in PLACES, "not of places", 2)):
        xs = [x.strip(" ") for x in xs or [] if x is not None and x.strip(" ")]
        stay = [x for x in xs if ok(x)]
        once = [x for k, x in enumerate(stay) if x.lower() not in [y.lower() for y in stay[:k]]]
        for count, why_ in ((len(xs) - len(stay), reason), (len(stay) - len(once), "repeated"), (len(once) - cap, "beyond the cap")):
            if count > 0:
                faults.append(f"{name}: {why_} {count}")
        out[name] = once[:cap]
        if name == "places" and not once:
            faults.append("places: missing")
    good = [q for q in mcqs or [] if q and q[0] and q[0].strip() and q[1] and len(q[1]) == 4 and len({o for o in q[1] if o and o.strip()}) == 4 and q[2] is not None and 0 <= q[2] <= 3]
    if mcqs and len(mcqs) > len(good):
        faults.append(f"mcqs: not four options and an answer {len(mcqs) - len(good)}")
    if len(good) > 2:
        faults.append(f"mcqs: beyond the cap {len(good) - 2}")
    out["mcqs"] = good[:2]
    return out, faults, not any(f.endswith(": missing") for f in faults)


def test_rows_are_checked_against_the_schema(spark):
    rng = random.Random(4)
    pick = lambda xs, n: rng.choice([None, [rng.choice(xs) for _ in range(rng.randint(0, n))]])
    qs = [("Q?", ["a", "b", "c", "d"], 0), ("Q?", ["a", "b", "c", "c"], 1), ("Q?", ["a", "b", "c"], 1), ("Q?", ["a", "b", "c", "d"], 4), ("", ["a", "b", "c", "d"], 1), ("R?", ["a", None, "c", "d"], 1), (None, None, None), ("S?", ["1", "2", "3", "4"], 3), None]
    rows = [
        (k, rng.choice([None, "Delhi court on Goa", "port Blair and delhi court"]), rng.choice([None, -1, 0, 2, 3, 4]), rng.choice([None, "", "  ", "short one", "a text that  is far too long", "w" * 30]), pick(["Delhi", "COURT", "goa", "rain", " ", None, "on", "blair"], 7),
         pick(["Delhi", "DELHI", "Goa", "Port Blair", "Paris", "", None], 5), pick(qs, 5))
        for k in range(250)
    ]
    dims = {"places": spark.createDataFrame([(p,) for p in PLACES + PLACES], "value string")}
    got = {r.id: r for r in validated(spark.createDataFrame(rows, ROWS), SCHEMA, dims, "title").collect()}
    assert len(got) == len(rows)
    for r in rows:
        out, faults, ok = plain(r)
        g = got[r[0]]
        assert (g.up, g.why, g.terms, g.places) == (out["up"], out["why"], out["terms"], out["places"])
        assert [tuple(q) for q in g.mcqs] == [(q[0], q[1], q[2]) for q in out["mcqs"]]
        assert (g.faults, g.is_valid) == (faults, ok)
