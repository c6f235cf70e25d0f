"""Filter audit, fill-in-middle and packing: results against brute force, what edge cases give, and all SQL of the subpackage."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import fill_middle, filter_audit, packing
from quillstream.llm import queries as corpus
from quillstream.llm.byte_ids import Encoder

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(corpus.ORACLE))
def test_rows_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = corpus.QUERIES[name](spark, DATA)
    found = con.execute(corpus.ORACLE[name])
    cols = [c[0] for c in found.description]
    order = sorted(cols)
    assert order == sorted(df.columns)
    expected = sorted(tuple(repr(r[cols.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(repr(r[c]) for c in order) for r in df.collect()) == expected


# filter audit


def audited(docs, labels):
    """Every order walked document by document."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least.get(t, i)}
        fails.append((p or "", {k for k, v in tests.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            gone = []
            for s, k in enumerate(order, 1):
                out_now = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                own = sum(1 for f in fails if f[0] == part and f[1] == {k})
                out[part, "".join(order), s] = [len(left), len(out_now), sum(k in f[1] for f in gone), own, sum(f[2] for f in out_now), sum(f[3] for f in out_now)]
                gone += out_now
                shapley[part, k] += len(out_now)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_filter_audit_is_that_of_every_order(spark):
    rng = random.Random(2)
    texts = [None, "", "few words", "A B C " * 90, "x" * 9000, "same " * 250, " ".join(f"w{k}" for k in range(300)), " ".join(f"W{k}" for k in range(300)) + " #", "\t\n" * 300]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(60)]
    docs += [(None, "few words", "en"), (None, None, None), (7, "few words", "en"), (7, "few words", "de"), (7, "few words", "de"), (-3, "x" * 9000, "zz")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 60, 2)] + [(7, 0, 1), (7, 1, 0), (None, 1, 1), (4, None, None), (999, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, lang string, part int, n_A string").repartition(3)
    found = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert rows == audited(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert not filter_audit.audit(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(filter_audit.audit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()) == 600 * 4


# fill-in-middle


def test_elias_fano_lists_give_back_every_value():
    rng = random.Random(3)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for most in (1, 3, 900):
            values = np.cumsum([rng.randint(1, most) for _ in range(n)], dtype=np.int64)
            packed = fill_middle.elias_fano(values)
            assert [fill_middle.select(k, *packed) for k in range(n)] == values.tolist()
            assert n < 256 or 8 * (len(packed[2]) + len(packed[3])) <= n * (np.log2(values[-1] / n) + 2.2) + 64
    gaps = np.array([1] * 300 + [10**6] + [1] * 300).cumsum()
    packed = fill_middle.elias_fano(gaps)
    assert [fill_middle.select(k, *packed) for k in range(len(gaps))] == gaps.tolist()


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle_of(doc, text):
    text = text or ""
    h = [int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_that_of_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n \t", "one", " lead and tail \n", "héllo wörld 😀 x", "a<P>b c", "<M>", "<S", "P> <", "< S> M>", "a\x00b \x1f c d", "word " * 60000, "P>< S>< M><"]
    rows = [(k if k % 9 else -k, rng.choice(texts) if k % 3 else " ".join(rng.choice(["a", "bb", "<", "S>", "ccc\n", "é", "P>"]) for _ in range(rng.randint(0, 50)))) for k in range(400)]
    rows += [(None, "a b c"), (None, None), (5, "x y"), (5, "x y"), (5, "z")]
    d = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(3)
    out = fill_middle.fill_in_middle(d)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored()).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter((i, *middle_of(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert not fill_middle.fill_in_middle(d.limit(0)).collect()


def test_a_digest_of_two_texts_stops_the_job(spark, monkeypatch):
    monkeypatch.setattr(fill_middle.F, "sha2", lambda c, bits: F.lit("00"))
    d = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="different texts have one digest"):
        fill_middle.indexed(d)[0].collect()


# packing


@pytest.fixture(scope="module")
def encoder():
    return Encoder(open(corpus.vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())


def test_remembered_ids_are_those_of_the_library(encoder):
    rng = random.Random(6)
    letters = list("aB ß'sé\n\t\r\x85  ᠎　\x1c\x1f½²Ⅷ१中文😀́İŀ.,-_<|>") + ["'ll", "<|endoftext|>", "  ", "''s", "\n\n", " 12", "don't", "<|endof", "ſ", "ƀ", "​", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "a" * 5000, "<|endoftext|>"]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, e in ((texts, expected), (texts[::-1], expected[::-1])):
        ids, at = encoder.encode(t)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == e


def checked(rows, examples, limits, *, cut=True):
    """What must hold for any packing: ids once and in place, offsets without gaps, limits kept. Gives lengths by sequence."""
    of = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for seq in of.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == np.cumsum([0] + [r.length for r in seq])[:-1].tolist()
        assert sum(r.length for r in seq) <= limits.tokens and len(seq) <= limits.segments
        loss = 0
        for r in seq:
            mask = examples[r.doc_id][1]
            loss += r.length if mask is None else sum(map(bool, mask[r.start : r.start + r.length]))
        assert loss <= limits.loss
    for doc, (ids, _) in examples.items():
        found = sorted(pieces.pop(doc, []), key=lambda r: r.start)
        assert [x for r in found for x in np.frombuffer(r.ids, "<u4").tolist()] == list(ids)
        assert all(r.doc_tokens == len(ids) and r.length * 4 == len(r.ids) for r in found)
        assert [r.start for r in found] == np.cumsum([0] + [r.length for r in found])[:-1].tolist()
    assert not pieces
    return {k: sum(r.length for r in v) for k, v in of.items()}


def examples_frame(spark, examples):
    return spark.createDataFrame([(k, ids, m, "x") for k, (ids, m) in examples.items()], "doc_id long, ids array<int>, mask array<boolean>, shard string")


def test_packing_keeps_every_limit_and_wastes_nothing(spark):
    rng = random.Random(7)
    examples = {k: ([rng.randint(0, 70000 if k % 5 else 900) for _ in range(rng.choice([0, 1, 2, 5, 40, 300, 900]))], None if k % 3 else "m") for k in range(500)}
    examples = {k: (ids, m and [rng.random() < 0.4 for _ in ids]) for k, (ids, m) in examples.items()}
    limits = packing.Limits(256, 6, 200)
    d = examples_frame(spark, examples)
    lengths = checked(packing.pack(d, limits, rows=500).collect(), examples, limits)
    assert all(n & (n - 1) == 0 for n in lengths.values())
    again = packing.pack(d.repartition(7, "doc_id"), limits, rows=500)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packing.pack(d, limits, rows=500).collect()))
    spread = packing.pack(d, limits, rows=9 * packing.PER_SHARD)
    checked(spread.collect(), examples, limits)
    assert len({r.sequence_id >> 32 for r in spread.collect()}) == 9
    assert not packing.pack(d.limit(0), limits, rows=0).collect()


def test_packing_whole_examples(spark):
    rng = random.Random(8)
    examples = {k: ([k] * rng.randint(1, 120), None) for k in range(300)}
    examples = {k: (ids, [i >= len(ids) // 2 for i in range(len(ids))]) for k, (ids, _) in examples.items()}
    limits = packing.Limits(128, 4, 40)
    rows = packing.pack(examples_frame(spark, examples), limits, rows=300, cut=False).collect()
    lengths = checked(rows, examples, limits)
    whole = {k for k, (ids, m) in examples.items() if sum(m) <= 40}
    assert all(r.length == len(examples[r.doc_id][0]) for r in rows if r.doc_id in whole)  # cut only where nothing else is possible
    tokens = sum(lengths.values())
    assert len(lengths) <= 1.2 * max(tokens / 128, sum(sum(m) for _, m in examples.values()) / 40, len(rows) / 4)


def test_the_dot_product_decides():
    limits = packing.Limits(100, 9, 100)
    piece = lambda tokens, loss: packing.Piece(tokens, 0, tokens, np.zeros(tokens, np.int32), np.append(0, np.arange(tokens) < loss).cumsum())
    pool = packing.Pool(limits)
    for tokens, loss in ((60, 60), (30, 2), (40, 5), (20, 20)):
        pool.put(piece(tokens, loss))
    assert [len(p.ids) for p in pool.fill(cut=False)] == [60, 40]  # 60: 60 + 60; then of 40 and 40 left 40 x 40 + 5 x 40 is the most that fits
    assert [len(p.ids) for p in pool.fill(cut=False)] == [20, 30]  # 20 x 100 + 20 x 100 is more than 30 x 100 + 2 x 100


def test_packed_documents_hold_the_ids_of_the_library(spark, encoder):
    texts = [None, "", "one", "words and words " * 2000, "<|endoftext|> inside", "é😀 中文", "x" * 30000] + ["short text %d" % k for k in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id")]
    d = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, start int")
    examples = {i: ([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], None) for i, t in rows}
    limits = packing.Limits()
    found = packing.pack_texts(d, corpus.vocabulary("byte_bpe_50k.json"), limits, end=1)
    lengths = checked(found.collect(), examples, limits)
    assert all(n & (n - 1) == 0 for n in lengths.values())
    for r in found.withColumn("crc", F.crc32("ids")).collect():
        assert r.crc == zlib.crc32(np.array(examples[r.doc_id][0][r.start : r.start + r.length], "<u4").tobytes())


def test_repeated_rows_are_packed_each(spark):
    d = spark.createDataFrame([(1, [5, 6, 7])] * 50 + [(2, None), (3, [])], "doc_id long, ids array<int>")
    rows = packing.pack(d, packing.Limits(16, 4, 16), rows=50).collect()
    assert sum(r.length for r in rows) == 150 and {r.doc_id for r in rows} == {1}
