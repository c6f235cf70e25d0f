"""Benchmark decontamination with suffix arrays over the corpus.

Every batch of documents is a shard. Its suffix array holds the word positions from which a window
of benchmark words can start, sorted by the words that follow; every benchmark suffix is searched
in it by bisection, which gives all places where its window occurs verbatim. Neighbouring windows
on the same diagonal join to the longest verbatim match. The benchmark is held in blocks of a
bounded size, each a broadcast; the corpus is never shuffled for one block.

Defined cases: a null or wordless document has no hits; a benchmark item with a null id or without
words is left out; rows with the same doc_id are judged one by one, in whatever number of blocks;
items with one id count once; empty tables of either kind give no hits; texts of any length are
searched whole, one at a time; other columns are passed on by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bytewords import ALNUM_WORDS, words_of
from quillstream.llm.shared import chunks, spare

#: Bytes of benchmark text in a block; its index takes about 15 times that. One block is broadcast at a time.
BLOCK_BYTES = 4 << 20
WINDOW = 13
HITS = "doc_id bigint, doc_key bigint, n_words bigint, items array<bigint>, spans array<struct<start:bigint,end:bigint>>, longest bigint, longest_start bigint, longest_item bigint"


@dataclass
class Suffixes:
    """One block of benchmark items, ready to be searched: a byte string of word ids for each distinct window."""

    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place + 1
    spelling: list[bytes]
    tests: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # width -> least and greatest suffix that begins with each window; its (item, place) list by offset
    window: int

    @property
    def least(self) -> int:
        return min(self.tests, default=0)


def suffixes(items: list[tuple[int, str]], window: int = WINDOW) -> Suffixes:
    w = words_of(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS)
    vocabulary, first = np.unique(w.hashes, return_index=True)
    ids = np.searchsorted(vocabulary, w.hashes) + 1
    by_width: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    for k, (item, _) in enumerate(items):
        a, b = w.first[k], w.first[k + 1]
        width = min(window, b - a)
        for p in range(a, b - width + 1) if width else ():
            by_width.setdefault(int(width), []).append((ids[p : p + width].astype(np.uint32), item, p - a))
    tests = {}
    for width, found in by_width.items():
        rows, of = np.unique(np.array([x[0] for x in found]), axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        offsets = np.searchsorted(of.ravel()[order], np.arange(len(rows) + 1))
        depth = max(by_width)
        low = _keys(rows, depth)
        tests[width] = low, low if width == depth else _keys(rows, depth, 0xFFFFFFFF), np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order], offsets
    return Suffixes(vocabulary, [w.bytes_at(i) for i in first], tests, window)


def _keys(rows: np.ndarray, width: int, fill: int = 0) -> np.ndarray:
    """Rows of ids as byte strings of equal length that compare like the rows."""
    out = np.full((len(rows), width), fill, ">u4")
    out[:, : rows.shape[1]] = rows
    return out.view(f"S{4 * width}").ravel()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, index) for every index in each [lo, hi)."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def search(texts: pa.Array, index: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All verbatim windows in a shard: words of each text, words before each text, then (text, word, width, item, place in item)."""
    w = words_of(texts, ALNUM_WORDS)
    total, none = len(w.hashes), np.zeros(0, np.int64)
    if not total or not index.tests:
        return w.counts(), w.first, none, none, none, none
    at = np.minimum(np.searchsorted(index.vocabulary, w.hashes), len(index.vocabulary) - 1)
    ids = np.where(index.vocabulary[at] == w.hashes, at + 1, 0)
    ends = w.first[1:][w.doc_of()] - np.arange(total)
    while True:  # how many known words follow each place, itself included; its text may end before
        stops = np.append(np.flatnonzero(ids == 0), total)
        run = stops[np.searchsorted(stops, np.arange(total))] - np.arange(total)
        place = np.flatnonzero(np.minimum(run, ends) >= index.least)
        if not len(place):
            return w.counts(), w.first, none, none, none, none
        reach = np.unique(np.minimum(place[:, None] + np.arange(max(index.tests)), total - 1))
        wrong = [p for p in reach.tolist() if ids[p] and w.bytes_at(p) != index.spelling[ids[p] - 1]]
        if not wrong:
            break
        ids[wrong] = 0  # other words with a benchmark word's hash
    depth = max(index.tests)
    ahead = place[:, None] + np.arange(depth)
    inside = np.arange(depth) < np.minimum(run, ends)[place][:, None]
    keys = _keys(np.where(inside, ids[np.minimum(ahead, total - 1)], 0), depth)
    order = np.argsort(keys, kind="stable")
    place, keys = place[order], keys[order]  # the suffix array
    out: list[list[np.ndarray]] = [[], [], [], []]
    for width, (least, most, item, at_item, offsets) in index.tests.items():
        lo = np.searchsorted(keys, least, "left")
        hi = np.searchsorted(keys, most, "right")
        which, k = _ranges(lo, hi)
        if len(k):
            again, j = _ranges(offsets[which], offsets[which + 1])
            for x, v in zip(out, (place[k][again], np.full(len(j), width), item[j], at_item[j]), strict=True):
                x.append(v)
    found = [np.concatenate(x) if x else none for x in out]
    return w.counts(), w.first, *found


def _longest(text: np.ndarray, word: np.ndarray, width: np.ndarray, item: np.ndarray, place: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Per text the longest run of windows on one diagonal: (words, first word, item); ties go to the first word, then the lesser item."""
    order = np.lexsort((word, word - place, item, text))
    text, word, width, item, place = (x[order] for x in (text, word, width, item, place))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (word[1:] - place[1:] != word[:-1] - place[:-1]) | (word[1:] - word[:-1] > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    length = word[last] + width[last] - word[first]
    best = np.lexsort((item[first], word[first], -length, text[first]))
    out: dict[int, tuple[int, int, int]] = {}
    for b in best.tolist():
        out.setdefault(int(text[first[b]]), (int(length[b]), int(word[first[b]]), int(item[first[b]])))
    return out


def _rows(batch: pa.RecordBatch, index: Suffixes) -> pa.RecordBatch:
    counts, before, word, width, item, place = search(batch.column("text"), index)
    n = len(counts)
    text = np.searchsorted(before, word, "right") - 1
    items: list[list[int]] = [[] for _ in range(n)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    best: dict[int, tuple[int, int, int]] = {}
    if len(word):
        pairs = np.unique(np.stack([text, item], 1), axis=0)
        for d, i in pairs.tolist():
            items[d].append(i)
        change = np.zeros(before[-1] + 1, np.int64)
        np.add.at(change, word, 1)
        np.add.at(change, word + width, -1)
        hit = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8)])
        for d in np.unique(text).tolist():
            own = np.append(hit[before[d] + 1 : before[d + 1] + 1], 0)
            step = np.diff(own, prepend=0)
            spans[d] = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
        best = _longest(text, word - before[text], width, item, place)
    take = lambda k: pa.array([best[d][k] if d in best else (0 if not k else None) for d in range(n)], pa.int64())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), batch.column("doc_key"), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind), take(0), take(1), take(2)],
        names=["doc_id", "doc_key", "n_words", "items", "spans", "longest", "longest_start", "longest_item"],
    )


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Suffixes]:
    """The benchmark as searchable blocks; the driver holds one block at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = size // block_bytes + 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield suffixes([(r[0], r[1]) for r in part.collect()], window)


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, doc_key (a hash of its text), n_words, n_hit, items, and the longest verbatim match with its place and item."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("doc_key"))
    parts = []
    for block in blocks_of(benchmark, window, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(d.mapInArrow(lambda it, held=held: (_rows(b, held.value) for b in chunks(it, "text")), HITS))
    if len(parts) == 1:
        return parts[0].withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")).drop("spans")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    best = F.max_by(F.struct("longest", "longest_start", "longest_item"), F.struct("longest", -F.col("longest_start"), -F.col("longest_item")))
    out = out.groupBy("doc_id", "doc_key", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), best.alias("b"))
    union = "aggregate(spans, struct(0L as n, 0L as top), (a, s) -> struct(a.n + greatest(s.end - greatest(s.start, a.top), 0L) as n, greatest(a.top, s.end) as top)).n"
    out = out.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), "n_words", "items", "b.longest", "b.longest_start", "b.longest_item", F.expr(union).alias("n_hit"))
    # back to the rows: those with equal id and text have one result
    rows = d.select("doc_id", "doc_key").join(out, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("doc_key").eqNullSafe(F.col("_key")))
    return rows.select("doc_id", "doc_key", "n_words", "items", "longest", "longest_start", "longest_item", "n_hit")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """A twentieth of the words or more lie in benchmark windows."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, window, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is not None:
        bad_id, bad_key = spare(docs, "_bad_id"), spare(docs, "_bad_key")
        bad = matches(docs, benchmark, window=window, block_bytes=block_bytes).where(contaminated()).select(F.col("doc_id").alias(bad_id), F.col("doc_key").alias(bad_key)).distinct()
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad_id]) & (F.xxhash64(docs["text"].cast("string")) == bad[bad_key]), "left_anti")
    held = spark.sparkContext.broadcast(first)

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, "text"):
            counts, before, word, width, _, _ = search(batch.column("text"), held.value)
            change = np.zeros(before[-1] + 1, np.int64)
            np.add.at(change, word, 1)
            np.add.at(change, word + width, -1)
            hits = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
            n_hit = hits[before[1:]] - hits[before[:-1]]
            yield batch.filter(pa.array((n_hit == 0) | (n_hit * 20 < counts)))

    return docs.mapInArrow(clean, docs.schema)
