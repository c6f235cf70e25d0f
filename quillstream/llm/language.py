"""Language identification of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

Every word is scored for each learned language by its letter trigrams; the script of its first
letter narrows the languages that can have written it. The best path through the words, which pays
a penalty for each change of language, labels spans. A document's language is the one with most
letters in its spans (ties: the first in sorted order), its score that language's share of letters.

The model is fitted on a bounded number of labelled rows (`sample_rows`, chosen by a hash of the
id); its size is languages x 65,536 counts. Defined cases: null text, or text without a letter, is
`und` with score 0; a script that no language was learned in speaks for none; without labelled rows
all is `und`; rows with a null id are predicted but never learned from; rows with equal ids are
labelled one by one; an empty table gives no rows; texts of any length are labelled whole, in memory
of words x languages; other columns are passed on by `keep_identified`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import chunks

#: Most rows that the model is fitted on, in expectation.
SAMPLE_ROWS = 20_000
SLOTS = 1 << 16
#: Cost of a change of language between two words, in nats.
SWITCH = 10.0
#: What a word costs a language that was not learned in the word's script.
FOREIGN_SCRIPT = 30.0
CACHE_ENTRIES = 150_000
#: First code points of ranges of letters, and the script each range belongs to.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x31F0, "Kana"), (0x3400, "Han"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB50, "Arabic"), (0xFE00, "Latin"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_NAMES = sorted({s for _, s in SCRIPT_RANGES})
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPT_RANGES])
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LATIN_WORD = re.compile("[a-zªµºß-öø-ſ]+")
_BEYOND = re.compile("[^\0-ſ]")


def words_in(text: str | None) -> list[str]:
    """Lower-cased words of letters."""
    if not text:
        return []
    text = text.lower()
    return (_WORD if _BEYOND.search(text) else _LATIN_WORD).findall(text)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of all trigrams, where each word's begin, script of each word); a word is held between two spaces."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(lengths + 2)[:-1]])
    h = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) * np.uint64(0x9E3779B1) + points[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    slots = ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(lengths.sum()) + np.repeat(begin - first, lengths)
    script = _SCRIPT[np.searchsorted(_FIRST, points[begin + 1], "right") - 1]
    return slots[at], first, script


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # slot x language, log probabilities
    scripts: np.ndarray  # script x language, the cost of a word in that script
    switch: float = SWITCH
    cache: dict[str, int] = field(default_factory=dict)
    known: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "known": None}

    def ids(self, words: list[list[str]]) -> np.ndarray:
        """A row of `known` for every word, in one array."""
        if self.known is None or len(self.cache) > CACHE_ENTRIES:
            self.cache, self.known = {}, np.zeros((0, len(self.languages)), np.float32)
        new = list({x for w in words for x in w if x not in self.cache})
        if new:
            slots, first, script = _grams(new)
            rows = np.add.reduceat(self.scores[slots], first, axis=0) - self.scripts[script]
            rows -= rows.max(1, keepdims=True)
            self.cache.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.known = np.concatenate([self.known, rows.astype(np.float32)])
        return np.fromiter((self.cache[x] for w in words for x in w), np.int64, sum(map(len, words)))


def _paths(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word; the texts' words lie at first[d]:first[d + 1] and none is empty."""
    n, kinds = scores.shape
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    totals = np.add.reduceat(scores.astype(np.float64), first[:-1], axis=0)
    top = totals.argmax(1)
    out = top[doc]
    # One language is best throughout if no stretch of words favours another by half the penalty: m stretches
    # would then gain m/2 penalties at most and cost m - 1 of them at least; for m = 1 the totals decide.
    ahead = scores - scores[np.arange(n), out][:, None]
    sums = np.concatenate([np.zeros((1, kinds)), np.cumsum(ahead, 0, np.float64)])
    doc_floor = doc[:, None] * (2 * np.abs(sums).max() + 1)
    lowest = np.minimum.accumulate(sums[:-1] - doc_floor, 0) + doc_floor
    mixed = np.flatnonzero(np.maximum.reduceat((sums[1:] - lowest).max(1), first[:-1]) > switch / 2)
    mixed = mixed[np.argsort(-sizes[mixed], kind="stable")]
    if not len(mixed):
        return out
    start, size = first[:-1][mixed], sizes[mixed]
    best = scores[start].astype(np.float64)
    back = np.zeros((int(size.sum()), kinds), np.min_scalar_type(kinds))
    at, steps = 0, []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))  # those of more than t words
        b = best[:live]
        from_top = b.argmax(1)
        jump = b[np.arange(live), from_top] - switch
        stay = b >= jump[:, None]
        back[at : at + live] = np.where(stay, np.arange(kinds), from_top[:, None])
        best[:live] = np.where(stay, b, jump[:, None]) + scores[start[:live] + t]
        steps.append((at, live))
        at += live
    state = best.argmax(1)
    out[start + size - 1] = state
    for t in range(len(steps), 0, -1):
        at, live = steps[t - 1]
        state[:live] = back[at : at + live][np.arange(live), state[:live]]
        out[start[:live] + t - 1] = state[:live]
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
    """Language, score and spans (first word, words, language) of each text."""
    words = [words_in(t) for t in texts]
    langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    full = [d for d, w in enumerate(words) if w]
    if not full or not model.languages:
        return langs, scores, spans
    words = [words[d] for d in full]
    ids = model.ids(words)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    path = _paths(model.known[ids], first, model.switch)
    letters = np.fromiter((len(x) for w in words for x in w), np.int64, len(ids))
    kinds = len(model.languages)
    doc = np.repeat(np.arange(len(words)), np.diff(first))
    held = np.bincount(doc * kinds + path, letters, len(words) * kinds).reshape(-1, kinds)
    top = held.argmax(1)
    share = held[np.arange(len(words)), top] / held.sum(1)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(path)))
    for b, n in zip(begin.tolist(), length.tolist(), strict=True):
        d = doc[b]
        spans[full[d]].append((int(b - first[d]), n, model.languages[path[b]]))
    for d, k, s in zip(full, top.tolist(), share.tolist(), strict=True):
        langs[d], scores[d] = model.languages[k], s
    return langs, scores, spans


def learned_from() -> F.Column:
    """The rows that may be learned from; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, switch: float = SWITCH) -> Model:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(learned_from() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in chunks(it, "text"):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).extend(words_in(text))
            for lang, words in by.items():
                if words:
                    slots, _, script = _grams(words)
                    own = grams.setdefault(lang, np.zeros(SLOTS + len(_NAMES), np.int64))
                    own += np.bincount(np.concatenate([slots, script + SLOTS]), minlength=len(own))
        for lang, own in grams.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "slot", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    own = np.zeros((SLOTS + len(_NAMES), len(languages)))
    of = {x: k for k, x in enumerate(languages)}
    own[counts["slot"].to_numpy(), [of[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    grams, scripts = own[:SLOTS] + 0.1, own[SLOTS:]
    written = scripts >= 0.001 * scripts.sum(0, keepdims=True)
    cost = np.where(written | ~written.any(1, keepdims=True), 0.0, FOREIGN_SCRIPT)
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), cost.astype(np.float32), switch)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the spans of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, "text"):
            lang, score, spans = predict(batch.column("text").to_pylist(), held.value)
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
            spans = pa.array([[{"first_word": a, "n_words": n, "lang": x} for a, n, x in s] for s in spans], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("held_out", F.coalesce(~learned_from(), F.lit(False)))
    return d.mapInArrow(label, "doc_id bigint, held_out boolean, lang_pred string, score double, spans array<struct<first_word:bigint,n_words:bigint,lang:string>>")


def keep_identified(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """The documents in which one language holds `least` of the letters or more, with their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, "text"):
            _, score, _ = predict(batch.column("text").to_pylist(), held.value)
            yield batch.filter(pa.array(np.array(score) >= least))

    return docs.mapInArrow(keep, docs.schema)
