"""Token counts of byte-level BPE with word ends, by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that were not counted before lie one after the other in one numpy array
of symbols. In each round every sequence finds its own lowest-ranked pair and joins all places of
that pair at once; what is left when no sequence has a pair is counted. Counts of pre-tokens are
remembered in a cache of a bounded number of entries.

The vocabulary file is a parameter and read where it lies on the driver; its merges are broadcast
(their size is that of the vocabulary, not of the data). Defined cases: null counts as empty, with
no bytes and no tokens; rows with equal ids are counted one by one; an empty table gives no rows; texts
of any length are counted whole, one at a time; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import chunks

#: Entries of a worker's cache; it is emptied when full.
CACHE_ENTRIES = 1_000_000
#: Pre-tokens merged at once, few enough for their arrays to stay in the processor's cache.
MERGED_AT_ONCE = 4096
#: How the vocabulary's file splits text, \s meaning the White_Space property.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: The same for lower-cased text up to U+017F, for the faster standard engine.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "a-zªµºß-öø-\u017f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"


@dataclass
class WordBpe:
    """Symbols and ranked merges. first[b] and last[b] are the symbols of byte b inside and at the end of a pre-token."""

    first: np.ndarray
    last: np.ndarray
    pairs: np.ndarray  # sorted; left * 2**32 + right
    ranks: np.ndarray
    made: np.ndarray  # by rank
    special: list[str]
    cache: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; len(made) for pairs that do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], len(self.made))


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


def load(path: str) -> WordBpe:
    spec = json.loads(open(path, encoding="utf-8").read())
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    vocabulary, letters = model["vocab"], _byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    return WordBpe(
        np.array([vocabulary[letters[b]] for b in range(256)]),
        np.array([vocabulary[letters[b] + end] for b in range(256)]),
        keys[order],
        order,
        np.array([vocabulary[a + b] for a, b in merges]),
        [t["content"] for t in spec["added_tokens"]],
    )


def merged_counts(words: list[bytes], bpe: WordBpe) -> np.ndarray:
    """Symbols left of each non-empty word after all merges."""
    lengths = np.array([len(w) for w in words])
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = bpe.first[raw]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = bpe.last[raw[ends - 1]]
    out = lengths.copy()
    word = np.repeat(np.arange(len(words)), lengths)  # the word of each symbol
    none = len(bpe.made)
    rank = np.full(len(symbols), none)  # of each symbol with the next
    stale = np.arange(len(symbols))
    while len(symbols):
        stale = stale[stale < len(word) - 1]
        stale = stale[word[stale] == word[stale + 1]]
        rank[stale] = bpe.find(symbols[stale], symbols[stale + 1])
        start = np.flatnonzero(np.diff(word, prepend=-1))
        low = np.minimum.reduceat(rank, start)
        sizes = np.diff(np.append(start, len(word)))
        out[word[start]] = sizes
        of = np.repeat(low, sizes)
        going = of < none  # a word without a pair is done
        at = np.flatnonzero((rank == of) & going)
        # a pair of equal symbols can overlap itself: within a run of neighbours every second one merges
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[nth % 2 == 0]
        symbols[at] = bpe.made[rank[at]]
        rank[at] = none
        rank[at[at > 0] - 1] = none
        going[at + 1] = False
        now = (np.cumsum(going) - 1)[at]
        symbols, word, rank = symbols[going], word[going], rank[going]
        stale = np.unique(np.concatenate([now, now[now > 0] - 1]))
    return out


_SPLIT = regex.compile(PRE_TOKENS)
_LATIN = re.compile(f"[{LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_NUMBERS}{LATIN_LETTERS}]+")
_BEYOND = re.compile("[^\0-\u017f]")


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # letter by letter, so no final sigma
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pre_tokens(text: str) -> list[str]:
    text = _normal(text)
    return (_SPLIT if _BEYOND.search(text) else _LATIN).findall(text)


def count_tokens(texts: list[str | None], bpe: WordBpe) -> list[int]:
    special = regex.compile("|".join(map(regex.escape, bpe.special))) if bpe.special else None
    found, extra = [], []
    for t in texts:
        t, n = t or "", 0
        if special and any(s in t for s in bpe.special):
            parts = special.split(t)
            n = len(parts) - 1
            found.append([x for p in parts for x in pre_tokens(p)])
        else:
            found.append(pre_tokens(t))
        extra.append(n)
    cache = bpe.cache
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    new = list({x for f in found for x in f if x not in cache})
    for k in range(0, len(new), MERGED_AT_ONCE):
        part = new[k : k + MERGED_AT_ONCE]
        cache.update(zip(part, merged_counts([x.encode() for x in part], bpe).tolist(), strict=True))
    return [sum(map(cache.__getitem__, f)) + n for f, n in zip(found, extra, strict=True)]


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document."""
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, "text"):
            n = count_tokens(batch.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return d.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
