"""Ids of a tokenizer of the library `tokenizers`, with the words that were seen before remembered.

Byte-level vocabularies that split texts by a pattern encode each pre-token on its own. Those are found once by
the library and kept as ragged arrays; a text's ids are gathered from them. Any other kind of
tokenizer is called for whole texts. Special tokens' strings inside a text become their ids, as the library does by default.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice

import numpy as np
import regex
from tokenizers import Tokenizer

#: Pre-tokens that a worker remembers; all are forgotten when there are more.
REMEMBERED = 500_000
#: The pattern of byte-level pre-tokens, \s meaning the White_Space property, and the same for texts up to U+017F.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_SPLIT = regex.compile(PRE_TOKENS)
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_BEYOND = re.compile("[^\0-ſ]")


#: The usual letters for bytes, as byte-level models have them: printable Latin-1 stands for itself, the rest follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER = dict(enumerate(map(chr, range(256)))) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Places(dict):
    """The number of each pre-token seen; a new one gets the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Made from a tokenizer's JSON text, so that workers need no file. With `end`, that id stands behind every text."""

    def __init__(self, spec: str, end: int | None = None) -> None:
        self.spec, self.end = spec, end
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        s = json.loads(spec)
        before, added = s.get("pre_tokenizer") or {}, s.get("added_tokens", [])
        self.known = {t["content"]: t["id"] for t in added}
        plain = all(not t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        self.by_word = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not s.get("normalizer")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.known, key=len, reverse=True))) + ")") if self.known else None
        self._forget()

    def __getstate__(self) -> tuple:
        return self.spec, self.end

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _forget(self) -> None:
        self.place = Places({"": 0})  # the empty word is the end
        ends = [] if self.end is None else [self.end]
        self.flat, self.start = np.array(ends, np.int32), np.array([0, len(ends)], np.int64)

    def _words(self, text: str) -> list[str]:
        if self.special and any(k in text for k in self.known):
            parts = self.special.split(text)
            return list(chain.from_iterable([p] if i % 2 else self._words(p) for i, p in enumerate(parts)))
        return (_SPLIT if _BEYOND.search(text) else _LATIN).findall(text)

    def _learn(self) -> None:
        """Ids of the words that have a number but no ids yet, by the library's model."""
        words = list(islice(self.place, len(self.start) - 1, None))
        if not words:
            return
        written = b"\xff".join(w.encode() for w in words).decode("latin-1").translate(_LETTER).split(_LETTER[255])
        one = self.tokenizer.model.tokenize
        found = [[self.known[w]] if w in self.known else [t.id for t in one(x)] for w, x in zip(words, written, strict=True)]
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f) for f in found])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and where each begins, with the end of the last."""
        if not self.by_word:
            end = [] if self.end is None else [self.end]
            found = [e.ids + end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.int32), np.cumsum([0] + [len(f) for f in found])
        if len(self.place) > REMEMBERED:
            self._forget()
        words = [self._words(t) for t in texts]
        for ws in words:
            ws.append("")
        counts = np.cumsum([0] + [len(ws) for ws in words])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, counts[-1])
        self._learn()
        first = self.start[at]
        sizes = self.start[at + 1] - first
        ends = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[counts]
