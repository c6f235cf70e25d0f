"""Words of many texts at once, found and hashed over one UTF-8 buffer with numpy.

A text's words are maximal runs of bytes that a table of 256 entries keeps; the table also
lower-cases A-Z. All bytes from 0x80 on belong to words, so runs of bytes are runs of code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def byte_table(separators: bytes) -> np.ndarray:
    """Byte to byte: 0 for separators, a-z for A-Z unless they are separators, others as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: [^\x20\x09-\x0D]+
SPACE_WORDS = byte_table(b"\0\x20\x09\x0a\x0b\x0c\x0d")
SPACE_WORDS[0] = 1  # NUL is part of a word; 1 stands for it in hashes only together with the byte 1
#: lower-cased, then [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        n = 1 << (n - 1).bit_length()
        for k, r in (("p", _ODD), ("i", _INV)):
            a = np.full(n, r, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


@dataclass
class Words:
    """Words of some texts: byte spans in `buf`, a 64-bit hash each, and per text the range of its words."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def bytes_at(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: pa.Array, keep: np.ndarray) -> Words:
    """Null texts count as empty."""
    col = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    col = pc.binary_join_element_wise(col, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0, np.uint8)
    buf = keep[raw]
    word = np.empty(len(buf) + 1, np.int8)
    word[0] = 0
    np.not_equal(buf, 0, out=word[1:].view(bool))
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(buf * power[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(buf, starts, ends, hashes, np.searchsorted(starts, offsets - offsets[0]))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the hashes of each text's n-word shingles, with repeats; a text of fewer words has one."""
    counts, total = w.counts(), len(w.hashes)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    if not total:
        return np.zeros(0, np.uint64), first
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        h *= _ODD
        h += padded[k : k + total]
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], per)
    out = h[at]
    for d in np.flatnonzero((counts < n) & (counts > 0)):  # the whole sequence as one shingle
        v = int(counts[d])
        for x in w.hashes[w.first[d] : w.first[d + 1]].tolist():
            v = (v * int(_ODD) + x) & 0xFFFFFFFFFFFFFFFF
        out[first[d]] = v
    return mix(out), first
