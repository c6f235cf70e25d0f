"""Packing of examples into sequences: vector bin packing by dot products under limits on tokens, segments and loss-bearing tokens.

Each example is cut into pieces that keep the limits. A sequence is filled with the piece whose
demands, as shares of the limits, have the largest dot product with what is left of the sequence, as long as one
fits. Where cuts are allowed and nothing fits whole, the piece with the largest product is cut to what is left, and its rest is
placed later. What is at last too short for a sequence is split into sequences whose lengths are powers
of two, which need no padding.

Pieces are dealt into shards by a hash of their id, place and content, so that their number and not the ids decide how large a
shard is; a shard is packed as it streams through a task, from a pool of at most POOL pieces and one batch. Shards are independent of each
other and pieces sorted within them, so a repeated task gives the same sequences.

Defined cases: a null text counts as empty and so has its end mark only; an example without ids has no piece; a null id is a
null in the result; repeated rows are packed each; an empty table gives no rows; an example of any length is cut whole;
a token whose mask is null bears no loss; a null mask means that all tokens bear loss; other columns are not looked at. Ties go to
the kind of piece seen first, and in it to the latest. Without cuts, examples beyond a limit are cut
all the same, at the limit, since they fit in no other way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.byte_ids import Encoder
from quillstream.llm.shared import chunks

#: Examples for which there is a shard, and pieces that wait to be packed in a task.
PER_SHARD, POOL = 4096, 4096
ROWS_AT_ONCE = 1024
_PIECES = "doc_id long, start long, doc_tokens long, ids binary, mask binary"
_PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


class Limits(NamedTuple):
    """Of one sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece:
    """Some of the ids of an example, with how many of the first k bear loss."""

    __slots__ = ("doc", "start", "doc_tokens", "ids", "cum")

    def __init__(self, doc: int | None, start: int, doc_tokens: int, ids: np.ndarray, cum: np.ndarray | None) -> None:
        self.doc, self.start, self.doc_tokens, self.ids, self.cum = doc, start, doc_tokens, ids, cum

    @property
    def loss(self) -> int:
        return len(self.ids) if self.cum is None else int(self.cum[-1] - self.cum[0])

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the first tokens keep both limits."""
        n = min(tokens, len(self.ids))
        return min(n, loss) if self.cum is None else min(n, int(np.searchsorted(self.cum, self.cum[0] + loss, "right")) - 1)

    def cut(self, k: int) -> tuple[Piece, Piece]:
        cum = self.cum
        first = Piece(self.doc, self.start, self.doc_tokens, self.ids[:k], None if cum is None else cum[: k + 1])
        return first, Piece(self.doc, self.start + k, self.doc_tokens, self.ids[k:], None if cum is None else cum[k:])


class Pool:
    """Pieces that wait, by kind: those of equal tokens and loss are alike to the heuristic."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.kind: dict[tuple[int, int], int] = {}
        self.demand = np.empty((64, 2), np.int64)  # tokens and loss of a kind
        self.count = np.zeros(64, np.int64)
        self.waiting: list[list[Piece]] = []
        self.size = 0

    def put(self, piece: Piece) -> None:
        key = (len(piece.ids), piece.loss)
        k = self.kind.get(key)
        if k is None:
            k = self.kind[key] = len(self.waiting)
            if k == len(self.count):
                self.demand, self.count = np.concatenate([self.demand, self.demand]), np.concatenate([self.count, np.zeros_like(self.count)])
            self.demand[k] = key
            self.waiting.append([])
        self.waiting[k].append(piece)
        self.count[k] += 1
        self.size += 1

    def _take(self, k: int) -> Piece:
        self.count[k] -= 1
        self.size -= 1
        return self.waiting[k].pop()

    def fill(self, cut: bool) -> list[Piece]:
        """The pieces of the next sequence."""
        left, out = np.array([self.limits.tokens, self.limits.loss]), []
        while self.size and len(out) < self.limits.segments and left[0]:
            n = len(self.waiting)
            demand, there = self.demand[:n], self.count[:n] > 0
            # every piece takes one segment, so that term is the same for all and left out
            product = demand @ (left / np.array([self.limits.tokens, self.limits.loss]) ** 2) + 1.0
            fits = there & (demand <= left).all(1)
            if cut and len(out) == self.limits.segments - 1:  # the last segment had better end the sequence
                ends = there & (demand[:, 0] >= left[0])
                fits = ends if ends.any() else fits
            if fits.any():
                k = int(np.argmax(np.where(fits, product, 0.0)))
            elif cut:
                k = int(np.argmax(np.where(there, product, 0.0)))
            else:
                break
            piece = self._take(k)
            size = piece.fitting(*left.tolist())
            if size < len(piece.ids):
                if not size:  # no loss-bearing token may follow
                    self.put(piece)
                    break
                piece, rest = piece.cut(size)
                self.put(rest)
            left -= (len(piece.ids), piece.loss)
            out.append(piece)
        if not self.count.any():  # kinds of long ago are not looked through for ever
            self.__init__(self.limits)
        return out


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The same tokens in order, in sequences whose lengths are the powers of two that add up to theirs, the largest first."""
    total, out, todo = sum(len(p.ids) for p in pieces), [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        if need:
            out.append([])
        while need:
            piece = todo.pop()
            if len(piece.ids) > need:
                piece, rest = piece.cut(need)
                todo.append(rest)
            out[-1].append(piece)
            need -= len(piece.ids)
    return out


def sequences(pieces: Iterator[Piece | None], limits: Limits, cut: bool) -> Iterator[list[Piece] | None]:
    """Packed sequences of a stream of pieces; None ends a shard and is passed on after what was packed."""
    pool = Pool(limits)
    for piece in pieces:
        if piece is not None:
            pool.put(piece)
        while pool.size > (POOL if piece is not None else 0):
            made = pool.fill(cut)
            yield from [made] if not cut or sum(len(p.ids) for p in made) == limits.tokens else powers_of_two(made)
        if piece is None:
            pool = Pool(limits)
            yield None


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each, or in four and a mark behind them where some need it."""
    return ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 1 << 16 else ids.astype("<u4").tobytes() + b"\0"


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4", len(data) // 4) if len(data) % 2 else np.frombuffer(data, "<u2")


def _cut(doc: int | None, ids: np.ndarray, cum: np.ndarray | None, limits: Limits) -> Iterator[tuple]:
    """Rows of the pieces of an example that keep the limits."""
    piece = Piece(doc, 0, len(ids), ids, cum) if len(ids) else None
    while piece is not None:
        k = max(1, piece.fitting(limits.tokens, limits.loss))
        first, piece = (piece, None) if k >= len(piece.ids) else piece.cut(k)
        yield first.doc, first.start, first.doc_tokens, _narrow(first.ids), None if first.cum is None else np.diff(first.cum).astype(np.uint8).tobytes()


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[3])
        if held > 1 << 21:
            yield _rows(out, _PIECES)
            out, held = [], 0
    yield _rows(out, _PIECES)


def pieces_of(examples: DataFrame, limits: Limits) -> DataFrame:
    """The pieces of examples (doc_id, ids array<int>, perhaps mask array<boolean>: whether a token bears loss)."""

    def cum_of(mask: pa.Scalar, n: int) -> np.ndarray | None:
        if mask.values is None:
            return None
        bears = mask.values.fill_null(False).to_numpy(zero_copy_only=False)[:n]
        return np.append(0, np.cumsum(np.append(bears, np.zeros(n - len(bears), bool)), dtype=np.int64))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            for doc, ids, mask in zip(*(batch.column(c) for c in ("doc_id", "ids", "mask")), strict=True):
                if ids.values is not None:
                    values = ids.values.to_numpy(zero_copy_only=False)
                    yield from _cut(doc.as_py(), values, cum_of(mask, len(values)), limits)

    mask = F.col("mask").cast("array<boolean>") if "mask" in examples.columns else F.lit(None).cast("array<boolean>")
    e = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"), mask.alias("mask"))
    return e.mapInArrow(lambda it: _batched(rows(it)), _PIECES)


def pieces_of_texts(docs: DataFrame, path: str, limits: Limits, end: int | None = None) -> DataFrame:
    """The pieces of the ids of texts, each text's with the id `end` behind it, by the tokenizer in the file at `path`."""
    held = docs.sparkSession.sparkContext.broadcast(Encoder(open(path, encoding="utf-8").read(), end))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in chunks(it, "text"):
            ids, at = held.value.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc, start, stop in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield from _cut(doc, ids[start:stop], None, limits)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lambda it: _batched(rows(it)), _PIECES)


def place(pieces: DataFrame, limits: Limits, *, rows: int, cut: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): where each piece lies, perhaps cut further.

    `rows` is about how many examples there are. The ids of a piece are little-endian unsigned 32-bit numbers.
    """

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: list[int] = []

        def stream() -> Iterator[Piece | None]:
            for batch in it:
                for shard, doc, start, tokens, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "start", "doc_tokens", "ids", "mask")), strict=True):
                    if shards and shards[-1] != shard:
                        yield None
                    if not shards or shards[-1] != shard:
                        shards.append(shard)
                    yield Piece(doc, start, tokens, _wide(ids), None if mask is None else np.append(0, np.cumsum(np.frombuffer(mask, np.uint8), dtype=np.int64)))
            yield None

        out: list[tuple] = []
        done = number = 0
        for made in sequences(stream(), limits, cut):
            if made is None:
                done, number = done + 1, 0
                continue
            offset = 0
            for p in made:
                out.append((p.doc, p.start, len(p.ids), p.doc_tokens, p.ids.astype("<u4").tobytes(), shards[done] << 32 | number, offset))
                offset += len(p.ids)
            number += 1
            if len(out) >= ROWS_AT_ONCE:
                yield _rows(out, _PACKED)
                out = []
        yield _rows(out, _PACKED)

    shards = max(1, -(-rows // PER_SHARD))
    d = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(shards)))
    d = d.repartition("shard").sortWithinPartitions("shard", "doc_id", "start", "ids", "mask")
    return d.mapInArrow(packed, _PACKED)


def pack(examples: DataFrame, limits: Limits = Limits(), *, rows: int, cut: bool = True) -> DataFrame:  # noqa: B008
    """Packed pieces of examples that have their ids."""
    return place(pieces_of(examples, limits), limits, rows=rows, cut=cut)


def pack_texts(docs: DataFrame, path: str, limits: Limits = Limits(), *, end: int | None = None, cut: bool = True) -> DataFrame:  # noqa: B008
    """Packed pieces of texts."""
    return place(pieces_of_texts(docs, path, limits, end), limits, rows=docs.count(), cut=cut)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "binary": pa.binary()}[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))
