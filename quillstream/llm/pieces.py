"""SentencePiece segmentation: N best paths through the piece lattice, and decoding.

A text, its spaces written as U+2581 and one put before it, is a lattice: an edge for each piece of
the vocabulary that stands at a place, and byte pieces for a character that is no piece. Viterbi
scores from the left are the exact cost of what remains of a search from the right, so A-star yields
paths in the order of their scores and never turns back. No piece goes on after a word into the next
space, so the lattice falls apart into words that are searched once and remembered. The N best paths
of a whole text differ from its best in N - 1 words at most, those in which a second path costs least.
The best path itself comes from the Viterbi pass; only those words are searched by A-star.

The model file is a parameter, read on the driver; its pieces are broadcast (their number is the
vocabulary's). The paths are those of the lattice under the pieces' scores: for a vocabulary made by
merges the best one need not be the ids that the merges give.

Defined cases: null and empty text have no pieces, one path and score 0; equal scores are ordered by
the earlier deviation; rows with equal ids are segmented one by one; an empty table gives no rows;
texts of any length are segmented whole, in memory that grows with a text and its longest word; U+2581
in a text decodes to a space, as it does in the library; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import itertools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import chunks

SPACE = "▁"
#: Paths of each text.
N_BEST = 4
#: What a character without a piece costs below the least score, for each of its bytes.
UNKNOWN = 10.0
#: Words, and texts' searches, that a worker remembers; each store is emptied when full. A word takes about 300 bytes.
CACHE_ENTRIES, SEARCHES = 150_000, 2_000
#: Words searched at once, letters up to which they are, and bytes of text taken at once.
AT_ONCE, SHORT_WORD, BATCH_BYTES = 2048, 64, 512 << 10
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Pieces:
    """A vocabulary as a trie, and the words already searched. Of each word: its best path's ids, score and what a second path costs."""

    score: dict[str, tuple[int, float]]  # of each piece its id and score
    text: list[bytes]  # what each id stands for
    bytes_: list[int]
    unknown: float
    longest: int
    pairs: set[str] = field(default_factory=set)  # of neighbouring characters inside pieces; no edge spans any other pair
    at: dict[str, int] = field(default_factory=dict)
    ids: list[bytes] = field(default_factory=list)
    numbers: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # of each word: ids, score, what a second path costs
    searched: dict[str, list[tuple[float, tuple[int, ...]]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        nodes: dict[str, int] = {"": 0}
        steps = []
        for piece in self.score:
            self.pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    steps.append((nodes[piece[: k - 1]] << 21 | ord(piece[k - 1]), len(nodes)))
                    nodes[piece[:k]] = len(nodes)
        steps.sort()
        self.keys = np.array([k for k, _ in steps], np.int64)  # node and character
        self.child = np.array([n for _, n in steps], np.int64)
        self.piece = np.full(len(nodes), -1, np.int64)  # of each node the piece that ends there
        self.value = np.zeros(len(nodes))
        for piece, (i, v) in self.score.items():
            self.piece[nodes[piece]], self.value[nodes[piece]] = i, v

    def __getstate__(self) -> dict:
        return self.__dict__ | {"at": {}, "ids": [], "numbers": np.zeros((0, 3)), "searched": {}}

    def edges(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end the edges (start, ids, score) that end there."""
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(word) + 1)]
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                if (found := self.score.get(word[i:j])) is not None:
                    out[j].append((i, (found[0],), found[1]))
            if word[i] not in self.score:
                raw = word[i].encode("utf-8", "surrogatepass")
                out[i + 1].append((i, tuple(self.bytes_[b] for b in raw), self.unknown * len(raw)))
        return out

    def paths(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths by A-star from the right; fewer if there are no more.

        What is open is kept in order, and no more of it than paths are still wanted: with exact scores ahead every open end
        leads to a path of just its score, so what lies behind n better ones is never needed.
        """
        if len(found := self.searched.get(word, ())) == n:
            return found
        edges = self.edges(word)
        ahead = [0.0] * (len(word) + 1)  # the best score from the left up to each place
        for j in range(1, len(word) + 1):
            ahead[j] = max(s + ahead[i] for i, _, s in edges[j])
        out: list[tuple[float, tuple[int, ...]]] = []
        ways: list[tuple[int, tuple[int, ...]]] = [(-1, ())]  # of each step to the left the one before it, and its ids
        open_: list[tuple[float, int, int, float, int]] = [(-ahead[-1], 0, len(word), 0.0, 0)]
        pushed = 0
        while open_ and len(out) < n:
            _, _, place, done, way = open_.pop(0)
            if not place:
                ids: list[int] = []
                while way > 0:
                    way, own = ways[way]
                    ids += own
                out.append((done, tuple(ids)))
                continue
            for i, own, s in edges[place]:
                pushed += 1
                ahead_of = -(done + s + ahead[i])
                if len(open_) < n - len(out) or ahead_of <= open_[-1][0]:
                    ways.append((way, own))
                    bisect.insort(open_, (ahead_of, -pushed, i, done + s, len(ways) - 1))
                    del open_[n - len(out) :]
        if len(self.searched) > SEARCHES:
            self.searched.clear()
        self.searched[word] = out
        return out

    def best(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Of each word the best path's ids; and their number, its score, and how much less the second best path scores (infinite without one).

        The words lie one after the other in one array; all walk through the trie at once, and then all take the
        recurrence's step to their first, second, ... end at once.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        of = np.repeat(np.arange(len(words)), size)
        own_stop = stop[of]
        begin, place, node = np.arange(len(chars)), np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # of edges: begin, end, piece, score
        plain = np.zeros(len(chars), bool)  # characters that are pieces
        while len(begin):
            key = node << 21 | chars[place]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            begin, node, place = begin[on], self.child[k[on]], place[on] + 1
            piece = self.piece[node]
            is_ = piece >= 0
            found.append((begin[is_], place[is_], piece[is_], self.value[node[is_]]))
            if len(found) == 1:
                plain[found[0][0]] = True
            on = place < own_stop[begin]
            begin, node, place = begin[on], node[on], place[on]
        odd = np.flatnonzero(~plain)
        raw = np.select([chars[odd] < 0x80, chars[odd] < 0x800, chars[odd] < 0x10000], [1, 2, 3], 4)
        found.append((odd, odd + 1, np.full(len(odd), -1), self.unknown * raw))
        a, b, piece, value = (np.concatenate(x) for x in zip(*found, strict=True))
        w = of[a]
        step = b - (stop - size)[w]
        order = np.lexsort((b, step))  # stable: shorter pieces first, bytes last
        a, b, piece, value, step = a[order] + w[order], b[order] + w[order], piece[order], value[order], step[order]
        first, second = np.full(len(chars) + len(words), -np.inf), np.full(len(chars) + len(words), -np.inf)
        first[stop - size + np.arange(len(words))] = 0.0
        via = np.zeros(len(first), np.int64)
        cuts = np.searchsorted(step, np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at, to, v = a[lo:hi], b[lo:hi], value[lo:hi]
            through = first[at] + v
            group = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(through, group)
            nth = np.repeat(np.arange(len(group)), np.diff(np.append(group, hi - lo)))
            k = np.flatnonzero(through == top[nth])
            k = k[np.diff(nth[k], prepend=-1) != 0]  # the first of equal ones
            through[k] = second[at[k]] + v[k]
            to = to[group]
            first[to], second[to], via[to] = top, np.maximum.reduceat(through, group), k + lo
        ends = stop + np.arange(len(words))
        at, live, taken, owner = ends.copy(), np.arange(len(words)), [], []
        while len(live):
            e = via[at]
            taken.append(e)
            owner.append(live)
            at = a[e]
            on = at > (stop - size)[live] + live
            at, live = at[on], live[on]
        edge, own = np.concatenate(taken)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(own, kind="stable")
        edge, own = edge[order], own[order]
        chosen = piece[edge]
        byte = np.flatnonzero(chosen < 0)
        if len(byte):
            spelt = [[self.bytes_[x] for x in chr(int(c)).encode("utf-8", "surrogatepass")] for c in chars[a[edge[byte]] - own[byte]]]
            many = np.ones(len(edge), np.int64)
            many[byte] = [len(x) for x in spelt]
            starts = np.cumsum(many) - many
            chosen, own = np.repeat(chosen, many), np.repeat(own, many)
            for k, x in zip(starts[byte].tolist(), spelt, strict=True):
                chosen[k : k + len(x)] = x
        flat = chosen.astype(np.int32).tobytes()
        cut = 4 * np.searchsorted(own, np.arange(len(words) + 1))
        at = cut.tolist()
        return [flat[x:y] for x, y in zip(at, at[1:])], np.stack([np.diff(cut) // 4, first[ends], first[ends] - second[ends]], 1)

    def second(self, word: str) -> tuple[bytes, float, float]:
        """What `best` gives, for one long word: its steps would be too many for arrays of a word each."""
        n, score, none = len(word), self.score, -np.inf
        best, next_, back = [0.0] * (n + 1), [none] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            first = second = none
            via = j - 1
            for i in range(j - 1, max(j - self.longest, 0) - 1, -1):
                found = score.get(word[i:j])
                if found is not None:
                    through = best[i] + found[1]
                    if through > first:
                        second, first, via = max(first, next_[i] + found[1]), through, i
                    elif through > second:
                        second = through
            if word[j - 1] not in score:
                s = self.unknown * len(word[j - 1].encode("utf-8", "surrogatepass"))
                through = best[j - 1] + s
                if through > first:
                    second, first, via = max(first, next_[j - 1] + s), through, j - 1
                else:
                    second = max(second, through)
            best[j], next_[j], back[j] = first, second, via
        ids: list[int] = []
        j = n
        while j:
            piece = score.get(word[back[j] : j])
            ids += [self.bytes_[x] for x in reversed(word[j - 1].encode("utf-8", "surrogatepass"))] if piece is None else [piece[0]]
            j = back[j]
        return array("i", reversed(ids)).tobytes(), best[n], best[n] - next_[n]

    def known(self, words: list[str]) -> np.ndarray:
        """Places of the words in `ids` and `numbers`; new ones are searched first."""
        if len(self.at) > CACHE_ENTRIES:
            self.at, self.ids, self.numbers = {}, [], np.zeros((0, 3))
        at, pairs = self.at, self.pairs
        of = np.fromiter(map(at.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(of < 0)
        if not len(new):
            return of
        fresh = {words[k] for k in new.tolist()}
        if max(map(len, fresh)) <= SHORT_WORD:
            self._search(fresh)
        else:
            # long words fall apart where no edge leads across
            parts = {}
            for w in [w for w in fresh if len(w) > SHORT_WORD]:
                cuts = [0, *(k for k in range(1, len(w)) if w[k - 1 : k + 1] not in pairs), len(w)]
                parts[w] = [w[a:b] for a, b in zip(cuts, cuts[1:])]
            self._search({x for own in parts.values() for x in own if x not in at} | {w for w in fresh if w not in parts})
            whole = []
            for w, own in parts.items():
                if len(own) > 1:
                    k = [at[x] for x in own]
                    at[w] = len(self.ids)
                    self.ids.append(b"".join(self.ids[x] for x in k))
                    n = self.numbers[k]
                    whole.append((n[:, 0].sum(), n[:, 1].sum(), n[:, 2].min()))
            if whole:
                self.numbers = np.concatenate([self.numbers, np.array(whole)])
        of[new] = np.fromiter(map(at.__getitem__, map(words.__getitem__, new.tolist())), np.int64, len(new))
        return of

    def _search(self, words: set[str]) -> None:
        """Adds the words to `at`, `ids` and `numbers`."""
        short = sorted((x for x in words if len(x) <= SHORT_WORD), key=len)
        numbers = [self.numbers]
        for k in range(0, len(short), AT_ONCE):
            some = short[k : k + AT_ONCE]
            ids, n = self.best(some)
            self.at.update(zip(some, range(len(self.ids), len(self.ids) + len(some)), strict=True))
            self.ids += ids
            numbers.append(n)
        for x in words:
            if len(x) > SHORT_WORD:
                ids, score, gap = self.second(x)
                self.at[x] = len(self.ids)
                self.ids.append(ids)
                numbers.append(np.array([[len(ids) // 4, score, gap]]))
        self.numbers = np.concatenate(numbers)


def load(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    score, text, by_byte = {}, [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            text.append(b"")
        else:
            score[piece] = i, float(sp.get_score(i))
            text.append(piece.replace(SPACE, " ").encode())
    bad = [p for p in score if SPACE in p.lstrip(SPACE)]
    if bad:
        raise ValueError(f"pieces that go over a space: {bad[:3]}")
    least = min(s for _, s in score.values() if s > -1e8)
    return Pieces(score, text, by_byte, least - UNKNOWN, max(map(len, score)))


def words_of(text: str) -> list[str]:
    return _WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


Changes = list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]


def encode_all(texts: list[str | None], pieces: Pieces, n: int = N_BEST) -> list[tuple[np.ndarray, float, Changes]]:
    """For each text the ids and score of its best path, and the next n - 1 as (score, changes).

    A change is (place in the best ids, ids replaced, ids instead).
    """
    words = [words_of(t or "") for t in texts]
    flat = [w for own in words for w in own]
    of = pieces.known(flat)
    parts = list(map(pieces.ids.__getitem__, of.tolist()))
    lengths, scores, seconds = pieces.numbers[of].T if len(of) else np.zeros((3, 0))
    begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    out, a = [], 0
    for own in words:
        b = a + len(own)
        ids = np.frombuffer(b"".join(parts[a:b]), np.int32)
        score = float(scores[a:b].sum())
        others: Changes = []
        if own and n > 1:
            # the words in which a second path costs least; of equal ones the first
            cost = seconds[a:b]
            near = np.flatnonzero(cost <= np.partition(cost, min(n, len(own)) - 1)[min(n, len(own)) - 1])
            near = near[np.argsort(cost[near], kind="stable")][: n - 1]
            best: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            found = {}
            for k in np.sort(near[np.isfinite(cost[near])]).tolist():
                paths = pieces.paths(own[k], n)
                mine = tuple(np.frombuffer(parts[a + k], np.int32).tolist())
                found[k] = paths if paths[0][1] == mine else [(paths[0][0], mine), *(x for x in paths if x[1] != mine)][:n]
                top = found[k][0][0]
                best = sorted(((c + top - s, way + ((k, p),) if p else way) for c, way in best for p, (s, _) in enumerate(found[k])), key=lambda x: (x[0], x[1]))[:n]
            place = lambda k: int(begins[a + k] - begins[a])  # noqa: B023, E731
            others = [(score - c, [(place(k), len(parts[a + k]) // 4, found[k][p][1]) for k, p in way]) for c, way in best[1:]]
        out.append((ids, score, others))
        a = b
    return out


def encode(text: str | None, pieces: Pieces, n: int = N_BEST) -> tuple[np.ndarray, float, Changes]:
    return encode_all([text], pieces, n)[0]


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    return b"".join(map(pieces.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


SCHEMA = "doc_id bigint, ids array<int>, score double, others array<struct<score:double,changes:array<struct<place:int,replaced:int,ids:array<int>>>>>, decodes boolean"


def segmented(docs: DataFrame, path: str, *, n: int = N_BEST) -> DataFrame:
    """doc_id, the best path's ids and score, the other paths, and whether decoding gives the text again."""
    held = docs.sparkSession.sparkContext.broadcast(load(path))
    change = pa.struct([("place", pa.int32()), ("replaced", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def segment(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in chunks(it, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            paths = encode_all(texts, p, n)
            flat = np.concatenate([ids for ids, _, _ in paths])
            offsets = np.concatenate([[0], np.cumsum([len(ids) for ids, _, _ in paths])]).astype(np.int32)
            others = [[{"score": s, "changes": [{"place": a, "replaced": b, "ids": c} for a, b, c in changes]} for s, changes in o] for _, _, o in paths]
            same = [decode(ids, p) == (t or "").replace(SPACE, " ") for t, (ids, _, _) in zip(texts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([s for _, s, _ in paths], pa.float64()), pa.array(others, kind), pa.array(same)],
                names=["doc_id", "ids", "score", "others", "decodes"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(segment, SCHEMA)


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null text."""
    held = encoded.sparkSession.sparkContext.broadcast(load(path))

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [None if x is None else decode(np.array(x, np.int64), held.value) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id bigint, text string")
