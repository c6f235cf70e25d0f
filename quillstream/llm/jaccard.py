"""Grouped prefix join on word shingles: near-duplicate components at a Jaccard similarity threshold.

1. Shingle hashes are counted into a fixed number of slots over all documents; a document's set is
   ordered by its slots' counts, rarest first. Two sets that reach the threshold then share a hash
   within their prefixes.
2. Documents with equal sets become one; sets with identical prefix and size become one group, and
   only groups are listed under the hashes of their prefix.
3. Group pairs under a hash are filtered by size and by bitmaps, whose differing bits are at most
   the sets' differing members; a bitmap has a bit for each member of its set or more. What passes is
   joined to clusters, by spanning links only.
4. Groups expand to their members, and the members of a cluster are verified on whole sets. A
   cluster of up to BLOCK members is compared in full. A larger one is compared with BLOCK of its
   members first; then everything outside its largest component is compared, in blocks, with all of
   it. Links within one component change nothing, so no link between components is lost, and pairs
   are never written out.

Defined cases: null or wordless text has an empty set, linked with nothing; a text of fewer words
than a shingle is one shingle; rows with equal ids and sets are one document; rows with equal ids
and different sets are linked by their id, each with what it is near to; rows with a null id are
linked with nothing; an empty table gives no rows; texts of any length are taken whole, one at a time;
`keep_one_each` passes other columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.bytewords import SPACE_WORDS, shingles, words_of
from quillstream.llm.components import components
from quillstream.llm.shared import chunks, spare, written

SLOT_BITS = 18
#: Members of a cluster that are compared with each other at once.
BLOCK = 512
#: Groups under one hash up to which bitmaps are compared; more become one cluster without a look.
BUCKET = 2048
#: Members of a cluster that one task reads for one block.
SHARE = 4096


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    h, first = shingles(words_of(batch.column("text"), SPACE_WORDS), n)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def slot_counts(d: DataFrame, n: int) -> np.ndarray:
    """Sets that hold a hash of each slot, over all documents."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in chunks(it, "text"):
            total += np.bincount((np.concatenate(_sets(batch, n)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    found = d.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def features(docs: DataFrame, *, n: int, percent: int) -> DataFrame:
    """doc_id, a hash of the text, size, two hashes of the set, its prefix and its bitmap."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("text_key", F.xxhash64("text"))
    held = d.sparkSession.sparkContext.broadcast(slot_counts(d, n))

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        # counts close to each other are one rank, so that the order is fixed by few bits and then by the hash
        rank = np.floor(np.log2(counts + 1) * 8).astype(np.int16)
        for batch in chunks(it, "text"):
            size, one, two, prefix, bits = [], [], [], [], []
            for s in _sets(batch, n):
                k = len(s)
                size.append(k)
                one.append(int(_signed(np.bitwise_xor.reduce(s, keepdims=True))[0]) if k else 0)
                two.append(int(_signed((s * (s >> np.uint64(7) | np.uint64(1))).sum(keepdims=True))[0]) if k else 0)
                take = k - (percent * k + 99) // 100 + 1 if 100 * k >= percent * (k + 1) else 0
                prefix.append(_signed(s[np.lexsort((s, rank[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:take]]) if take else np.zeros(0, np.int64))
                bits.append(_bitmap(s).tobytes() if take else None)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bits, pa.binary())],
                names=["doc_id", "text_key", "size", "set1", "set2", "prefix", "bits"],
            )

    return d.mapInArrow(describe, "doc_id bigint, text_key bigint, size bigint, set1 bigint, set2 bigint, prefix array<bigint>, bits binary")


def _parts(near: np.ndarray) -> np.ndarray:
    """For each place of a symmetric matrix the first place of its component."""
    n = len(near)
    label = np.full(n, -1)
    for k in range(n):
        if label[k] < 0:
            new = np.zeros(n, bool)
            new[k] = True
            while new.any():
                label[new] = k
                new = near[new].any(0) & (label < 0)
    return label


def _bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each hash modulo a power of two, that is at least the number of hashes and 256."""
    own = np.zeros(max(256, 1 << (len(s) - 1).bit_length()), np.uint8)
    own[(s & np.uint64(len(own) - 1)).astype(np.int64)] = 1
    return np.packbits(own, bitorder="little").view(np.uint64)


class Bitmaps:
    """Bitmaps of several lengths, each also folded to half its length; sets within the threshold differ by a factor of two at most."""

    def __init__(self, raw: list[np.ndarray | None]):
        self.words = np.array([0 if x is None else len(x) for x in raw])
        self.of = {}
        for w in np.unique(self.words[self.words > 0]).tolist():
            at = np.flatnonzero(self.words == w)
            whole = np.stack([raw[k] for k in at.tolist()])
            self.of[w] = at, whole, whole[:, : w // 2] | whole[:, w // 2 :]

    def passing(self, size: np.ndarray, percent: int) -> np.ndarray:
        """Symmetric: whether size and bitmaps allow the threshold; what has no bitmap passes by its size."""
        n = len(size)
        near = 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
        for w, (at, whole, _) in self.of.items():
            for other, bits in ((at, whole), self.of[2 * w][::2] if 2 * w in self.of else (at[:0], whole[:0])):
                for k in range(0, len(at), 256):
                    i, j = np.nonzero(near[np.ix_(at[k : k + 256], other)])
                    for m in range(0, len(i), 1 << 14):
                        x, y = i[m : m + (1 << 14)] + k, j[m : m + (1 << 14)]
                        differ = np.bitwise_count(whole[x] ^ bits[y]).sum(1, dtype=np.int64)
                        x, y = at[x], other[y]
                        # |x - y| + |y - x| <= (1 - t) / (1 + t) (|x| + |y|)
                        near[x, y] = near[y, x] = (100 + percent) * differ <= (100 - percent) * (size[x] + size[y])
        near[np.arange(n), np.arange(n)] = True
        return near


def _linked(buckets: DataFrame, percent: int) -> DataFrame:
    """Spanning links (a, b) of the groups that pass under each hash; a bucket's rows lie together, sorted by hash."""

    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done(t: pa.Table) -> pa.RecordBatch:
            a, b = [], []
            token, gid, size = (t[c].to_numpy() for c in ("token", "gid", "size"))
            raw = [None if x is None else np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
            start = np.append(np.flatnonzero(np.diff(token, prepend=token[0] - 1) != 0), len(token))
            for s, e in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                if e - s > 1:
                    label = _parts(Bitmaps(raw[s:e]).passing(size[s:e], percent))
                    at = np.flatnonzero(label != np.arange(e - s))
                    a.append(gid[s:e][at])
                    b.append(gid[s:e][label[at]])
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else none), pa.array(np.concatenate(b) if b else none)], schema=schema)

        for batch in it:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            token = t["token"].to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield done(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield done(rest)

    return buckets.mapInArrow(link, "a bigint, b bigint")


def _verified(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) found in each (cluster, block, share): its queries against its rows. Queries come first."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, ids, parts = None, [], [], 0
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}  # bitmap words -> how many queries, their places and bitmaps
        sizes, part = np.zeros(2 * BLOCK, np.int64), np.zeros(2 * BLOCK, np.int64)  # of queries; part numbers what is linked so far

        for batch in chunks(it, "text", 1 << 20):
            found = []
            sets = _sets(batch, n)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "share", "is_query", "doc_id")), strict=True))
            for k, (*key, is_query, doc) in enumerate(keys):
                if key != at:
                    at, queries, ids, parts, held = key, [], [], 0, {}
                s = sets[k]
                size = len(s)
                own = _bitmap(s)
                w, m = len(own), len(queries)
                may = np.zeros(m, bool)
                for words, fold_own, fold_held in ((w, False, False), (w // 2, True, False), (2 * w, False, True)):
                    if words in held:
                        h, places, maps = held[words]
                        places, maps = places[:h], maps[:h]
                        mine = own[: w // 2] | own[w // 2 :] if fold_own else own
                        theirs = maps[:, :w] | maps[:, w:] if fold_held else maps
                        other = sizes[places]
                        differ = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
                        may[places] = ((100 + percent) * differ <= (100 - percent) * (other + size)) & (100 * np.minimum(other, size) >= percent * np.maximum(other, size))
                own_part, left = -1, np.flatnonzero(may)
                while len(left):
                    q, left = int(left[0]), left[1:]
                    both = np.concatenate([queries[q], s])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= percent * (int(sizes[q]) + size - inter):
                        found.append((doc, ids[q]))
                        if own_part < 0:
                            own_part = int(part[q])
                        else:
                            part[:m][part[:m] == part[q]] = own_part
                        left = left[part[left] != own_part]  # links within a part change nothing
                if is_query:
                    h, places, maps = held.get(w) or (0, np.zeros(16, np.int64), np.zeros((16, w), np.uint64))
                    if h == len(maps):
                        places, maps = np.concatenate([places, places]), np.concatenate([maps, maps])
                    places[h], maps[h] = m, own
                    held[w] = h + 1, places, maps
                    sizes[m] = size
                    part[m] = parts if own_part < 0 else own_part
                    parts += 1
                    queries.append(s)
                    ids.append(doc)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return rows.mapInArrow(verify, "a bigint, b bigint")


def _dealt(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Members (cluster, doc_id, share, shares, text) with every block of their cluster's queries (cluster, doc_id, block)."""
    cols = ["cluster", "block", "share", "is_query", "doc_id", "text"]
    blocks = queries.groupBy("cluster", "block").agg(F.count(F.lit(1)).alias("n")).drop("n")
    rows = members.join(blocks, "cluster").withColumn("is_query", F.lit(False))
    asked = members.join(queries, ["cluster", "doc_id"]).drop("share").withColumn("share", F.explode(F.expr("sequence(0L, shares - 1)"))).withColumn("is_query", F.lit(True))
    # a query is compared with the queries before it when it is read as one; with the others as they are read
    others = rows.join(queries.select("cluster", "doc_id", F.col("block").alias("own")), ["cluster", "doc_id"], "left").where("own is null or own <> block")
    parts = asked.select(cols).union(others.select(cols))
    return parts.repartition("cluster", "block", "share").sortWithinPartitions("cluster", "block", "share", F.desc("is_query"), "doc_id")


def near_duplicates(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) for each row of `docs`."""
    f = written(features(docs, n=n, percent=percent))
    full = f.where("size > 0 and doc_id is not null")
    sets = written(full.groupBy("size", "set1", "set2").agg(F.min("doc_id").alias("named")))
    # a set goes by the least id that has it; of several sets of such an id each goes by a hash
    several = sets.groupBy("named").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("named", F.lit(True).alias("shared"))
    node = F.when(F.col("shared"), F.xxhash64("named", "size", "set1", "set2", F.lit("set"))).otherwise(F.col("named"))
    sets = written(sets.join(several, "named", "left").select("size", "set1", "set2", "named", node.alias("rep")))
    whole = f.where("bits is not null").withColumn("prefix_hash", F.xxhash64("prefix"))
    whole = whole.join(sets, ["size", "set1", "set2"]).where("doc_id = named").dropDuplicates(["rep"])
    whole = whole.select("rep", "named", "text_key", "size", "prefix", "prefix_hash", "bits")
    groups = whole.groupBy("size", "prefix_hash").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
    members = written(whole.select("rep", "named", "text_key", "size", "prefix_hash").join(groups, ["size", "prefix_hash"]).select("rep", "named", "text_key", "gid", "members"))
    heads = whole.join(members.where("rep = gid").select("rep", "gid", "members"), "rep").select("gid", "size", "prefix", F.when(F.col("members") == 1, F.col("bits")).alias("bits"))
    heads = written(heads)
    listed = heads.select("gid", F.explode("prefix").alias("token"))
    often = listed.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.min("gid").alias("head")).where("groups > 1")
    listed = written(listed.join(often, "token"))
    small = listed.where(F.col("groups") <= BUCKET).join(heads.select("gid", "size", "bits"), "gid").select("token", "gid", "size", "bits")
    links = _linked(small.repartition("token").sortWithinPartitions("token", "size", "gid"), percent)
    links = links.union(listed.where(F.col("groups") > BUCKET).select("gid", "head"))
    own = members.where("members > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    clusters = components(links.union(own))
    c = members.join(clusters, members["gid"] == clusters["id"]).select(F.col("rep").alias("doc_id"), "named", "text_key", F.col("component").alias("cluster"))
    sized = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("shares", F.expr(f"(m + {SHARE} - 1) div {SHARE}"))
    c = c.join(sized, "cluster").withColumn("h", F.xxhash64("doc_id"))
    d = docs.select(F.col("doc_id").cast("long").alias("named"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    c = d.join(c, ["named", "text_key"]).drop("named", "text_key").withColumn("share", F.pmod("h", F.col("shares"))).dropDuplicates(["doc_id"])
    c = written(c)
    first = c.where(F.col("m") <= BLOCK).select("cluster", "doc_id", F.lit(0).cast("long").alias("block"))
    large = c.where(F.col("m") > BLOCK).select("cluster", "doc_id", "h", "m")
    # about BLOCK / 2 members of a large cluster; a block of over BLOCK would be dealt into two
    drawn = large.where(F.pmod("h", F.expr("bigint(65536)")) < F.expr(f"bigint(65536 * {BLOCK // 2} / m)"))
    drawn = _blocks(drawn)
    edges = written(_verified(_dealt(c.select("cluster", "doc_id", "share", "shares", "text"), first.union(drawn)), n, percent))
    if not large.isEmpty():
        so_far = components(edges.select("a", "b").union(large.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))))
        held = large.join(so_far, large["doc_id"] == so_far["id"]).select("cluster", "doc_id", "component")
        most = held.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("most"))
        left = held.join(most, "cluster").where("component <> most").select("cluster", "doc_id")
        left = written(_blocks(left))
        in_left = c.where(F.col("m") > BLOCK).select("cluster", "doc_id", "share", "shares", "text")
        edges = written(edges.union(_verified(_dealt(in_left, left), n, percent)))
    # ids with several sets link them
    apart = full.groupBy("doc_id").agg(*(agg(c).alias(f"{name}_{c}") for c in ("size", "set1", "set2") for name, agg in (("least", F.min), ("most", F.max))))
    apart = apart.where(" or ".join(f"least_{c} <> most_{c}" for c in ("size", "set1", "set2"))).select("doc_id")
    own = full.join(apart, "doc_id").join(sets, ["size", "set1", "set2"])
    first = own.groupBy("doc_id").agg(F.min("rep").alias("first"))
    parts = written(components(edges.select("a", "b").union(own.join(first, "doc_id").select("rep", "first"))))
    named = sets.join(parts, sets["rep"] == parts["id"], "left").select("size", "set1", "set2", "named", F.coalesce("component", "rep").alias("component"))
    least = named.groupBy("component").agg(F.min("named").alias("component_id"))
    named = named.join(least, "component").select("size", "set1", "set2", "component_id")
    empty = f.where("size = 0 or doc_id is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(named, ["size", "set1", "set2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id").union(empty)


def _blocks(queries: DataFrame) -> DataFrame:
    """Queries (cluster, doc_id) with blocks of BLOCK members at most: by a hash into blocks of about half that, and by rank within each."""
    from pyspark.sql import Window

    q = queries.select("cluster", "doc_id")
    sized = q.groupBy("cluster").agg(F.count(F.lit(1)).alias("q"))
    q = q.join(sized, "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.expr(f"(q + {BLOCK // 2} - 1) div {BLOCK // 2}")))
    rank = F.row_number().over(Window.partitionBy("cluster", "part").orderBy("doc_id")) - 1
    return q.withColumn("block", F.col("part") * 1000 + F.floor(rank / BLOCK)).select("cluster", "doc_id", F.col("block").cast("long").alias("block"))


def keep_one_each(docs: DataFrame, *, n: int = 3, percent: int = 90) -> DataFrame:
    """One document of each component, the one that names it, and all documents without shingles; columns as they are."""
    near = near_duplicates(docs, n=n, percent=percent)
    name = spare(docs, "_gone")
    gone = written(near.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).dropDuplicates())
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
