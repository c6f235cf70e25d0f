"""Removal of passages that other documents hold already, by content-defined chunks of lines.

A text is cut into lines; a long line is cut further after punctuation, so that a paragraph is
several lines. A rolling hash over the hashes of two neighbouring lines decides whether a chunk may
begin and end around them, so a passage is cut alike wherever it stands. A chunk is a pair of lines
of LEAST characters; where a pair is shorter, the rolling hash may let a chunk begin that runs on
until it has them; a single line of a passage's length is one too. Pairs that are no chunks are
links. Chunks and links of one hash meet in one shuffle, over all documents. Overlapping repeated ones of a
document make a run, which goes if a chunk is among them: chunks find passages, links make them
whole. The first document (least doc_id) keeps what it shares, and inside a document the first place
stays. Before anything goes, the bytes of all that have one hash are compared; should any differ, all
is done again with other hashes. What is left of a document keeps its bytes. Only DataFrame
functions are used.

Defined cases: null text stays null and empty text stays empty; a document may be left with an empty
text but is never dropped; an empty table gives no rows; texts of any length are taken whole (work
grows with their lines, memory with the longest text); rows with equal doc_id and text are one
document, rows with equal doc_id and different texts keep what only they share; null ids come last;
of lines repeated in a row, each place but the first is a repeat. Passages of less than LEAST
characters stay. Other columns are passed on, whatever their names; one named as the count of removed
lines is replaced by it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstream.llm.shared import release, spare, written

#: Where lines end: after a line feed or punctuation that no more punctuation follows.
MARKS = ".,;:!?…।॥،؛؟۔。！？；：，、．｡､։።፣፤၊။"
CUT = rf"""(?<=[{MARKS}\\n])(?![{MARKS}\\n"'])"""
#: The same, written so that most characters are turned down by one look at a table or a range.
_MARK = rf"[.,;:!?\\n[\u0589-\uff64&&[{"".join(c for c in MARKS if c > "~")}]]]"
_FAST_CUT = rf"""(?<={_MARK})(?!["']|{_MARK})"""
#: Two in so many rolling hashes of a pair forbid that a chunk begins or ends with it.
SPARSITY = 8
#: One in so many rolling hashes of a short pair lets a longer chunk begin.
SHORT = 4
#: Characters of a stretch of lines that can be removed, at least.
LEAST = 40
#: Characters of a line that is a chunk of its own.
LONG = 200
TRIMMED = "btrim({}, ' \\t\\n\\r')"
#: Where a stretch stands, in one number: its first line, how many there are, whether it is a chunk. Places where it goes are odd.
PLACE = "shiftleft(cast({start} as bigint), 32) | cast({k} * 4 + if({chunk}, 2, 0) as bigint)"
LINE_HASH = "xxhash64({line}, {seed})"


def _pieces(text: str) -> str:
    return f"split({text}, '{_FAST_CUT.replace("'", "\\'")}')"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc_key", F.xxhash64("text"))


def stretches(docs: DataFrame, seed: int = 0, *, sparsity: int = SPARSITY, short: int = SHORT, least: int = LEAST, line_hash: str = LINE_HASH) -> DataFrame:
    """doc_id, doc_key, place (see PLACE) and hash of all pairs of lines, and of the chunks that are no pairs."""
    # Catalyst puts an array that is named once into the expression that names it, and so into its lambda, where it would be
    # computed again for each element; an array that a lambda looks into is therefore named outside of it as well.
    d = _keyed(docs).where("text is not null").select("doc_id", "doc_key", F.expr(f"transform({_pieces('text')}, x -> {TRIMMED.format('x')})").alias("lines"))
    d = d.select("doc_id", "doc_key", "lines", F.expr("transform(lines, x -> length(x))").alias("sizes"))

    def h(line: str) -> str:
        return line_hash.format(line=line, seed=seed)

    def lines_from(most: int) -> str:
        return f"aggregate(sequence(i, i + {most - 1}), struct(0 as n, 0 as k), (a, j) -> if(a.n >= {least} and a.k > 2 or get(sizes, j) is null, a, struct(a.n + greatest(get(sizes, j), 1) as n, a.k + 1 as k)), a -> if(a.n >= {least} and a.k > 2, a.k, null))"

    # slice would copy the whole array each time a lambda asks for it, get does not; most chunks have eight lines at most, so not all that may be needed are gone through
    k = f"coalesce({lines_from(8)}, {lines_from(max(least, 3))})"
    others = f"filter(transform(sizes, (n, i) -> if(n >= {LONG} or n + get(sizes, i + 1) < {least}, i, null)), i -> i is not null)"
    begins = f"pmod(xxhash64({h('get(lines, i)')}, {h('get(lines, i + 1)')}), {short}) = 0"
    others = f"transform({others}, i -> if(get(sizes, i) >= {LONG}, struct(i as start, 1 as k), if({begins}, struct(i as start, {k} as k), null)))"
    d = d.select("doc_id", "doc_key", "lines", F.expr(f"if(size(lines) > 0 and size(sizes) > 0, filter({others}, c -> c.k is not null), null)").alias("others"))
    hash_ = f"aggregate(sequence(c.start + 2, c.start + c.k - 1), xxhash64({h('get(lines, c.start)')}, {h('get(lines, c.start + 1)')}), (a, j) -> xxhash64(a, {h('get(lines, j)')}))"
    hash_ = f"if(c.k = 1, xxhash64({h('get(lines, c.start)')}), {hash_})"
    kind = "array<struct<start:int,a:string,b:string,k:int,hash:bigint>>"
    pairs = "arrays_zip(sequence(0, size(lines) - 2), slice(lines, 1, size(lines) - 1), slice(lines, 2, size(lines)), cast(array() as array<int>), cast(array() as array<bigint>))"
    every = f"concat(if(size(lines) > 1, cast({pairs} as {kind}), cast(array() as {kind})), if(size(lines) > 0, cast(transform(others, c -> struct(c.start, cast(null as string), cast(null as string), c.k, {hash_})) as {kind}), null))"
    # the outer form: the plain one would filter by the whole expression before it; the hashes of pairs are made behind it, in compiled code
    d = d.select("doc_id", "doc_key", F.inline_outer(F.expr(every))).where("start is not null")
    d = d.selectExpr("doc_id", "doc_key", "start", "coalesce(k, 2) as k", f"coalesce(hash, xxhash64({h('a')}, {h('b')})) as hash", "length(a) + length(b) as n")
    chunk = f"n is null or (n >= {least} and pmod(hash, {sparsity}) > 1)"
    return d.selectExpr("doc_id", "doc_key", f"{PLACE.format(start='start', k='k', chunk=chunk)} as place", "hash")


def repeated_runs(docs: DataFrame, seed: int = 0, **options: int | str) -> DataFrame:
    """doc_id, doc_key, gone (the runs of lines to remove) and checked (places of all repeated pairs and single lines), for documents with repeated lines."""
    rows = stretches(docs, seed, **options)
    # All places of a hash meet in one shuffle, ordered; one that stands alone has no neighbour. Nothing is counted before, so no filter can fill up.
    w = Window.partitionBy("hash").orderBy(F.asc_nulls_last("doc_id"), "doc_key", "place")
    first = F.first(F.coalesce("doc_id", F.lit((1 << 63) - 1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"before_id": F.lag("doc_id").over(w), "before_key": F.lag("doc_key").over(w), "before": F.lag("place").over(w), "after": F.lead("place").over(w), "first": first})
    rows = rows.where("before is not null or after is not null")
    own = "coalesce(before_id <=> doc_id and before_key = doc_key, false)"
    rows = rows.where(f"not ({own} and before = place)")  # another row of the same document
    rows = rows.selectExpr("doc_id", "doc_key", f"place | if({own} or coalesce(doc_id, {(1 << 63) - 1}) <> first, 1, 0) as place")
    # the shuffle comes first, else what a task has of a document would be collected, packed and unpacked again
    found = rows.repartition("doc_id", "doc_key").groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_list("place")).alias("s"))
    zero = "struct(cast(array() as array<struct<start:int,stop:int>>) as done, -1 as start, -1 as stop, false as good)"
    done = "if(a.good and a.stop > a.start, array_append(a.done, struct(a.start as start, a.stop as stop)), a.done)"
    # the lines of a longer chunk are in pairs that are repeated as well; it only says that there is one
    start, k, good = ("cast(shiftright(c, 32) as int)", "cast(shiftright(c, 2) & 1073741823 as int)", "c & 2 = 2")
    stop = f"{start} + if({k} > 2, 0, {k})"
    gone = f"aggregate(filter(s, c -> c & 1 = 1), {zero}, (a, c) -> if({start} < a.stop, struct(a.done as done, a.start as start, greatest(a.stop, {stop}) as stop, a.good or {good} as good), struct({done} as done, {start} as start, {stop} as stop, {good} as good)), a -> {done})"
    checked = f"transform(filter(s, c -> {k} < 3), c -> {start} * if({k} = 1, -1, 1) - if({k} = 1, 1, 0))"
    # an array that a lambda looks into is named outside of it as well, see above
    return written(found.selectExpr("doc_id", "doc_key", f"if(size(s) > 0, {gone}, null) as gone", f"if(size(s) > 0, {checked}, null) as checked"), compression="zstd")


def _joined(docs: DataFrame, found: DataFrame, how: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns of `found` under names that `docs` has not."""
    names = {c: spare(docs, f"_{c}") for c in found.columns}
    f = found.withColumnsRenamed(names)
    same = docs["doc_id"].cast("long").eqNullSafe(f[names["doc_id"]]) & (F.xxhash64(docs["text"].cast("string")) == f[names["doc_key"]])
    return docs.join(f, same, how), names


def _cut(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with gone and checked of `found`, and pieces (of the text; a text without repeated lines is one), written: texts are shuffled and cut once, for the comparison and for the removal."""
    out, names = _joined(docs, found, "left")
    text = "cast(text as string)"
    names |= {"pieces": spare(out, "_pieces"), "raw": spare(out, "_raw")}
    pieces = F.expr(f"if({names['checked']} is null, array({text}), {_pieces(text)})").alias(names["pieces"])
    # cutting replaces bytes that are no characters; such a text that keeps all its lines is kept as it is
    raw = F.expr(f"if({names['checked']} is null or is_valid_utf8({text}), null, {text})").alias(names["raw"])
    others = [out[c] for c in (*docs.columns, names["gone"], names["checked"]) if c != "text"]
    return written(out.select(*others, pieces, raw), compression="zstd"), names


def _mixed(own: DataFrame, seed: int, line_hash: str) -> DataFrame:
    """Hashes that stand for stretches of different bytes, from columns lines and checked."""
    own = own.where("checked is not null")
    texts = "transform(checked, i -> if(i < 0, struct(get(lines, -1 - i) as a, cast(null as string) as b), struct(get(lines, i) as a, get(lines, i + 1) as b)))"
    rows = own.select(F.inline_outer(F.expr(f"if(size(lines) > 0 and size(checked) > 0, {texts}, null)"))).where("a is not null")
    rows = rows.selectExpr(f"{TRIMMED.format('a')} as a", f"{TRIMMED.format('b')} as b")
    one, two = (line_hash.format(line=x, seed=seed) for x in "ab")
    rows = rows.selectExpr(f"if(b is null, xxhash64({one}), xxhash64({one}, {two})) as hash", "a", "b")
    # a line holds no line feed but at its end, where it is trimmed
    rows = rows.selectExpr("hash", "concat_ws('\\n', a, b) as chunk")
    return rows.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash")


def mixed_hashes(docs: DataFrame, found: DataFrame, seed: int = 0, *, line_hash: str = LINE_HASH) -> DataFrame:
    """Hashes that stand for stretches of different bytes, among all repeated ones."""
    own, names = _joined(docs, found, "inner")
    return _mixed(own.select(F.expr(_pieces("cast(text as string)")).alias("lines"), F.col(names["checked"]).alias("checked")), seed, line_hash)


def dedup_lines(docs: DataFrame, *, removed: str = "_n_removed", **options: int | str) -> DataFrame:
    """`docs` with repeated passages gone from `text`, and with the number of lines gone behind its columns."""
    for seed in itertools.count():
        found = repeated_runs(docs, seed, **options)
        release(docs.sparkSession)
        out, names = _cut(docs, found)
        release(docs.sparkSession)
        own = out.select(F.col(names["pieces"]).alias("lines"), F.col(names["checked"]).alias("checked"))
        if _mixed(own, seed, str(options.get("line_hash", LINE_HASH))).isEmpty():
            break
    release(docs.sparkSession)
    gone, pieces, raw = names["gone"], names["pieces"], names["raw"]
    out = out.withColumn(gone, F.expr(f"if(size({gone}) > 0, {gone}, null)"))
    end = f"struct(size({pieces}) as start, size({pieces}) as stop)"
    before = f"coalesce(get({gone}, i - 1).stop, 0)"
    left = f"array_join(flatten(transform(concat({gone}, array({end})), (r, i) -> if(r.start > {before}, transform(sequence({before}, r.start - 1), j -> get({pieces}, j)), array('')))), '')"
    # array_join would make an empty text of a null
    whole = f"coalesce({raw}, if(size({pieces}) = 1, get({pieces}, 0), array_join({pieces}, '')))"
    text = F.expr(f"if({gone} is null, {whole}, {left})").cast(docs.schema["text"].dataType)
    n = F.expr(f"coalesce(aggregate({gone}, 0L, (n, r) -> n + r.stop - r.start), 0L)").alias(removed)
    return out.select(*(text.alias(c) if c == "text" else out[c] for c in docs.columns if c.lower() != removed.lower()), n)
