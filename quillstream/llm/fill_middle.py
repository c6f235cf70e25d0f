"""Fill-in-middle: texts are cut at two seeded token boundaries and written out as prefix, suffix and middle.

An index of the distinct texts holds each one's token boundaries once, as an Elias-Fano list: about two
bits and the width of a mean token for a boundary, read in place by select. Documents with equal text are
grouped by its SHA-256, and the bytes of all texts of a group are compared while they are combined
(a set of whole texts, which has one element). The index is joined back to the documents' ids, and each one's
two seeded numbers select their boundaries; what is written out is composed by Spark's own functions.

Texts are shuffled once, distinct texts only as far as one task holds the copies; ids travel without their
texts. A text that more than one document in `1 / HOT` has is kept in SHARES shares, so that no task holds
all its copies; there are fewer than HOT such texts, which bounds what is broadcast.

Defined cases: a null text counts as empty, has no tokens and stays plain; a text that contains a marker stays plain,
since it could not be rebuilt; a null id seeds like an empty one; repeated rows give a row each, cut alike; an
empty table gives no rows; texts of any length are cut whole; other columns are not looked at. Two texts of one
digest, which would need a collision of SHA-256, stop the job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import written

#: A text is hot if more than one row in HOT has it; its copies are dealt into SHARES.
HOT, SHARES = 1000, 256
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BOUNDS = "n long, width int, low binary, high binary"
#: Ones of the high bits between two remembered places.
STRIDE = 256


def boundaries(text: str) -> np.ndarray:
    """Where tokens end, in code points: white space and the word behind it, or white space at the end of the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(c)) if len(c) else ends


def elias_fano(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A sorted list as (length, bits of a low part, low parts, high parts in unary behind the places of every STRIDE-th one)."""
    n = len(values)
    if not n:
        return 0, 0, b"", b""
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = (values[:, None] >> np.arange(width)) & 1
    at = (values >> width) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1, np.uint8)
    high[at] = 1
    return n, width, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), at[::STRIDE].astype("<u4").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(k: int, n: int, width: int, low: bytes, high: bytes) -> int:
    """The k-th value of a list, from 0 on."""
    samples = -(-n // STRIDE)
    start = int(np.frombuffer(high, "<u4", 1, 4 * (k // STRIDE))[0])
    stop = int(np.frombuffer(high, "<u4", 1, 4 * (k // STRIDE + 1))[0]) + 1 if k // STRIDE + 1 < samples else 8 * (len(high) - 4 * samples)
    first = start // 8
    bits = np.unpackbits(np.frombuffer(high, np.uint8, -(-stop // 8) - first, 4 * samples + first), bitorder="little")
    at = 8 * first + start % 8 + int(np.flatnonzero(bits[start % 8 :])[k % STRIDE])
    head, skip = divmod(k * width, 8)
    part = int.from_bytes(low[head : (k * width + width + 7) // 8], "little") >> skip & (1 << width) - 1
    return at - k << width | part


def _lists(texts: pa.Array) -> pa.Array:
    found = [elias_fano(boundaries(t.as_py())) for t in texts]
    n, width, low, high = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(width, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], names=["n", "width", "low", "high"])


def _ends(lists: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """Where the units before `first` and `last` end; null where a number is null."""
    n, width, low, high = (lists.field(k) for k in range(4))
    out: list[list[int | None]] = [[], []]
    for i, pair in enumerate(zip(first.to_pylist(), last.to_pylist(), strict=True)):
        for side, k in zip(out, pair, strict=True):
            side.append(k if not k else select(k - 1, n[i].as_py(), width[i].as_py(), low[i].as_py(), high[i].as_py()))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in out], names=["first", "last"])


def indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, share, text) and (key, share, bounds) of distinct texts, and (key, share, doc_id) of the documents.

    Texts and lists are apart, since rows that come from Python have lost their partitioning: only lists are dealt out again,
    texts meet the ids where they were grouped. Both come from one shuffle, which Spark uses twice.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("key", F.unhex(F.sha2("text", 256)))
    rows = d.count()
    hot = written(d.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") * HOT > rows).select("key", F.lit(True).alias("is_hot")))
    d = d.join(F.broadcast(hot), "key", "left")  # fewer than HOT rows
    d = d.withColumn("share", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).otherwise(0).cast("int"))
    texts = d.groupBy("key", "share").agg(F.collect_set("text").alias("texts"))  # one text, or a digest that is not one of one text
    one = F.when(F.size("texts") == 1, F.element_at("texts", 1)).otherwise(F.raise_error(F.lit("different texts have one digest")).cast("string"))
    lists = F.arrow_udf(_lists, BOUNDS)
    texts = texts.select("key", "share", one.alias("text"))
    return texts, texts.select("key", "share", lists("text").alias("bounds")), d.select("key", "share", "doc_id")


def _seeds(seed: int, count: int) -> list[Column]:
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output); `rate` of a hundred documents are cut, `spm` of a hundred of these suffix first."""
    texts, lists, ids = indexed(docs)
    h1, h2, h3, h4 = _seeds(seed, 4)
    d = ids.join(texts, ["key", "share"]).join(lists, ["key", "share"]).withColumn("n", F.col("bounds.n"))
    is_plain = (F.col("n") == 0) | F.col("text").rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (h3 % 100 >= rate)
    d = d.withColumn("form", F.when(is_plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    cut = lambda pick: F.when(F.col("form") != "plain", pick(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    d = d.withColumns({"a": cut(F.least), "b": cut(F.greatest)})
    d = d.withColumn("ends", F.arrow_udf(_ends, "first long, last long")("bounds", "a", "b"))
    a, b = F.col("ends.first").cast("int"), F.col("ends.last").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return d.select("doc_id", "n", "form", F.col("ends.first").alias("prefix_chars"), (F.col("ends.last") - F.col("ends.first")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of; its parts hold no marker, so the first of each is where it was set."""
    out = F.col(output)
    tail = F.substring_index(out, MIDDLE, -1)
    head = F.substring(F.substring_index(out, MIDDLE, 1), F.lit(len(PREFIX) + 1), F.length(out))
    psm = F.concat(F.substring_index(head, SUFFIX, 1), tail, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), tail, F.substring_index(head, PREFIX, 1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
