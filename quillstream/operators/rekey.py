"""Rows moved to the keys that theirs have become, and the conflicts that this makes resolved, as one merge.

Keys follow a mapping that chains: an old key leads to a newer one, that one to a listed one. Each
connected block of the mapping has one end, which all of its keys become; a mapping that runs in a circle has none,
there the least key stands for all. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators import clusters


def resolved(mapping: DataFrame) -> DataFrame:
    """(old, new) with the end of each chain of mapping (old, new). A key that leads to itself or nowhere ends; of several ways from a key the least counts."""
    m = clusters.durable(mapping.where("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new")))
    if m.isEmpty():
        return m
    of = clusters.blocks(m.select(F.col("old").alias("a"), F.col("new").alias("b")))
    ends = of.join(m.select(F.col("old").alias("id")), "id", "left_anti").groupBy("block").agg(F.min("id").alias("end"))
    least = of.groupBy("block").agg(F.min("id").alias("least"))
    d = of.join(least, "block").join(ends, "block", "left")
    return d.select(F.col("id").alias("old"), F.coalesce("end", "least").alias("new")).where("old <> new")


def rekeyed(rows: DataFrame, mapping: DataFrame, key: str, edition: str, order: list[Column], fill: tuple[str, ...] = ()) -> DataFrame:
    """`rows` under their resolved keys, of each key and edition the first by `order` (total), which takes from the others in that order what it lacks of `fill`.

    Adds merged, how many rows went into it, and moved, whether its own key changed. Doing it again changes nothing.
    """
    to = resolved(mapping).withColumnsRenamed({"old": key, "new": "_to"})
    d = rows.join(to, key, "left").withColumn("moved", F.col("_to").isNotNull()).withColumn(key, F.coalesce("_to", key)).drop("_to")
    place = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    own = [c for c in d.columns if c not in (key, edition)]
    first = F.min_by(F.struct(*own), place).alias("x")
    filled = [F.min_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), place)).alias(f"_fill_{c}") for c in fill]
    g = d.groupBy(key, edition).agg(first, (F.count(F.lit(1)) - 1).alias("merged"), *filled)
    return g.select(key, edition, *(F.col(f"_fill_{c}.v").alias(c) if c in fill else F.col(f"x.{c}").alias(c) for c in own), "merged")
