"""Counts for a view: facets, headline figures, coverage with zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, facets: dict[str, Column], filters: dict[str, Column]) -> DataFrame:
    """(facet, value, n): rows by each facet's value under all filters but the facet's own, in one scan."""
    passes = {f: F.lit(True) for f in facets}
    for f in facets:
        for name, ok in filters.items():
            if name != f:
                passes[f] = passes[f] & F.coalesce(ok, F.lit(False))
    each = F.array(*(F.struct(F.lit(f).alias("facet"), c.cast("string").alias("value"), passes[f].alias("ok")) for f, c in facets.items()))
    return df.select(F.explode(each).alias("f")).where("f.ok").groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def with_zeros(counts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Every key of a small dimension with its count, or 0."""
    return F.broadcast(dimension).join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def heat(n: Column) -> Column:
    """0 to 4 for none, up to 2, up to 5, up to 10, and more."""
    return F.when(n == 0, 0).when(n <= 2, 1).when(n <= 5, 2).when(n <= 10, 3).otherwise(4)
