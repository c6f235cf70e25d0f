"""Ranking, quotas, budgets and runs as windows. Every order is total: callers end it with an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, by, order, 1).drop("rank")


def spread(df: DataFrame, by: list[str], publisher: str, order: list[Column], size: int) -> DataFrame:
    """The best `size` rows of each group: first at most max(3, size // 3) of a publisher, then what is left fills the rest."""
    cap = max(3, size // 3)
    own = F.row_number().over(Window.partitionBy(*by, publisher).orderBy(*order))
    d = df.withColumn("_over", F.when(own > cap, 1).otherwise(0))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_over", *order))).where(F.col("rank") <= size).drop("_over")


def floor_fill(df: DataFrame, by: list[str], taken: Column, fit: Column, order: list[Column], floor: int) -> DataFrame:
    """Adds `filled`: rows not taken but fit, best first, as many as each group lacks to its floor."""
    w = Window.partitionBy(*by)
    lack = floor - F.sum(F.when(taken, 1).otherwise(0)).over(w)
    can = fit & ~taken
    rank = F.row_number().over(Window.partitionBy(*by, can).orderBy(*order))
    return df.withColumn("filled", can & (rank <= lack))


def prefix_budget(df: DataFrame, by: list[str], order: list[Column], cost: Column, budget: float, least: int = 0) -> DataFrame:
    """Rows while the running cost is within the budget, up to the first that is not; `least` rows are taken in any case."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("spent", F.sum(cost).over(w)).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return d.where((F.col("spent") <= budget) | (F.col("rank") <= least))


def islands(days: DataFrame, by: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: by, first, last, length."""
    d = days.select(*by, day).dropDuplicates()
    d = d.withColumn("_run", F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*by).orderBy(day))))
    return d.groupBy(*by, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("length")).drop("_run")


def runs(df: DataFrame, by: list[str], place: Column, gap: float) -> DataFrame:
    """Adds `run`: a new one begins where the place is further than `gap` from the one before."""
    w = Window.partitionBy(*by).orderBy("_place")
    d = df.withColumn("_place", place)
    new = F.when(F.col("_place") - F.lag("_place").over(w) > gap, 1).otherwise(0)
    return d.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_place")


def places(df: DataFrame, coarse: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in the order of all rows, from 1, without sorting them in one task.

    `coarse` are values that the order goes by first, with few rows each; rows are counted by them, only the counts are
    summed in one task, and rows are ranked among those of the same values. They sort
    ascending, so callers negate what descends, and none is null.
    """
    keys = [f"_{name}_{k}" for k in range(len(coarse))]
    d = df.withColumns(dict(zip(keys, coarse, strict=True)))
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(counts.withColumn("_before", before).drop("_n"), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return d.withColumn(name, (F.col("_before") + rank).cast("long")).drop("_before", *keys)
