"""Keyed upserts on plain Parquet: the new state as a DataFrame, and partition overwrites to write it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], policy: str = "replace") -> DataFrame:
    """`base` with `delta`, whose rows have distinct keys.

    replace: delta wins; ignore: base wins; fill: base's nulls are filled. Columns that one side lacks are null there.
    """
    b, d = base.alias("b"), delta.alias("d")
    cols = [c for c in base.columns if c not in keys]
    has = set(delta.columns)
    j = b.withColumn("_base", F.lit(True)).join(d.withColumn("_delta", F.lit(True)).withColumnsRenamed({c: f"_d_{c}" for c in delta.columns if c not in keys}), keys, "full_outer")
    value = {"replace": lambda c: F.when(F.col("_delta"), F.col(f"_d_{c}")).otherwise(F.col(c)), "ignore": lambda c: F.when(F.col("_base"), F.col(c)).otherwise(F.col(f"_d_{c}")), "fill": lambda c: F.coalesce(F.col(c), F.col(f"_d_{c}"))}[policy]
    return j.select(*keys, *((value(c) if c in has else F.col(c)).alias(c) for c in cols))


def new_rows(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.join(base.select(*keys), keys, "left_anti")


def removed(base: DataFrame, doomed: F.Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, the distinct keys that lost rows)."""
    bad = F.coalesce(doomed, F.lit(False))
    return base.where(~bad), base.where(bad).select(key).distinct()


def unite(a: DataFrame, b: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Two snapshots of progress: each column by its rule, greatest, least, any or latest (by `at`)."""
    j = a.join(b.withColumnsRenamed({c: f"_{c}" for c in b.columns if c != key}), key, "full_outer")
    newer = F.coalesce(F.col("_at") > F.col("at"), F.col("at").isNull())
    pick = {
        "greatest": lambda c: F.greatest(c, f"_{c}"),
        "least": lambda c: F.least(c, f"_{c}"),
        "any": lambda c: F.coalesce(c, F.lit(False)) | F.coalesce(f"_{c}", F.lit(False)),
        "latest": lambda c: F.when(newer, F.col(f"_{c}")).otherwise(F.col(c)),
    }
    return j.select(key, *(pick[r](c).alias(c) for c, r in rules.items()))


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes the partitions that `df` has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def archive_months(df: DataFrame, frozen: DataFrame, path: str) -> None:
    """Appends JSON for the months that are not frozen yet; frozen ones are never written again."""
    df.join(frozen.select("month"), "month", "left_anti").write.mode("append").partitionBy("month").json(path)
