"""Connected components of a graph held as a table of edges, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges` (a, b); a component is named by its least id.

    Each round gives every id the least label around it and then its label's label, so the number of
    rounds grows with the logarithm of the longest path. Labels are written to the shared folder
    after each round. Loops and repeated edges are harmless; no edges give no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    both = written(e.union(e.select("b", "a")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")))
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("now"))
        jump = labels.select(F.col("id").alias("now"), F.col("label").alias("next"))
        least = written(least.join(jump, "now").select("id", "label", F.least("now", "next").alias("now")))
        labels = least.select("id", F.col("now").alias("label"))
        if least.where("label <> now").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
