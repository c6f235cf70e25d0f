"""Full-text search and extractive summaries over tables of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bm25(docs: DataFrame, query: list[str], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents (id, words) that hold every query word; only the query's postings are joined."""
    sizes = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("words")).alias("mean"))
    post = docs.select("id", F.size("words").alias("len"), F.explode(F.filter("words", lambda w: w.isin(*query))).alias("w")).groupBy("id", "len", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    p = post.join(F.broadcast(df), "w").join(F.broadcast(sizes))  # a row for each query word, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return p.groupBy("id").agg(F.sum(s).alias("score"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") == len(set(query))).drop("hits")


def ranked_sentences(sentences: DataFrame) -> DataFrame:
    """(id, place, score) of sentences (id, place, words): rare words that the text repeats, over the root of the length, the lead weighing more.

    Frequencies are those of the text itself, as a window over its id.
    """
    w = sentences.select("id", "place", F.size("words").alias("len"), F.explode(F.array_distinct("words")).alias("w"))
    own = Window.partitionBy("id", "w")
    w = w.withColumn("df", F.count(F.lit(1)).over(own))
    n = sentences.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    w = w.join(n, "id").withColumn("weight", F.log(1 + F.col("n") / F.col("df")) * F.when(F.col("df") > 1, 1.4).otherwise(1.0))
    lead = F.when(F.col("place") == 0, 1.5).when(F.col("place") == 1, 1.15).otherwise(1.0)
    return w.groupBy("id", "place", "len").agg(F.sum("weight").alias("s")).select("id", "place", (F.col("s") / F.sqrt("len") * lead).alias("score"))


def pruned(points: Column, most: int, overlap: float = 0.6) -> Column:
    """Of (words, text) in order of preference the first `most` that share less than `overlap` of their words with each one kept before."""
    def keep(kept: Column, p: Column) -> Column:
        like = F.exists(kept, lambda k: F.size(F.array_intersect(k["words"], p["words"])) >= overlap * F.least(F.size(k["words"]), F.size(p["words"])))
        return F.when((F.size(kept) < most) & ~like, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(points, F.slice(points, 1, 0), keep)
