"""Stages of the corpus pipeline and how they are run one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, jaccard, language, line_dedup, pieces
from quillstream.llm.shared import spare, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = spare(docs, "_n_removed")
    out = line_dedup.dedup_lines(docs, removed=removed)
    if "n_chars" not in docs.columns:
        return out.drop(removed)
    n = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(n if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_each(docs, n=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training form of the documents: piece ids of the best path, scores of all paths, and whether they decode to the text."""
    import public_tokenizers

    found = pieces.segmented(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "ids", "score", F.transform("others", lambda o: o["score"]).alias("other_scores"), "decodes")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_identified),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", keep_one_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("SentencePiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
