"""A training-data pipeline: language, exact copies, near copies, mixture, tokens.

Each stage works on all that the stage before kept, written as Parquet and read
again; all but the last return the columns of documents. Null and empty texts leave
at the first stage, rows that repeat at the second; columns of any name pass through;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, exact, langid, mixing, near
from quillon.llm.common import delete, scratch, shrink_heaps, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null, empty and letterless texts.

    A text with letters always gets a learned language and stays. If no row is
    labelled, nothing is recognisable and all rows go.
    """
    return langid.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text (white space aside): the longest, then the smallest doc_id (null last), then the first place."""
    return exact.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (sets of five-word shingles alike to 0.8 or more, all links: SimHash, then an exact join): the smallest doc_id (null last), then the first place."""
    return near.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins toxic documents until their expected tokens meet their target; no document is repeated. Without labels all stay."""
    return mixing.mix_stage(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of identifiers and decoded text, one row for each row that came."""
    shrink_heaps(spark)
    coded = bpe.encode_column(docs, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds each against what it must keep and drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; of the stages' folders only the one the result is read from stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
