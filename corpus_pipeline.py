"""Corpus preparation: each stage is written as Parquet and read again as the next one's documents.

Defined results: a null or empty text fails the quality limits and goes; rows are judged by id and text, so a null or
repeated id costs no row whose text differs, and of exact copies of one id and text one stays; of linked texts the
one with the smallest id stays, null first; an empty table passes all stages; the columns of documents keep their
order and any others pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm.common import table
from meltgrid.llm.decontamination import drop_contaminated
from meltgrid.llm.near_dedup import drop_near_duplicates
from meltgrid.llm.piece_coding import MARK, decode_pieces, encode_pieces
from meltgrid.llm.quality_rules import keep_quality
from meltgrid.llm.substring_dedup import dedup_documents
from meltgrid.session import settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or that the calibrated forest rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 on 5-word shingles the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller id has are cut out; lengths follow the texts."""
    return dedup_documents(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 80 % of the 5-word shingles of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text and whether they decode to it, beside the columns of documents."""
    back, text = F.col("decoded"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return decode_pieces(encode_pieces(docs)).withColumn("round_trip", back == text).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontamination), ("pieces", pieces),
]

#: Hash signatures, trained scores and piece vocabularies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows as a table of their own; what a stage wrote on its way is removed when it ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
