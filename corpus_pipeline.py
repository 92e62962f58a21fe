"""The corpus pipeline: five operators in turn, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of
`documents`; the last returns the digests of the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import byte_bpe, decontaminate, jaccard, quality, secrets
from tideglass.llm.common import table
from tideglass.llm.queries import BYTE_BPE
from tideglass.session import materialise

#: The classifier and the component search have no SQL form; tests compare with plain code.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns from the labels of `docs`."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    return jaccard.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with too many words of benchmark windows."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark, in plain sight or wrapped; the documents stay."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return byte_bpe.round_trip(docs, BYTE_BPE)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
