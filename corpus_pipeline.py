"""From raw documents to token ids, in five stages over whole tables.

Each stage reads what its predecessor kept and returns the columns of
`documents`; the last returns token ids. Training labels and benchmark items are
read from `sf_dir`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontaminate, near_dup, pii, sentencepiece, toxicity
from tessel.llm.common import materialize, read
from tessel.llm.queries import KEY, PIECES


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    return pii.anonymize(docs, KEY)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    return sentencepiece.encode(docs, PIECES)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", minhash_near_dedup),
    ("decontamination", benchmark_decontamination),
    ("pii", pii_surrogates),
    ("sentencepiece", sentencepiece_encoding),
]
#: SQL cannot express the first stage (a trained classifier); the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
