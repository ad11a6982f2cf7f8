"""The training-data pipeline over ``documents``: good texts, one of each near copy, without secrets, mixed to target weights, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candorframe.llm import minhash, mixing, packing, quality, secrets
from candorframe.llm.common import read, stage
from candorframe.llm.queries import MIX_ANCHOR, MIX_TARGETS, label_domains, tokenizer_path

#: Similarity from which the pipeline takes texts for near copies.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; copies share 80 % of their word shingles."""
    return minhash.keep_first(docs, NEAR_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    out = secrets.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixing.draw(docs, label_domains(read(spark, sf_dir, "labels")), MIX_TARGETS, MIX_ANCHOR)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("target_mixing", target_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the links and the tokens cannot be said in SQL; the tests check the ids and columns of each stage, not the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each is written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
