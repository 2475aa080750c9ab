"""A training corpus from ``documents``, stage by stage.

Each stage reads what the one before it wrote, works on all of it and hands on
the columns of ``documents``, and any others of any name; the last returns token ids.

A null text is an empty text: the quality rules reject both, and texts of fewer
than 50 words. Of rows whose texts are near copies, repeated rows among them, the
one of the least doc_id stays, a null one only if all are, and of equal doc_ids the
first that was read. Masking keeps every row and nulls as they are. A null source is
a source of its own, the last. A document that the mix takes twice is two rows, and
gets its ids twice. Every stage of an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modetrace.llm import bpe, mixing, near, pii, quality
from modetrace.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go."""
    return quality.accept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity 0.8 or more of
    five-word shingles) the least doc_id stays."""
    return near.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in texts are masked; every document stays."""
    return pii.redact(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source takes its share; documents leave, stay or come twice."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of each document."""
    rows = bpe.roundtrip(docs)
    return bpe.digests(rows, keep=("ids",))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("target_weights", target_weights),
    ("token_ids", token_ids),
]

#: SQL can't express the trees, fingerprints or merges: tests/llm/test_pipeline.py has each
#: stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
