"""A corpus pipeline over ``documents``: quality classifier, quality rules, near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. The first three return documents with all their columns: those that the classifier predicts as good,
those that the current policy of the rules keeps, and one of each near-duplicate class. The last returns the pieces of
the documents that are left, with their places in sequences.

Defined cases: a null text is the empty text, which the rules reject; rows with a null ``doc_id`` are documents like
others; of repeated rows one is left; other columns, of whatever names, stay with their documents up to the packing; an
empty table gives no rows; without labels, or with labels of one kind only, all documents have one score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotloom.llm import classifier, minhash, packing, quality_rules
from shotloom.llm.storage import scratch, staged


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones outside the held-out fold."""
    labels = classifier.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.filter_documents(docs, classifier.fit(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    return quality_rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("MinHash near-dedup", drop_near_duplicates), ("best-fit packing", pack)]
#: No SQL: the classifier is trained, and near-duplicate classes are components of a graph.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for k, (_, stage) in enumerate(STAGES):
            with scratch(spark) as hand_on:  # what a stage needed only inside itself goes when its documents are written
                docs = hand_on(staged(stage(spark, docs, sf_dir), f"stage-{k}"))
        return keep(docs)
