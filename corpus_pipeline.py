"""Corpus pipeline: toxicity filter, exact dedup, near-dedup, source mixing, sequence packing.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with their own columns; the last returns
pieces of documents in their bins. run() writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import exact_dedup, minhash, mixing, packing, toxicity
from lattica.plans.shared import materialize, table

REJECT = 0.5


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT; the scorer learns from the labelled ones among docs."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, REJECT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts (A-Z lower-cased)."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their text, bin and place in it."""
    return packing.pack_documents(docs, with_text=True)


STAGES = [("toxicity", keep_civil), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources to target weights", mix), ("best-fit packing", pack)]
#: A learned filter, a signature join and integer packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
