"""A corpus from raw documents to packed sequences: quality, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame that is
written to the shared folder as Parquet and reread. All stages but the last return the columns of documents.
ORACLE_SQL is None: SQL cannot express the classifier, the fingerprints or the packing; tests hold run() against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm.common import id_and_text, stored, table
from topicloom.llm.exact_dedup import drop_exact_duplicates
from topicloom.llm.mixing import Mix, take_mix
from topicloom.llm.packing import pack_documents
from topicloom.llm.quality import keep_good, train
from topicloom.llm.simhash import drop_near_duplicates

#: No document is repeated, and a fifth of the tokens may go to reach the weights.
MIX = Mix(share=0.8, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble, fitted on this corpus's labels, scores below 0.3."""
    return keep_good(docs, train(id_and_text(docs, "doc_id", "text"), table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the document with the largest id stays."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: Jaccard similarity of 0.8 or more of their 5-word shingles."""
    return drop_near_duplicates(docs, similarity=0.8, shingle_words=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the budgets of the domain, language and source tree."""
    return take_mix(docs, MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's tokens in sequences of at most 4096."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
