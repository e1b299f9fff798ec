"""Documents to packed token sequences: quality, one of each near copy, no secrets, sources mixed, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.jaccard import one_of_each
from barloom.llm.mixing import mixed_documents
from barloom.llm.packing import pack_documents
from barloom.llm.quality import accepted
from barloom.llm.queries import vocabulary
from barloom.llm.secrets import redacted
from barloom.llm.shared import new_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorisation machine, fitted on ``labels``, scores 0.3 or more."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five words in a row are 80 % alike."""
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as much of them, as the mix of sources takes."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", jaccard_join), ("secret scans", secret_scans),
          ("mixing sources to target weights", mixing), ("best-fit packing", best_fit_packing)]

#: No stage is one that SQL can state; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
