"""A corpus pipeline: quality rules, near-duplicates, personal data, mixture, token ids.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet into the shared folder and read again as the next stage's documents.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.bpe import encode_documents
from trawl.llm.mixing import sample_mixture
from trawl.llm.pii import pseudonymize
from trawl.llm.quality_rules import keep_good
from trawl.llm.queries import VOCABULARY
from trawl.llm.simhash import drop_near_duplicates
from trawl.session import materialize, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    ship_package(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; the length follows the new text."""
    ship_package(spark)
    out = pseudonymize(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with the probabilities of the raked mixture."""
    ship_package(spark)
    return sample_mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of the ids and of the decoded text."""
    ship_package(spark)
    return encode_documents(docs, VOCABULARY, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("simhash near-duplicates", near_duplicates),
    ("pii surrogates", personal_data),
    ("mixing", mixture),
    ("bpe", token_ids),
]

#: SimHash, keyed surrogates and BPE are beyond SQL; the tests run the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
