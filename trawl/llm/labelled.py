"""The labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import as_bool_learn, bounded_sample, materialize, text_or_empty


def learn_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents that may be learned from.

    Smallest hash of the id first, so the sample depends on the ids alone.  Of contradicting labels of one id the
    larger counts; null ids and labels do not.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")) \
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & as_bool_learn(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = materialize(ids, "labelled-ids")
    ids = bounded_sample(ids, F.col("doc_id"), ids.count(), most, widen=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    # at most ``most`` rows of two numbers
    return rows.join(F.broadcast(ids), "doc_id")
