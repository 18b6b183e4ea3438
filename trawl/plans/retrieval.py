"""Registered retrieval queries over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.operators import retrieve
from trawl.plans.registry import query
from trawl.sources.tables import read_table

EMB_KEYS = dict(key_cols=("vec_id",), vector_col="embedding")


def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _question(emb, vec_id=0):
    return emb.where(F.col("vec_id") == vec_id).select(
        F.col("vec_id").alias("q_id"), F.col("embedding").alias("qvec"))


def _cos_sql(a, b):
    return f"list_cosine_similarity(({a})::DOUBLE[], ({b})::DOUBLE[])"


@query("similar_chunks", headline=True, oracle=f"""
with q as (select embedding as qv from embeddings where vec_id = 0),
s as (select e.vec_id, e.label, {_cos_sql('e.embedding', 'q.qv')} as sim from embeddings e, q)
select vec_id, label, round(sim, 6) as similarity,
       cast(row_number() over (order by round(sim, 9) desc, vec_id) as integer) as rank
from s where sim >= 0.3
qualify row_number() over (order by round(sim, 9) desc, vec_id) <= 5
""")
def q_similar_chunks(spark, sf_dir):
    """F4 + B6: top-5 by cosine with threshold 0.3 for the vector of ``vec_id`` 0."""
    emb = _emb(spark, sf_dir)
    res = retrieve.similar_chunks(emb, _question(emb), k=5, threshold=0.3,
                                  payload_cols=("label",), **EMB_KEYS)
    return res.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "rank")
