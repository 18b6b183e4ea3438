"""Vector column functions (H18, H19) as built-in expressions.

These run inside the JVM but use higher-order functions, which are not
whole-stage code generated; the retrieval operators therefore score whole
blocks in numpy (``trawl.operators.retrieve``) and keep these for small
inputs, checks and SQL users.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.util import as_col


def as_vector(values, dim: int | None = None) -> Column:
    """``ARRAY_CONSTRUCT(...)::vector(FLOAT, dim)``: cast to array<float>;
    NULL when the length is not ``dim``."""
    v = as_col(values).cast("array<float>")
    if dim is None:
        return v
    return F.when(F.size(v) == dim, v)


def dot(a, b) -> Column:
    prods = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """``VECTOR_COSINE_SIMILARITY``; NULL for a zero vector or unequal lengths."""
    a, b = as_col(a), as_col(b)
    same = F.size(a) == F.size(b)
    return F.when(same, F.try_divide(dot(a, b), norm(a) * norm(b)))
