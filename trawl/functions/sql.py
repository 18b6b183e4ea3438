"""SQL surface: functions a SQL user can call after ``register(spark)``.

* ``chunk_text(text, size, overlap)`` - table function (Python UDTF, Arrow
  batched) with the recursive splitter of ``trawl.operators.chunks``:
  ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 500, 50) c``
* ``chunk_texts(text, size, overlap)`` - the same splitter over whole Arrow batches, an array of
  ``(chunk_number, chunk_text)``: ``SELECT d.doc_id, c.* FROM documents d LATERAL VIEW inline(chunk_texts(d.text, 500, 50)) c``
* ``cosine_similarity(a, b)`` - SQL function body of higher-order functions
  (``VECTOR_COSINE_SIMILARITY``); NULL for a zero vector or unequal lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from trawl.operators.chunks import split_text


@udtf(returnType="chunk_number: int, chunk_text: string", useArrow=True)
class ChunkText:
    def eval(self, text, size, overlap):
        if text is None:
            return
        for i, c in enumerate(split_text(text, int(size), int(overlap))):
            yield i, c


#: Characters of text that are split before their chunks are passed on (a batch may hold 64 MB of texts).
PIECE_CHARS = 4 << 20


@pandas_udf("array<struct<chunk_number:int,chunk_text:string>>")
def chunk_texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, sizes, overlaps in batches:
        out, held = [], 0
        for t, n, o in zip(texts, sizes, overlaps):
            out.append([{"chunk_number": i, "chunk_text": c} for i, c in enumerate(split_text(t, int(n), int(o)))])
            held += len(t or "")
            if held >= PIECE_CHARS:
                yield pd.Series(out, dtype=object)
                out, held = [], 0
        yield pd.Series(out, dtype=object)


COSINE_SQL = """
CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>)
RETURNS DOUBLE
RETURN CASE WHEN size(a) = size(b) THEN try_divide(
  aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v),
  sqrt(aggregate(a, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))
  * sqrt(aggregate(b, CAST(0 AS DOUBLE), (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) END
"""


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("chunk_texts", chunk_texts)
    spark.sql(COSINE_SQL)
