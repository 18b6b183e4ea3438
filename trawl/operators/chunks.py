"""Document chunking.

* ``chunk_fixed`` (T8): plain overlapping windows, built-in functions only
  (``sequence`` + ``posexplode`` + ``substring``).
* ``chunk_documents`` (T7): recursive splitting on markdown-aware separators.
  The splitter is a small per-document Python helper run by a narrow
  ``mapInPandas``; documents are independent, so no shuffle is needed and a
  long document costs only its own task time.

Chunk numbers come from the array position (E1 without a window: no sort,
no shuffle); ``start`` picks 0-based (server) or 1-based (client) numbering.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.operators.util import spread

# Separators tried in order for the 'markdown' format
# (headings, code fences, horizontal rules, paragraphs, lines, words, characters).
MARKDOWN_SEPARATORS = [r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n",
                       r"\n\n", r"\n", r" ", r""]
TEXT_SEPARATORS = [r"\n\n", r"\n", r" ", r""]


def chunk_fixed(docs: DataFrame, size: int = 500, overlap: int = 50, key: str = "doc_id",
                text: str = "text", start: int = 0) -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap``
    after the previous one; the last window reaches the end of the text."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / F.lit(float(step))).cast("int") - 1)
    d = docs.select(key, text).where(F.col(text).isNotNull())
    ex = d.select(key, text, F.posexplode(F.sequence(F.lit(0), n)).alias("_p", "_i"))
    return ex.select(key, (F.col("_i") + start).alias("chunk_number"),
                     F.expr(f"substring({text}, _i * {step} + 1, {size})").alias("chunk_text"))


# ------------------------------------------------------------- T7 splitter

def _split_keep(text: str, sep: str) -> list[str]:
    """Split on a separator regex, keeping each separator at the start of
    the piece that follows it."""
    if sep == "":
        return list(text)
    out, last = [], 0
    for m in re.finditer(sep, text):
        if m.start() == 0:
            continue
        out.append(text[last:m.start()])
        last = m.start()
    out.append(text[last:])
    return [p for p in out if p != ""]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy merge of small pieces into chunks <= size, carrying a tail of
    at most ``overlap`` characters into the next chunk."""
    chunks, cur, total = [], [], 0
    for p in pieces:
        if cur and total + len(p) > size:
            c = "".join(cur).strip()
            if c:
                chunks.append(c)
            while cur and (total > overlap or total + len(p) > size):
                total -= len(cur[0])
                cur.pop(0)
        cur.append(p)
        total += len(p)
    c = "".join(cur).strip()
    if c:
        chunks.append(c)
    return chunks


def split_text(text: str, size: int, overlap: int, separators=None) -> list[str]:
    """Recursive character splitting: split on the first separator that
    occurs; pieces longer than ``size`` are split again with the next
    separators; neighbouring small pieces are merged up to ``size``."""
    seps = MARKDOWN_SEPARATORS if separators is None else separators
    if text is None:
        return []
    sep_i = len(seps) - 1
    for i, s in enumerate(seps):
        if s == "" or re.search(s, text):
            sep_i = i
            break
    pieces = _split_keep(text, seps[sep_i])
    rest = seps[sep_i + 1:]
    out, small = [], []
    for p in pieces:
        if len(p) <= size:
            small.append(p)
            continue
        if small:
            out.extend(_merge(small, size, overlap))
            small = []
        if rest:
            out.extend(split_text(p, size, overlap, rest))
        else:
            out.append(p)
    if small:
        out.extend(_merge(small, size, overlap))
    return out


_CHUNK_OUT = T.StructType([
    T.StructField("chunk_number", T.IntegerType()),
    T.StructField("chunk_text", T.StringType()),
])


def chunk_documents(docs: DataFrame, size: int = 5000, overlap: int = 500, key: str = "doc_id",
                    text: str = "text", start: int = 0, fmt: str = "markdown") -> DataFrame:
    """T7 (+ C7, E1): ``(key, chunk_number, chunk_text)`` per document."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    seps = MARKDOWN_SEPARATORS if fmt == "markdown" else TEXT_SEPARATORS
    key_field = docs.schema[key]
    out_schema = T.StructType([key_field] + _CHUNK_OUT.fields)

    def run(batches):
        for pdf in batches:
            keys, nums, texts = [], [], []
            for k, t in zip(pdf[key], pdf[text]):
                for i, c in enumerate(split_text(t, size, overlap, seps)):
                    keys.append(k)
                    nums.append(i + start)
                    texts.append(c)
            yield pd.DataFrame({key: pd.Series(keys, dtype=object if not keys else None),
                                "chunk_number": pd.Series(nums, dtype="int32"),
                                "chunk_text": pd.Series(texts, dtype=object)})

    return spread(docs.select(key, text).where(F.col(text).isNotNull())).mapInPandas(run, out_schema)


def chunk_with_prefix(chunks: DataFrame, name_col: str, text_col: str = "chunk_text") -> DataFrame:
    """``Content from page [name]: text`` (the client-side chunk text)."""
    return chunks.withColumn(text_col, F.concat(F.lit("Content from page ["), F.col(name_col).cast("string"),
                                                F.lit("]: "), F.col(text_col)))
