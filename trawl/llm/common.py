"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.session import materialize

__all__ = ["as_bool_learn", "bounded_sample", "fresh", "let", "materialize", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: Column | str) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark ignores case)."""
    low = {c.lower() for c in taken}
    name, k = base, 0
    while name.lower() in low:
        k += 1
        name = f"{base}_{k}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def as_bool_learn(doc_id: Column) -> Column:
    """True for the rows that a model may learn labels from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def bounded_sample(df: DataFrame, key: Column, rows: int, most: int, widen: bool = False) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``, of a frame with about ``rows`` rows.

    A first cut by the hash leaves little more than ``most`` rows, so no task and no driver sees more than that.
    With ``widen`` (for a frame that is cheap to count) the cut grows until it holds ``most`` rows, or all.
    """
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30))
    cut = min(1 << 30, int((1.2 * most + 100) / max(1, rows) * (1 << 30)))
    while widen and cut < 1 << 30 and df.filter(place < cut).count() < most:
        cut = min(1 << 30, 2 * cut)
    return df.filter(place < cut).orderBy(place, key).limit(most)
