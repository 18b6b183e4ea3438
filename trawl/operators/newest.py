"""The newest row of each key by its locator.

A wide row (page text, metadata of any type) should not be compared, sorted or shuffled to find out that it is old.
Rows of a Parquet table have a locator, the file and the position in it, which Spark offers as hidden columns:

1. Only the key, the order columns and the locator are read; the greatest (order, locator) of each key is its winner.
2. Winners become bit masks, one long for 64 neighbouring rows of a file.
3. The table is scanned in place against the masks and the winners pass; no payload is sorted or shuffled.  Masks are
   broadcast in slices of about ``MASKS`` longs; a slice holds whole files, and its scan reads those files alone, so
   all slices together read the table once.  Where one file has more masks than fit, Spark chooses the join.

A file must not change between the steps; Parquet files do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.session import checkpoint_dir, materialize

FILE, ROW = "_file", "_row"
#: Masks in one broadcast slice (about 100 MB as a hash table): 64 million rows and more.
MASKS = 1 << 20


def located(scan: DataFrame) -> DataFrame:
    """A Parquet scan with the locator of every row in ``_file`` and ``_row``."""
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def is_located(rows: DataFrame) -> bool:
    return {FILE, ROW} <= set(rows.columns)


def newest_rows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of each ``key``, the row with the greatest ``order`` columns (nulls last), then the last one by locator.

    ``rows`` is a :func:`located` scan, or a projection of one that keeps the locator.  The locator is dropped."""
    checkpoint_dir(rows.sparkSession)
    winner = F.max(F.struct(*order, FILE, ROW)).alias("w")
    return rows_at(rows, rows.select(key, *order, FILE, ROW).groupBy(key).agg(winner).select(f"w.{FILE}", f"w.{ROW}"))


def rows_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of a :func:`located` scan (or a projection of one) at ``places`` (``_file``, ``_row``), without the locator."""
    checkpoint_dir(rows.sparkSession)
    bit = F.expr(f"shiftleft(1L, cast({ROW} & 63 as int))")
    masks = materialize(places.groupBy(F.col(FILE).alias("mask_file"), F.shiftright(ROW, 6).alias("mask_at"))
                        .agg(F.bit_or(bit).alias("mask")), "newest-masks")
    slices = max(1, -(-masks.count() // MASKS))

    def slice_of(file: str):
        return F.pmod(F.xxhash64(file), F.lit(slices))

    widest = masks.groupBy(slice_of("mask_file")).count().agg(F.max("count")).first()[0] or 0
    out = None
    for s in range(slices):
        own, held = (rows, masks) if slices == 1 else (rows.where(slice_of(FILE) == s), masks.where(slice_of("mask_file") == s))
        if widest <= 2 * MASKS:
            held = F.broadcast(held)
        on = (F.col(FILE) == F.col("mask_file")) & (F.shiftright(ROW, 6) == F.col("mask_at"))
        hit = own.join(held, on).where(F.expr(f"shiftright(mask, cast({ROW} & 63 as int)) & 1 = 1"))
        hit = hit.select(*[c for c in rows.columns if c not in (FILE, ROW)])
        out = hit if out is None else out.unionByName(hit)
    return out
