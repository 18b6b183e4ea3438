"""Ingest with a bounded memory of what was seen (ST1).

The URLs seen so far are a table in versions, by buckets of the URL's hash; no state store grows with them.  A batch

1. reads its URLs and row locators alone and keeps the first row of each URL;
2. asks the Bloom filters of its buckets (written with each batch, ``BITS`` bits a URL): most new URLs are settled here;
3. tests the rest exactly, against the URLs of the buckets that they hit and no others;
4. takes the rows of the new URLs by locator, so page bodies are neither shuffled nor sorted;
5. commits rows, URLs and filters in one manifest.  A batch that is repeated after a crash finds its version and adds
   nothing; a crash before the commit leaves no trace.

:meth:`SeenIngest.compact` merges the URLs and filters of many batches into one piece a bucket.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trawl.functions.urls import normalize_url
from trawl.operators.newest import FILE, ROW, located, rows_at
from trawl.session import checkpoint_dir, materialize
from trawl.sources.versions import Versions

BITS = 10
HASHES = 7
_KEYS = "bucket int, url string, h1 long, h2 long"


def _bits(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """(HASHES x rows): the bits of each URL in a filter of ``size`` bits."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(size) for i in range(HASHES)]).astype(np.int64)


def make_filter(h1: np.ndarray, h2: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-BITS * len(h1) // 64) * 64), np.uint8)
    bits[_bits(h1, h2, len(bits)).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(filters: Iterable[bytes], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h1), bool)
    for f in filters:
        bits = np.unpackbits(np.frombuffer(f, np.uint8))
        out |= bits[_bits(h1, h2, len(bits))].all(axis=0)
    return out


def _filtered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "bits": [make_filter(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())]})


def _maybe(urls: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if urls.empty:
        return urls[["bucket", "url"]]
    return urls.loc[may_hold(filters["bits"], urls["h1"].to_numpy(), urls["h2"].to_numpy()), ["bucket", "url"]]


class SeenIngest(Versions):
    """Rows with a URL, each URL once, and the memory of the URLs.

    Versions are numbered 2 x epoch, and 2 x epoch + 1 for a compaction after it."""

    def __init__(self, spark: SparkSession, path: str, url_col: str = "url", buckets: int = 64):
        super().__init__(spark, path)
        self.url, self.buckets = url_col, buckets
        checkpoint_dir(spark)

    def _pieces(self, kind: str) -> list[tuple[str, list]]:
        return [(f, json.loads(n)) for p, (f, n) in sorted(self.manifest().items()) if p.startswith(kind)]

    def read(self) -> DataFrame:
        """All rows ingested; an error before the first."""
        pieces = self._pieces("rows")
        schema = StructType.fromJson(pieces[0][1])
        return self.spark.read.schema(schema).parquet(*[self.at(f) for f, _ in pieces])

    def seen(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The URLs seen, of all buckets or of some."""
        want = None if buckets is None else set(buckets)
        paths = [self.at(os.path.join(f, f"bucket={b}")) for f, bs in self._pieces("seen") for b in bs if want is None or b in want]
        if not paths:
            return self.spark.createDataFrame([], "url string, h1 long, h2 long")
        return self.spark.read.schema("url string, h1 long, h2 long").parquet(*paths)

    def _keyed(self, urls: DataFrame) -> DataFrame:
        h = F.xxhash64("url")
        return urls.withColumn("bucket", F.pmod(h, F.lit(self.buckets)).cast("int")) \
            .withColumn("h1", F.xxhash64("url", F.lit(1))).withColumn("h2", F.xxhash64("url", F.lit(2)))

    def _known(self, keys: DataFrame) -> DataFrame:
        """The URLs of ``keys`` that were seen."""
        filters = self._pieces("bloom")
        if not filters:
            return keys.select("url").limit(0)
        bits = self.spark.read.schema("bucket int, bits binary").parquet(*[self.at(f) for f, _ in filters])
        maybe = materialize(keys.select("bucket", "url", "h1", "h2").groupBy("bucket").cogroup(bits.groupBy("bucket"))
                            .applyInPandas(_maybe, "bucket int, url string"), "seen-maybe")
        hit = [r[0] for r in maybe.select("bucket").distinct().collect()]
        return maybe.select("url").join(self.seen(hit).select("url"), "url", "left_semi")

    def _memory(self, urls: DataFrame, name: str) -> dict[str, tuple[str, str]]:
        """Write URLs (bucket, url, h1, h2) and their filters; the pieces."""
        seen, bloom = self.new_folder("seen"), self.new_folder("bloom")
        urls.select("bucket", "url", "h1", "h2").repartition("bucket").write.partitionBy("bucket").parquet(self.at(seen))
        urls.groupBy("bucket").applyInPandas(_filtered, "bucket int, bits binary").write.parquet(self.at(bloom))
        buckets = sorted(r[0] for r in urls.select("bucket").distinct().collect())
        return {f"seen-{name}": (seen, json.dumps(buckets)), f"bloom-{name}": (bloom, "[]")}

    def ingest(self, batch: DataFrame, epoch: int) -> bool:
        """Add the rows of a located ``batch`` whose URL is new; False if the epoch is there already."""
        last = self.latest()
        if last is not None and last >= 2 * epoch:
            return False
        first = batch.select(F.col(self.url).alias("url"), FILE, ROW).where(F.col("url").isNotNull()) \
            .groupBy("url").agg(F.min(F.struct(FILE, ROW)).alias("at"))
        keys = materialize(self._keyed(first), "seen-keys")
        new = materialize(keys.join(self._known(keys), "url", "left_anti"), "seen-new")
        rows = rows_at(batch, new.select(f"at.{FILE}", f"at.{ROW}"))
        folder = self.new_folder(f"rows{epoch}")
        rows.write.parquet(self.at(folder))
        pieces = {} if last is None else self.manifest(last)
        self.commit(2 * epoch, {**pieces, f"rows-{epoch:012}": (folder, rows.schema.json()), **self._memory(new, str(epoch))})
        return True

    def compact(self) -> None:
        """One piece of URLs and filters instead of one for each batch."""
        last = self.latest()
        if last is None or last % 2:
            return
        kept = {p: v for p, v in self.manifest(last).items() if p.startswith("rows")}
        self.commit(last + 1, {**kept, **self._memory(self._keyed(self.seen().select("url")), f"c{last}")})


def stream_ingest_seen(spark: SparkSession, source_dir: str, sink: str, checkpoint: str, schema: StructType, url_col: str = "url",
                       buckets: int = 64, max_files_per_trigger: int | None = None, compact_every: int = 64, wait: bool = True):
    """ST1: file source -> normalise URL -> skip seen URLs -> :class:`SeenIngest` at ``sink`` (one sink a checkpoint)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = located(r.parquet(source_dir)).withColumn(url_col, normalize_url(url_col))

    def ingest(batch: DataFrame, epoch: int) -> None:
        table = SeenIngest(batch.sparkSession, sink, url_col, buckets)
        if table.ingest(batch, epoch) and (epoch + 1) % compact_every == 0:
            table.compact()

    q = rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        q.awaitTermination()
    return q
