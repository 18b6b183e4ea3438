"""Chunks that follow their pages.

A crawl log changes: pages come back with other texts, or with none.  :class:`ChunkStore` keeps chunks by the digest of
the text they were cut from, in a table in versions with two kinds of pieces:

* chunk pieces: (source_id, digest, chunk_number, chunk_text, vector).  They are only ever added.
* set pieces: (source_id, digest, version): from this version on the source's chunks are those of this digest.  A NULL
  digest is a tombstone: the source has no chunks any more.

:meth:`ChunkStore.sync` compares the digests of the newest texts with the newest sets.  Only texts never stored for
their source are cut and embedded; a page that returns to an earlier text gets its old chunks back, and a page that
did not change costs its digest.  Chunks, sets and tombstones of a run appear in one manifest, so readers never see a
page with both texts, or with none.  The newest set of a source is an aggregate over short rows; chunk texts and
vectors are not sorted, and they move only if the sets exceed the broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trawl.operators import embed as E
from trawl.operators.crawl_log import latest_per_url
from trawl.session import checkpoint_dir, materialize
from trawl.sources.versions import Versions

_SETS = "source_id string, digest string, version long"


class ChunkStore(Versions):
    """The chunks of a crawl log under ``path``.

    ``chunker(docs(source_id, text)) -> (source_id, chunk_number, chunk_text)``; ``model`` as for :func:`embed.embed`."""

    def __init__(self, spark: SparkSession, path: str, chunker: Callable[[DataFrame], DataFrame], model=None,
                 dim: int = E.DEFAULT_DIM):
        super().__init__(spark, path)
        self.chunker, self.model, self.dim = chunker, model, dim
        checkpoint_dir(spark)

    def _folders(self, kind: str) -> list[str]:
        return [self.at(f) for _, (f, note) in sorted(self.manifest().items()) if note == kind]

    def sets(self) -> DataFrame:
        """(source_id, digest): the chunk set of every source that has one."""
        folders = self._folders("sets")
        if not folders:
            return self.spark.createDataFrame([], _SETS).select("source_id", "digest")
        newest = self.spark.read.schema(_SETS).parquet(*folders).groupBy("source_id") \
            .agg(F.max(F.struct("version", "digest")).alias("s"))
        return newest.select("source_id", "s.digest").where(F.col("digest").isNotNull())

    def _stored(self) -> DataFrame | None:
        folders = self._folders("chunks")
        return self.spark.read.parquet(*folders) if folders else None

    def chunks(self) -> DataFrame:
        """(source_id, chunk_number, chunk_text, vector) of the newest sets."""
        stored = self._stored()
        if stored is None:
            return self.spark.createDataFrame([], StructType.fromDDL(
                "source_id string, chunk_number int, chunk_text string, vector array<float>"))
        return stored.join(materialize(self.sets(), "chunk-sets"), ["source_id", "digest"], "left_semi") \
            .select("source_id", "chunk_number", "chunk_text", "vector")

    def sync(self, log: DataFrame, text_col: str = "markdown", drop_missing: bool = False) -> int | None:
        """Bring the chunks up to the newest row of each URL of ``log``; the new version, or the old one if nothing
        changed.  A newest row without a text drops the chunks of its URL; with ``drop_missing`` so does a URL that
        ``log`` no longer names."""
        last = self.latest()
        newest = latest_per_url(log) if "ts" in log.columns else log
        newest = newest.select(F.col("url").alias("source_id"), F.col(text_col).alias("text")).where(F.col("source_id").isNotNull())
        now = materialize(newest.withColumn("digest", F.sha2("text", 256)), "chunk-texts")
        live = materialize(self.sets(), "chunk-live")
        keys = now.where("digest is not null").select("source_id", "digest")
        changed = keys.join(live, ["source_id", "digest"], "left_anti")
        gone = live.select("source_id").join(keys.select("source_id"), "source_id", "left_anti")
        if not drop_missing:
            gone = gone.join(now.select("source_id"), "source_id", "left_semi")
        sets = materialize(changed.unionByName(gone.withColumn("digest", F.lit(None).cast("string")))
                           .withColumn("version", F.lit(0 if last is None else last + 1).cast("long")), "chunk-changes")
        if sets.isEmpty():
            return last
        pieces = {} if last is None else self.manifest(last)
        version = 0 if last is None else last + 1
        stored = self._stored()
        if stored is None:          # nothing is stored yet: every text is cut where it lies
            todo, docs = keys, now.where("digest is not null")
        else:                       # an earlier text of the page: its chunks are there
            todo = materialize(sets.select("source_id", "digest").where("digest is not null")
                               .join(stored.select("source_id", "digest").distinct(), ["source_id", "digest"], "left_anti"), "chunk-todo")
            docs = now.join(todo, ["source_id", "digest"], "left_semi")
        # digests join the chunks before they are embedded, so no vector moves
        cut = self.chunker(docs.select("source_id", "text")).join(todo, "source_id")
        folder = self.new_folder("chunks")
        E.embed(cut, "chunk_text", self.model, self.dim, "vector") \
            .select("source_id", "digest", "chunk_number", "chunk_text", "vector").write.parquet(self.at(folder))
        pieces[f"chunks-{version:012}"] = (folder, "chunks")
        folder = self.new_folder("sets")
        sets.write.parquet(self.at(folder))
        pieces[f"sets-{version:012}"] = (folder, "sets")
        self.commit(version, pieces)
        return version

    def compact(self) -> int | None:
        """A version that holds the chunks and sets in use alone, each in one piece."""
        last = self.latest()
        if last is None:
            return None
        sets, version = materialize(self.sets(), "chunk-sets"), last + 1
        chunks, kept = self.new_folder("chunks"), self.new_folder("sets")
        self._stored().join(sets, ["source_id", "digest"], "left_semi").write.parquet(self.at(chunks))
        sets.withColumn("version", F.lit(version).cast("long")).write.parquet(self.at(kept))
        self.commit(version, {f"chunks-{version:012}": (chunks, "chunks"), f"sets-{version:012}": (kept, "sets")})
        return version
