"""Tables in versions: pieces under a folder, and manifests that say which pieces are the table.

``<path>/data/...`` holds the pieces, folders of Parquet files that never change once written.
``<path>/versions/v=<n>/`` holds one manifest of few rows (piece, folder, note).  Spark writes it to a temporary place
and moves it when the write commits, so a reader sees the whole manifest or none; the manifest with the greatest number
is the table.  Readers need nothing else, and a version that was read stays readable while the next one is written.  A
crash before the commit of the manifest leaves pieces that no manifest names, and the old table.  Two writers of the
same version: the second one fails (the folder exists).  Old pieces are removed by the folder's retention policy.

:class:`BucketedTable` keeps rows by a hash of their key, so an upsert rewrites the buckets that it hits and no other.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "piece string, folder string, note string"
_BUCKET = "_bucket"
#: Rows of one bucket that go through one task when a bucket is written.
ROWS_A_TASK = 5_000_000


class Versions:
    """The manifests of a table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def latest(self, at_most: int | None = None) -> int | None:
        """The greatest committed version (of those up to ``at_most``); None before the first."""
        try:
            v = self.spark.read.schema(_MANIFEST).json(os.path.join(self.path, "versions"))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        if "v" not in v.columns:
            return None
        v = v.select(F.col("v").cast("long").alias("v"))
        return (v if at_most is None else v.where(F.col("v") <= at_most)).agg(F.max("v")).first()[0]

    def manifest(self, version: int | None = None) -> dict[str, tuple[str, str | None]]:
        """piece -> (folder, note) of a version (default: the latest; empty before the first)."""
        version = self.latest() if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.schema(_MANIFEST).json(os.path.join(self.path, "versions", f"v={version}")).collect()
        return {r.piece: (r.folder, r.note) for r in rows}

    def commit(self, version: int, pieces: dict[str, tuple[str, str | None]]) -> None:
        """Make ``pieces`` the version; an error if it exists."""
        rows = self.spark.createDataFrame([(p, f, n) for p, (f, n) in sorted(pieces.items())], _MANIFEST)
        rows.coalesce(1).write.mode("error").json(os.path.join(self.path, "versions", f"v={version}"))

    def new_folder(self, name: str = "part") -> str:
        """A place for a new piece, relative to the table."""
        return os.path.join("data", f"{name}-{uuid.uuid4().hex}")

    def at(self, folder: str) -> str:
        return os.path.join(self.path, folder)


class PublishedTable(Versions):
    """A table that is replaced as a whole, once an epoch."""

    def publish(self, rows: DataFrame, epoch: int) -> bool:
        """Write ``rows`` as the table of ``epoch``; False if that epoch, or a later one, is there already."""
        last = self.latest()
        if last is not None and last >= epoch:
            return False
        folder = self.new_folder(f"epoch{epoch}")
        rows.write.parquet(self.at(folder))
        self.commit(epoch, {"all": (folder, rows.schema.json())})
        return True

    def read(self, epoch: int | None = None) -> DataFrame:
        folder, schema = self.manifest(epoch)["all"]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(self.at(folder))


class BucketedTable(Versions):
    """Rows in ``buckets`` buckets by the hash of ``key``.

    The manifest has one row a bucket that holds rows, and one (``""``) with the schema, the key and the number."""

    def _head(self, pieces: dict) -> dict:
        if "" not in pieces:
            raise ValueError(f"no table at {self.path}")
        return json.loads(pieces[""][1])

    @staticmethod
    def bucket_of(key: str | Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, key: str, buckets: int) -> dict[str, tuple[str, str | None]]:
        """Write ``rows`` by bucket; each bucket is a piece.  A hot key is dealt over tasks by the hash of its rows' places."""
        folder = self.new_folder()
        dealt = rows.withColumn(_BUCKET, self.bucket_of(key, buckets))
        sizes = dealt.groupBy(_BUCKET).count()
        parts = sizes.select(_BUCKET, F.ceil(F.col("count") / F.lit(ROWS_A_TASK)).cast("int").alias("_parts")).collect()
        wide = {r[0]: r[1] for r in parts if r[1] > 1}              # at most one row a bucket
        salt = F.lit(0)
        if wide:
            share = F.create_map(*[x for b, n in wide.items() for x in (F.lit(b), F.lit(n))])
            # by the rows' own values: a task that runs again deals them alike
            cells = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
            salt = F.pmod(F.xxhash64(F.lit("salt"), *cells), F.coalesce(F.element_at(share, F.col(_BUCKET)), F.lit(1))).cast("int")
        dealt.withColumn("_salt", salt).repartition(_BUCKET, "_salt").drop("_salt") \
            .write.partitionBy(_BUCKET).parquet(self.at(folder))
        return {str(r[0]): (os.path.join(folder, f"{_BUCKET}={r[0]}"), None) for r in parts}

    def create(self, rows: DataFrame, key: str, buckets: int = 64) -> None:
        head = json.dumps({"key": key, "buckets": buckets, "schema": rows.schema.json()})
        self.commit(0, {"": ("", head), **self._written(rows, key, buckets)})

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        pieces = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(self._head(pieces)["schema"]))
        want = set(pieces) - {""} if buckets is None else {str(b) for b in buckets} & set(pieces)
        if not want:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.at(pieces[b][0]) for b in sorted(want)])

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of a frame with the key column (at most as many as the table has)."""
        head = self._head(self.manifest())
        return sorted(r[0] for r in keys.select(self.bucket_of(head["key"], head["buckets"])).distinct().collect())

    def lookup(self, key_value) -> DataFrame:
        """The rows of one key: one bucket is read."""
        head = self._head(self.manifest())
        one = self.spark.range(1).select(F.lit(key_value).alias(head["key"]))
        return self.read(self.buckets_of(one)).where(F.col(head["key"]).eqNullSafe(F.lit(key_value)))

    def rewrite(self, hit: list[int], change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the rows of the buckets ``hit`` by ``change`` of them, in a new version; other buckets keep their files."""
        version = self.latest()
        pieces = self.manifest(version)
        head = self._head(pieces)
        new = self._written(change(self.read(hit, version)), head["key"], head["buckets"])
        strange = set(new) - {str(b) for b in hit}
        if strange:
            raise ValueError(f"rows of other buckets: {sorted(strange)}")
        kept = {b: p for b, p in pieces.items() if b not in {str(h) for h in hit}}
        self.commit(version + 1, {**kept, **new})
        return version + 1
