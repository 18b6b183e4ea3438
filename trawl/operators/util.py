"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the input's files that go into one partition of a spread table.
SPREAD_BYTES = 16 << 20


def file_bytes(spark: SparkSession, files: list[str]) -> int:
    """The size of files together; only their status is asked for."""
    sc = spark.sparkContext
    conf, jvm = sc._jsc.hadoopConfiguration(), sc._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (parsing, splitting, hashing, scoring) at
    least one partition per core.

    A table of at least ``min_partitions`` files is returned untouched; an
    input of fewer files (one small file, say) is spread round-robin, which
    costs one shuffle of that input, over as many partitions as keep each at
    ``SPREAD_BYTES`` of the files.  The file list is part of the plan; asking
    for it and for the sizes of those few files runs no job and changes no setting.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= want:
        return df
    return df.repartition(max(want, -(-file_bytes(df.sparkSession, files) // SPREAD_BYTES)))
