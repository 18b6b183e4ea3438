"""trawl: web-content and retrieval operators on Spark DataFrames.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar functions) and runs its core work on Spark.
"""

from trawl.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
