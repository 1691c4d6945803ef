"""Cutting lineage so that lost executors cost one stage, not the whole job.

Intermediate tables are written as Parquet to the folder in ``spark.checkpoint.dir``, which
driver and executors share.  Only a local session without that setting gets a folder of its own.
A table goes as soon as nothing reads it any more (``dropped``), at the latest when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import delete, shared_dir, written

__all__ = ["dropped", "released", "shared_dir", "written"]


def released(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's collector finds their plans unreachable: runs it."""
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Removes written ``tables`` that nothing reads any more, and the shuffle files of finished jobs with them."""
    for t in tables:
        delete(t.sparkSession, t._scratch)
    if tables:
        released(tables[0].sparkSession)
