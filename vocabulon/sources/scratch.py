"""Intermediate tables: written once to the folder that driver and executors share, and read back.

They cut lineage, so a lost executor repeats one stage, and they give several readers one computation.
The folder is ``spark.checkpoint.dir``; only a local session without that setting gets one of its own.
What a step shuffled is removed once its table is written, so steps don't add up on the executors' disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + _own.setdefault("dir", tempfile.mkdtemp(prefix="vocabulon-"))


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: its scratch tables go with the shared folder
        return


def written(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """``df`` written once and read back, with a folder for each value of ``by``; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vocabulon/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(delete, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes written ``tables`` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._scratch)
