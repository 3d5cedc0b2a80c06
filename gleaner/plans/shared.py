"""The folder that driver and executors share, lineage cuts in it, and bounds of Arrow batches."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two releases at least; a release takes a twentieth of the time at most.
RELEASE_SECONDS, RELEASE_SHARE = 5, 20
_due = [0.0]
#: Has Spark delete an action's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and everything runs in one process (tests), a temporary folder."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_gleaner_dir", None)
    if known is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(known)
        sc._gleaner_dir = known
    return known.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing else writes there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints deleted that nothing refers to; Spark learns of them only when the driver collects its garbage."""
    began = time.monotonic()
    if began >= _due[0]:
        spark._jvm.System.gc()
        ended = time.monotonic()
        _due[0] = ended + max(RELEASE_SECONDS, RELEASE_SHARE * (ended - began))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept, without lineage, as reliable checkpoint files; its own shuffle files go at once, those of other steps before may go."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint()  # a plan of its own, nothing else reads its shuffle files
    finally:
        spark.conf.set(CLEANUP, before)
    release(spark)
    return kept


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch to a Python worker holds, for texts of any length; all operators use the same bounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
