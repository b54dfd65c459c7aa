"""Scratch tables in the folder that the driver and the executors share: they end a lineage, so a lost executor costs nothing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables written by this process, newest last, as (session, path).
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset, a folder of this machine if all of Spark runs on it, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/lodestrata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far. Call it once the results that read them have been written."""
    jvm = spark.sparkContext._jvm
    while _written:
        _, path = _written.pop()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    if _written:
        try:
            release(_written[-1][0])
        except Exception:  # noqa: BLE001 - the session may already have ended
            _written.clear()
