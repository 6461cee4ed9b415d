"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir if set, else the checkpoint folder that was set before, else (local mode only) an own one."""
    if conf := spark.conf.get("spark.checkpoint.dir", None):
        return conf.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rolomill-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders that stage() wrote and that are still there.
_left: set[str] = set()


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; lost executors take nothing with them."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    _left.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.discard(path)


def unstage(*staged: DataFrame) -> None:
    """Deletes what stage() wrote. Only for results that nothing will read again: all that is made of them must be staged or collected by then."""
    for df in staged:
        _delete(df.sparkSession, df.staged_at)


def unstage_all(spark: SparkSession) -> None:
    """Deletes all that stage() wrote in this process, once results that were made of it are written or no longer needed."""
    for path in sorted(_left):
        _delete(spark, path)
