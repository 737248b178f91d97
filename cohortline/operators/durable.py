"""Cut a plan at a reliable copy."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written so far, by application.
_WRITTEN: dict[str, list[str]] = {}


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set first if nobody has.

    It is the session's `spark.checkpoint.dir`, which the cluster points at shared storage.
    Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="cohortline-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, for a table written and read again."""
    path = f"{_checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the checkpoint folder and go on from the copy.

    Executors may be lost at any time, the copy stays; later scans read only the columns and rows they need.
    """
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_copies(spark: SparkSession) -> int:
    """Delete the copies this application has made, once no result that reads them is needed any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
