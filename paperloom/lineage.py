"""Results kept in the cluster's shared folder, so that no plan computes them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; on a local master without one, a temporary folder is set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def working_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store it lies."""
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that working_folder named, in whatever store it lies."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
