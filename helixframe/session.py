"""Small helpers around the SparkSession that every module may use."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one test table (a parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; set one of our own only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors
    share; without it an error is raised.  Only a session whose executors are
    threads of this machine (``local[...]``: tests, a laptop) gets a temporary one.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"helixframe-checkpoint-{os.getuid()}")
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder beside the checkpoints, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, and every reader sees the same rows."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, bytes_a_core: int = 4 << 20) -> DataFrame:
    """Enough partitions for a Python kernel where the input is small: one small file would keep one core busy.

    Only inputs of less than ``bytes_a_core`` for each core are redistributed (a few MB at most for each);
    larger ones are split at the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < bytes_a_core * cores else df
