"""Where tables that are needed for a while are written: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; where that is unset, a local one if all run on this machine, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docmill-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docmill-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path
    if not where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(where(path), where(to)):
        raise OSError(f"{path} could not be renamed to {to}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders within a folder; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(where) if x.isDirectory()) if system.exists(where) else []
