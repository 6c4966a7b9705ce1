"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(df: DataFrame, *used: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job: write a table below the shared folder and read it again.

    ``used`` are earlier results of this function that nothing needs any more; their tables are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    drop_steps(*used)
    return out


def drop_steps(*used: DataFrame) -> None:
    """Delete the tables of earlier results of ``cut`` that nothing needs any more."""
    for old in used:
        at = vars(old).get("_step_path")
        if at:
            spark = old.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(at)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
