"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

UNSET_ROOT = "file:/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the cluster's spark.checkpoint.dir. Only where that is unset and Spark runs on this machine alone (tests), a
    folder under /tmp is taken. Each application has a folder of its own in it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(root or UNSET_ROOT).rstrip('/')}/tablewarden/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage (a lost executor costs no recomputation of what lies before) and lets Spark size the
    table from its files, so later joins broadcast it only below autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one scratch path, or all of this application, once no result that reads them is needed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path or scratch_root(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
