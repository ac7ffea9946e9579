"""Session-level helpers shared by every operator: reading the given tables and cutting lineage safely."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; columns are pruned and filters pushed by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where none is set and Spark runs
    on this machine alone, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not given and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that the loss of an executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
