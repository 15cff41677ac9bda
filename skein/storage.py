"""Reading tables, and cutting lineage in the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The setting that says to how many tasks tables of texts are dealt before they are worked on; unset, they are read as they lie.
DEAL = "spark.skein.deal"


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. Small files of one row group would be one task's work: a session on one machine may ask that they be dealt out."""
    tasks = spark.conf.get(DEAL, None)
    df = table(spark, sf_dir, name)
    return df.repartition(int(tasks)) if tasks else df


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where none is set and the master is local, as in tests."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not there and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set, and executors elsewhere don't see a folder of the driver")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return there or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
