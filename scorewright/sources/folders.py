"""Folders for intermediate tables, shared by all machines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset: on one machine (tests) a temporary folder, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="scorewright-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed now and read from the folder of spark.checkpoint.dir from here on; survives lost executors."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(work_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def restarted(df: DataFrame) -> DataFrame:
    """checkpointed(df) without Spark's estimate of its size, for loops in which each table comes from the one before.

    The size of a join is taken for the product of its sides', and a checkpointed table keeps it: round after round its digits double, and soon
    the driver needs many seconds to multiply them for each plan.
    """
    done = checkpointed(df)
    return DataFrame(done.sparkSession._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), done.sparkSession)
