"""Small results that later steps must all see alike are written to the shared folder and read from there."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query that ends removes its shuffles.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without the setting, as in tests, gets a folder of its
    own beside its warehouse; a cluster session gets an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: lost executors cost no more than that read.

    With ``drop_shuffles`` Spark removes the shuffles behind it as soon as it is
    written, not when the driver happens to collect what refers to them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own: that of df may run again
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
