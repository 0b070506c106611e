"""Cutting the lineage of tables that loops build on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of checkpoints: that of ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset and the driver is the executor, as in tests, a temporary folder takes its place, which goes
    with the process.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="sparkclade-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: its plan begins anew there, and lost executors cost nothing."""
    folder(df.sparkSession)
    return df.checkpoint()
