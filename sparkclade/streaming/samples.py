"""Structured Streaming over files that samplers append: moments and split frequencies of each run as samples come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    """(run, gen, value), as Parquet files of samples arrive."""
    reader = spark.readStream.schema("run string, gen long, value double")
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(path)


def running_summary(samples: DataFrame, last_checkpoint: int | None = None) -> DataFrame:
    """(run, n, mean, variance) so far; samples after the last checkpoint of a restarted run are dropped."""
    kept = samples.where(F.col("gen") <= last_checkpoint) if last_checkpoint is not None else samples
    return kept.groupBy("run").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def running_split_counts(splits: DataFrame) -> DataFrame:
    """(run, split_key, n) so far, of (run, split_key)."""
    return splits.groupBy("run", "split_key").agg(F.count("*").alias("n"))


def hopping_windows(samples: DataFrame, window: int = 200, stride: int = 100) -> DataFrame:
    """(run, window, n, mean) by sample index: windows of ``window`` samples every ``stride``, once they are full."""
    first = F.greatest(F.lit(0), F.ceil((F.col("gen") - window + 1) / stride))
    hops = samples.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("gen") / stride))))
    return hops.groupBy("run", "window").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where(F.col("n") == window)
