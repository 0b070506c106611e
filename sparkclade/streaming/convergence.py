"""Convergence of runs while they sample: split counts kept from batch to batch, and the deviation between runs after each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkclade.operators.splits import compared_counts

SPLITS, RUNS = "run string, split_key long, n long", "run string, trees long, last long"


def merged(batch: DataFrame, counts: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (run, split_key, n) and runs (run, trees, last) with the new trees of ``batch`` (run, gen, split_key).

    A run that starts again from a checkpoint samples generations a second time: what is not later than the last
    generation seen of its run is dropped.
    """
    told = runs.select("run", F.col("last").alias("seen"))
    new = batch.join(told, "run", "left").where(F.col("seen").isNull() | (F.col("gen") > F.col("seen"))).select("run", "gen", "split_key")
    more = new.groupBy("run", "split_key").agg(F.count_distinct("gen").alias("n"))
    both = counts.unionByName(more).groupBy("run", "split_key").agg(F.sum("n").alias("n"))
    begun = new.groupBy("run").agg(F.count_distinct("gen").alias("trees"), F.max("gen").alias("last"))
    return both, runs.unionByName(begun).groupBy("run").agg(F.sum("trees").alias("trees"), F.max("last").alias("last"))


def state(spark: SparkSession, folder: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """Counts and runs after ``batch``; empty before the first."""
    if batch < 0:
        return spark.createDataFrame([], SPLITS), spark.createDataFrame([], RUNS)
    return spark.read.schema(SPLITS).parquet(f"{folder}/splits/{batch}"), spark.read.schema(RUNS).parquet(f"{folder}/runs/{batch}")


def running_convergence(trees: DataFrame, folder: str, n_tax: int, least: float = 0.1) -> StreamingQuery:
    """Starts a query over a stream of (run, gen, split_key) that writes ``compared_runs`` after each batch to ``folder``.

    The state is as large as the different splits of each run, whatever the number of trees, and lies in ``folder``, which
    all executors share, a version a batch: a batch that is run again after a failure begins at the version before it
    and replaces its own, so nothing counts twice.
    """

    def each(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        counts, runs = merged(batch, *state(spark, folder, k - 1))
        counts.write.mode("overwrite").parquet(f"{folder}/splits/{k}")
        runs.write.mode("overwrite").parquet(f"{folder}/runs/{k}")
        counts, runs = state(spark, folder, k)
        compared_counts(counts, runs.select("run", "trees"), n_tax, least).write.mode("overwrite").parquet(f"{folder}/compared/batch={k}")

    return trees.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def compared_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, run_a, run_b, asdoss, max_difference, mean_difference): what each batch ended with."""
    return spark.read.parquet(f"{folder}/compared")
