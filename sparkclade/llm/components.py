"""Connected components over an edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours the smallest node it knows."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node tells its smaller neighbours, and itself, the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    told = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return told.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    Large-star and small-star steps alternate until no edge changes, which takes about the logarithm of the longest
    chain.  Every round is written to the shared folder, so lineage stays short.  Self-loops and repeats are allowed;
    an edge with a null end is no edge; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    sign = None
    while True:
        after = stored(_small_star(_large_star(now)), "edges")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(spark, now)
        now = after
        if tuple(got) == sign or not got[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
        sign = tuple(got)
