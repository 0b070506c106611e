"""The logical tables of comparative sequence analysis, derived from the relational ones.

Every table is a rule over whole input tables, written once as Spark expressions and once as SQL (the ``*_SQL`` texts).

chars(tax, pos, ch): an alignment of the nations by the parts.  tree(tree_id, ...): one tree of nations a supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_TAX = 25
SYMBOLS, AMBIGUITIES = "acgt", {"r": "ag", "y": "ct"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, each: int) -> DataFrame:
    """``rows`` dealt by ``key`` to partitions of about ``each``: a small file's few tasks would make all that its rows
    become.  The number is our own, so partitions are not joined again for holding few bytes; groups of ``key`` stay put."""
    return rows.repartition(max(1, -(-rows.count() // each)), key)


#: Sites, and trees, of a partition; a site becomes 25 characters and a tree some hundreds of rows.
SITES_A_TASK, TREES_A_TASK = 20_000, 1_000


def div(a: str, b: str) -> Column:
    """Integer division of columns or expressions."""
    return F.expr(f"({a}) div ({b})")


CHARS_SQL = """
chars AS (
  SELECT n_nationkey AS tax, p_partkey AS pos,
    CASE WHEN (p_partkey * 7 + n_nationkey * 3) % 29 = 0 THEN '-'
         WHEN (p_partkey * 5 + n_nationkey) % 37 = 0 THEN '?'
         WHEN (p_partkey + n_nationkey * 11) % 53 = 0 THEN 'r'
         WHEN (p_partkey * 3 + n_nationkey) % 59 = 0 THEN 'y'
         ELSE substr('acgt', CAST(1 + (p_size + (n_nationkey // (1 + p_partkey % 6)) * (p_partkey % 3)) % 4 AS INTEGER), 1) END AS ch
  FROM nation, part)"""


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tax int, pos long, ch string): 25 taxa, a site for each part; symbols acgt, gap -, missing ?, ambiguities r and y."""
    taxa = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tax"))
    sites = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_size"), "pos", SITES_A_TASK)
    state = "cast(1 + (p_size + (tax div (1 + pos % 6)) * (pos % 3)) % 4 as int)"
    ch = F.expr(f"""CASE WHEN (pos * 7 + tax * 3) % 29 = 0 THEN '-' WHEN (pos * 5 + tax) % 37 = 0 THEN '?'
        WHEN (pos + tax * 11) % 53 = 0 THEN 'r' WHEN (pos * 3 + tax) % 59 = 0 THEN 'y' ELSE substr('acgt', {state}, 1) END""")
    # 25 taxa whatever the scale: the small side is the whole of a fixed dimension.
    return sites.crossJoin(F.broadcast(taxa)).select("tax", "pos", ch.alias("ch"))


#: Whole alignment without gaps and ambiguities, for tests that refuse them.
PLAIN_SQL = CHARS_SQL + """,
plain AS (
  SELECT n_nationkey AS tax, p_partkey AS pos,
    substr('acgt', CAST(1 + (p_size + (n_nationkey // (1 + p_partkey % 6)) * (p_partkey % 3)) % 4 AS INTEGER), 1) AS ch
  FROM nation, part)"""


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxa = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tax"))
    sites = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_size"), "pos", SITES_A_TASK)
    ch = F.expr("substr('acgt', cast(1 + (p_size + (tax div (1 + pos % 6)) * (pos % 3)) % 4 as int), 1)")
    return sites.crossJoin(F.broadcast(taxa)).select("tax", "pos", ch.alias("ch"))


#: One tree a supplier: nation r = s_nationkey and the one 7 further on change places, then halves, quarters and
#: eighths of the row of places are clades.  Keys have a bit a taxon; the canonical key has bit 0 clear.
SPLITS_SQL = """
leafs AS (
  SELECT s_suppkey AS tree_id, n_nationkey AS tax,
    CASE WHEN n_nationkey = s_nationkey THEN (s_nationkey + 7) % 25 WHEN n_nationkey = (s_nationkey + 7) % 25 THEN s_nationkey ELSE n_nationkey END AS place
  FROM supplier, nation),
raw AS (
  SELECT tree_id, bit_or(CAST(1 AS BIGINT) << tax) AS raw_key, count(*) AS n_leaves, size, place // size AS bucket
  FROM leafs, (SELECT unnest([1, 2, 4, 8]) AS size) GROUP BY tree_id, size, place // size),
splits AS (
  SELECT tree_id, CASE WHEN raw_key % 2 = 1 THEN xor(raw_key, 33554431) ELSE raw_key END AS split_key,
    min((1 + (bucket + tree_id) % 5) * 0.1::DOUBLE) AS br_len
  FROM raw WHERE n_leaves < 24 GROUP BY 1, 2)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id long, split_key long, br_len double): every branch of a tree a supplier, leaves included."""
    taxa = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tax"))
    trees = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tree_id"), F.col("s_nationkey").alias("r")), "tree_id", TREES_A_TASK)
    leaf = trees.crossJoin(F.broadcast(taxa)).withColumn("place", F.expr("CASE WHEN tax = r THEN (r + 7) % 25 WHEN tax = (r + 7) % 25 THEN r ELSE tax END"))
    sized = leaf.withColumn("size", F.explode(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]))).withColumn("bucket", F.expr("place div size"))
    raw = sized.groupBy("tree_id", "size", "bucket").agg(F.bit_or(F.expr("shiftleft(1L, tax)")).alias("raw_key"), F.count("*").alias("n_leaves"))
    key = F.when(F.col("raw_key") % 2 == 1, F.col("raw_key").bitwiseXOR(F.lit(33554431))).otherwise(F.col("raw_key"))
    return raw.where("n_leaves < 24").groupBy("tree_id", key.alias("split_key")).agg(F.min((1 + (F.col("bucket") + F.col("tree_id")) % 5) * F.lit(0.1)).alias("br_len"))


SAMPLES_SQL = """
samples AS (SELECT event_type AS run, event_id AS gen, value FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run string, gen long, value double): every event as a sample of a run."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("gen"), "value")


def taxa(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the 25 taxa, in order."""
    return [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]


def trees(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(tree_id long, newick string) of the splits, leaves by name; of the trees ``only`` (tree_id), if given."""
    import pandas as pd

    from sparkclade.operators.splits import newick_of_splits

    names = taxa(spark, sf_dir)

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lengths = dict(zip(g["split_key"].tolist(), g["br_len"].tolist()))
        return pd.DataFrame([(key[0], newick_of_splits([(k, None) for k in lengths], names, lengths))], columns=["tree_id", "newick"])

    told = splits(spark, sf_dir)
    told = told if only is None else told.join(only, "tree_id", "left_semi")
    return told.groupBy("tree_id").applyInPandas(build, "tree_id long, newick string")
