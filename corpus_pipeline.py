"""A training corpus from raw documents: five stages, each one operator of sparkclade.llm.

Stages take the table of documents and return its columns, in any order of rows; null and empty texts, repeated rows and
an empty table are as their operators say.  Extra columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade.llm import language, line_dedup, mixing, packing, simhash
from sparkclade.llm.common import forget, scope, stage, stored
from sparkclade.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its score is below this share of the median score of the documents of its predicted language.
LEAST_SHARE = 0.5


@stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some known language, ``lang`` replaced by the prediction.

    Rejected are texts that are null or without a letter, and those whose letters are unlike every language learnt.
    """
    found = language.identify(docs, language.learn(docs), keep=tuple(docs.columns)).where(F.col("lang_pred") != language.NONE)
    found = stored(found, "identified")
    # A row a language.
    usual = found.groupBy("lang_pred").agg((F.percentile_approx("score", 0.5, 1000) * LEAST_SHARE).alias("least"))
    return found.join(F.broadcast(usual), "lang_pred").where("score >= least").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that earlier ones hold; those that keep no line go."""
    found = line_dedup.line_dedup(docs)
    return found.where((F.col("removed_lines") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs).select(*COLUMNS)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each time that it takes them; the last time may be the first words only."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 ids, with their ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("language", languages), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]

#: Language profiles, hashed shingles and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input.

    A stage's own tables go as soon as it is written, and its result with the next one's.  What the last stage reads
    goes with the caller's ``scope``, or when the process ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, apply in STAGES[:-1]:
        with scope(spark) as own:
            found = apply(spark, docs, sf_dir)
            with own.outer():
                docs = stored(found, name)
        if before is not None:
            forget(spark, before)
        before = docs
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
