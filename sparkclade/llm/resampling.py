"""Importance resampling towards a target distribution, on hashed n-grams.

Words are numbered by an integer dictionary as a task meets them, and n-grams are tuples of these numbers: an n-gram is
its first part's number and a word's.  The different tuples of a chunk are found by sorting numbers; the bytes of each
are hashed once, and its bucket goes back to all its occurrences.  A word's own hash is kept with the dictionary.  Two
histograms of buckets, of all documents and of the target, give each bucket its gain, and a document's weight is the mean
gain of its n-grams.  Gumbel noise by document id turns the highest weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored

ORDERS, BUCKETS, SEED = 2, 10_000, 7
#: Of a hundred documents of ``LEAST_WORDS`` words, so many are drawn.
PERCENT, LEAST_WORDS = 25, 20
#: Bytes of text whose tuples are told apart together.
CHUNK_BYTES = 4_000_000
#: Words of a task's dictionary, some 200 bytes each; emptied when full.
MOST_WORDS = 500_000
#: Letters and digits of ASCII in lower case and all bytes beyond it stay, the rest is blank.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Words(dict):
    """Numbers of words as they come; ``hashes``: crc32 of each, ``tails``: a blank and the word."""

    def __init__(self):
        self.hashes, self.tails = [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.hashes)
        self.hashes.append(zlib.crc32(word))
        self.tails.append(b" " + word)
        return found

    def renew(self) -> None:
        if len(self) > MOST_WORDS:
            self.clear()
            self.__init__()


def buckets_of(texts: list[bytes], words: Words, orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and the buckets (uint16) of all its n-grams, repeats included, single words first."""
    words.renew()
    parts = [t.translate(FOLD).split() for t in texts]
    size = np.array([len(p) for p in parts], np.int64)
    word = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum()))
    upto = np.cumsum(size)
    start, left = upto - size, np.repeat(upto, size) - np.arange(len(word))
    # At each place the number of the n-gram that starts there, among the different ones, and these one's hashes.
    number, hashed = word, np.array(words.hashes, np.int64)
    found, bounds = [(hashed[word] % buckets).astype(np.uint16)], [np.append(start, len(word))]
    for n in range(2, orders + 1):
        here = np.flatnonzero(left >= n)
        tuples, which = np.unique(number[here] << 32 | word[here + n - 1], return_inverse=True)
        tails = map(words.tails.__getitem__, (tuples & 0xFFFFFFFF).tolist())
        hashed = np.fromiter(map(zlib.crc32, tails, hashed[tuples >> 32].tolist()), np.int64, len(tuples))
        number = np.zeros(len(word), np.int64)
        number[here] = which
        found.append((hashed[which] % buckets).astype(np.uint16))
        bounds.append(np.searchsorted(here, np.append(start, len(word))))
    return size, [np.concatenate([f[e[k] : e[k + 1]] for f, e in zip(found, bounds)]) for k in range(len(texts))]


def chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of a batch of about ``CHUNK_BYTES`` of text, a longer text alone."""
    at, held, size = 0, [], 0
    for i, value in enumerate(batch.column(text_at)):
        held.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
        size += len(held[-1])
        if size > CHUNK_BYTES or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at), held
            at, held, size = i + 1, [], 0


def features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, row, words, n_features, buckets): for each row of ``docs`` the buckets of its n-grams, 16 bits each."""

    def run(batches):
        words = Words()
        for b in batches:
            for rows, texts in chunks(b, 2):
                size, found = buckets_of(texts, words, orders, buckets)
                cells = [rows.column(0), rows.column(1), pa.array(size), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "row", "words", "n_features", "buckets"])
        pa.default_memory_pool().release_unused()

    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, ["doc_id", "row", "text"], run, "doc_id long, row long, words long, n_features long, buckets binary")


def flat(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column, and where each row's begin and the last one's end."""
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    data = column.buffers()[2]
    return np.frombuffer(data, "<u2", at[-1] - at[0], 2 * at[0]) if at[-1] > at[0] else np.zeros(0, np.uint16), at - at[0]


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """n-grams by bucket: a row a task and bucket is shuffled, and a row a bucket, 65,536 at most, collected."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(flat(b.column(0))[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(found, ["buckets"], run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's share in the target to its share in the documents, smoothed by one."""
    up, down, buckets = float(raw.sum() + len(raw)), float(target.sum() + len(raw)), len(raw)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * up / ((float(raw[b]) + 1) * down))) for b in range(buckets)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, row, words, n_features, weight) of ``features``: the floored mean gain, 0 without n-grams."""

    def run(batches):
        for b in batches:
            values, at = flat(b.column(4))
            upto = np.concatenate(([0], np.cumsum(gain[values])))
            # Integer division of numpy goes down, as floors do.
            weight = (upto[at[1:]] - upto[at[:-1]]) // np.maximum(1, np.diff(at))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight, pa.int64())], ["doc_id", "row", "words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, row long, words long, n_features long, weight long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: 1 on for the highest scores, ties by id, null for the undrawn.

    No task sorts all rows: ranges of the rows that can be drawn, numbered each and offset by the ranges before.  A row
    number is the last key, so that rows of one score and id can be cut apart.
    """
    able = F.col("words") >= least_words
    quota = scored.where(able).count() * percent // 100
    # A row a score: scores are whole numbers, and there are some ten thousands of them.
    at = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    least = at.where(F.col("ahead") < F.lit(quota)).agg(F.min("score")).first()[0]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reach = able & (F.col("score") >= F.lit(least))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    cut = scored.where(reach).repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    cut = stored(cut, "ranges")
    parts = cut.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A row a range.
    ahead = parts.select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.col("at") - F.col("first") + 1
    ranked = cut.join(F.broadcast(ahead), "part").withColumn("rank", F.when(rank <= quota, rank)).select(*scored.columns, "rank")
    return ranked.union(scored.where(~reach).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of ``docs``.

    Of the documents of at least ``least_words`` words, ``percent`` of a hundred are drawn: those of the highest scores,
    ties to smaller ids, rank counting them from 1; the others have none.  score: weight and noise by seed and id, so
    reruns agree; null ids are spelt ``null``, come last among ties, and share their noise.  A null or empty text has no
    n-gram and weight 0.  Repeated rows are drawn as rows of their own.  Without target texts all buckets gain by their
    rarity alone.  Extra columns are ignored; an empty table gives an empty table.  ``row_col``, if given, numbers the
    rows of ``docs`` and comes with the result.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets: 1 to 65,536")
    found = stored(features(docs, orders, buckets, id_col, text_col, row_col), "features")
    aim = features(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")), orders, buckets, "doc_id", "text")
    gain = gains(histogram(found, buckets), histogram(aim, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weighed(found, gain).withColumn("score", F.col("weight") + noise), "weights")
    ranked = drawn(scored, percent, least_words)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank", *([F.col("row").alias(row_col)] if row_col else []))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and rank, which a column of that name gives way to; cases are as in ``importance``."""
    free = next(f"row{i}" for i in range(len(docs.columns) + 1) if f"row{i}" not in docs.columns)
    rows = stored(docs.withColumn(free, F.monotonically_increasing_id()), "rows")
    ranks = importance(rows, target, row_col=free, **options).where("rank is not null").select(free, F.col("rank").alias("rank"))
    kept = [c for c in rows.columns if c != "rank"]
    return rows.select(*kept).join(ranks, free).drop(free)
