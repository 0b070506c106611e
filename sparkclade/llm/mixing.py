"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of shuffled documents, passed through once an epoch.  A document's virtual finish time is the
source's words up to its end, divided by the source's target.  Sorting all documents of all sources by that time and
cutting at the total budget gives every source its target.  The sort is global: equal ranges of virtual time, which the
words fill evenly, are sorted on their own and follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, unused

WEIGHTS = (3, 1, 2)
BLANK = r"[\x20\x09-\x0D]*"
BUDGET_SHARE = 1.5
MOST_EPOCHS = 2
#: Documents sorted together; so many in the mean share a range of shuffle keys or of virtual time.
ROWS_A_RANGE = 4_000


def numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with ``place``: their number by code point of ``source``, null last.  No task sorts them all."""
    last = F.col("source").isNull()
    cut = groups.repartitionByRange(last, "source").sortWithinPartitions(last, "source").withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    cut = stored(cut, "sources")
    # A row a partition: what lies before each of them.
    parts = cut.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    ahead = parts.select("part", "first", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return cut.join(F.broadcast(ahead), "part").withColumn("place", F.col("ahead") + F.col("at") - F.col("first")).drop("at", "part", "first", "ahead")


def targeted(groups: DataFrame, weights: tuple[float, ...], share: float, most: float = MOST_EPOCHS) -> DataFrame:
    """``groups`` (source, source_size, n) with place, and target: words by weight, none above ``most`` times the size.

    The excess of those that stop there is reshared.  Each round finds who stops at the present level; none that has
    stopped ever starts again, so the level only rises until it fits.  The table of sources is never collected.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = stored(numbered(groups).withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "weighed")
    budget, level, stopped = None, 0.0, -1
    while True:
        stops = F.col("cap") / F.col("w") <= F.lit(level)
        r = rows.agg(F.sum("source_size").alias("size"), F.count_if(stops).alias("stopped"), F.sum(F.when(stops, F.col("cap"))).alias("spent"), F.sum(F.when(~stops, F.col("w"))).alias("w")).first()
        budget = share * float(r["size"] or 0)
        if r.stopped == stopped or not r.w:
            break
        stopped, level = r.stopped, (budget - (r.spent or 0.0)) / r.w
    stops = F.col("cap") / F.col("w") <= F.lit(level)
    return stored(rows.withColumn("target", F.when(stops | F.lit(not r.w), F.col("cap")).otherwise(F.col("w") * F.lit(level))).drop("w", "cap"), "targets")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken), a row for each row of ``docs``.

    size: words of the text, 0 for null.  target: what the source's share of ``share`` times all words comes to.  taken:
    the words the mix takes, repeats counted: whole documents, but for the one at which a source reaches its target.
    Sources, by code point and null last, take the weights in turn; there may be any number.  Ties of the shuffle key
    fall back on id and size; rows alike in all of these are exchangeable, so reruns agree.  Documents without words
    take no part and get 0.  Extra columns are ignored; an empty table gives an empty table.  ``row_col``, if given,
    numbers the rows of ``docs`` and comes with the result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    rows = stored(rows, "sizes")
    table = targeted(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share)
    totals = table.agg(F.sum("n").alias("n"), F.sum(F.floor("target")).alias("budget")).first()
    ranges, budget = max(1, (totals.n or 0) // ROWS_A_RANGE), int(totals.budget or 0)
    table = table.select(F.col("source").alias("__s"), "place", "source_size", "target", F.floor("target").alias("whole"), F.greatest(F.lit(1), F.floor(F.col("n") / ROWS_A_RANGE)).cast("int").alias("slots"))

    # The table of sources has a known size: Spark broadcasts it while it is small, and else joins by source.
    sized = rows.join(table, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    shuffled = sized.where("size > 0").withColumn("key", key).withColumn("slot", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("slots")).cast("int"))
    ahead = shuffled.groupBy("place", "slot").agg(F.sum("size").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("place", "slot", "ahead")
    inside = F.sum("size").over(Window.partitionBy("place", "slot").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    queued = shuffled.withColumn("inside", F.coalesce(inside, F.lit(0))).join(ahead, ["place", "slot"]).withColumn("begin", F.col("ahead") + F.col("inside"))

    epochs = queued.withColumn("begin", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1), lambda e: F.col("begin") + e * F.col("source_size"))))
    # The document at which a source reaches its target is queued as two: the words before, and those after it.
    cut = F.col("whole") - F.col("begin")
    parts = F.when((cut > 0) & (cut < F.col("size")), F.array(F.struct(F.col("begin").alias("begin"), cut.alias("words")), F.struct(F.col("whole").alias("begin"), (F.col("size") - cut).alias("words")))).otherwise(F.array(F.struct(F.col("begin").alias("begin"), F.col("size").alias("words"))))
    # What finishes after 1 lies beyond its source's target, and so beyond the budget: it is not sorted.
    timed = epochs.select("row", "place", "target", F.explode(parts).alias("p")).select("row", "place", "p.words", ((F.col("p.begin") + F.col("p.words")) / F.col("target")).alias("finish")).where("finish <= 1")
    timed = stored(timed.withColumn("range", F.floor(F.col("finish") * ranges).cast("int")), "finish")
    earlier = timed.groupBy("range").agg(F.sum("words").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range", "earlier")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("range").orderBy("finish", "place", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = timed.withColumn("before", before).join(earlier, "range").select("row", F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("before") - F.col("earlier"))).alias("words"))
    taken = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    return sized.join(taken, "row", "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *([F.col("row").alias(row_col)] if row_col else []))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"{BLANK}{WORD}"), F.lit(0)), F.lit(1), n), "")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = BUDGET_SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` once for each time that ``mix`` takes it whole, and once more cut to its
    first words if it takes a part.  Columns are those of ``docs``, rows without words are not taken, and nulls, ties,
    repeats and empty tables are as in ``mix``."""
    row, size, took, nth = unused(docs.columns, "row", "size", "taken", "nth")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    found = mix(rows, weights, share, id_col, text_col, source_col, row).where("taken > 0").select(F.col(row), F.col("size").alias(size), F.col("taken").alias(took))
    times = F.ceil(F.col(took) / F.col(size)).cast("int")
    often = rows.join(found.hint("merge"), row).withColumn(nth, F.explode(F.sequence(F.lit(1), times)))
    text = F.col(text_col).cast("string")
    cut = F.when(F.col(nth) * F.col(size) > F.col(took), first_words(text, (F.col(took) % F.col(size)).cast("int"))).otherwise(text)
    return often.withColumn(text_col, cut).select(*docs.columns)
