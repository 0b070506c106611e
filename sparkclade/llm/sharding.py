"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group, which no shard border may cut.  Groups by size, the largest first, go each to the shard
that holds least so far, which a heap tells.  A group of more than one part in ``shards`` x ``FINE`` of all bytes is an
item of its own; there can be no more than ``shards`` x ``FINE`` of these.  All smaller groups travel in bundles, by hash
of their text: half of them in ``FINE`` bundles, a quarter in as many of half the size, and so on, so the last items that
the heap deals are of the size of single groups and level the shards.  So the driver schedules a bounded number of items
whatever the table holds, every row finds its shard by a bounded table, and no row is shuffled by its text.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 16
#: Parts of a shard: bounds the groups that are items of their own, and is the number of bundles of a level.
FINE = 1_024
#: Levels of bundles, each of half the size of the one before.
LEVELS = 12


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each of ``items`` (size, name): by size, ties by name, to the least loaded shard, ties to the first."""
    loads = [(0, s) for s in range(shards)]
    found = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = loads[0]
        found[name] = s
        heapq.heapreplace(loads, (load + size, s))
    return found


def bundle_of(key: Column) -> Column:
    """Name of the bundle of a group's ``key`` (hex): its level by leading zero bits, then a place in the level."""
    # 0 has one digit, as 1 has: the last level takes both.
    zeros = F.lit(LEVELS) - F.length(F.bin(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % (1 << LEVELS)))
    place = F.conv(F.substring(key, 9, 8), 16, 10).cast("long") % FINE
    return F.concat_ws(":", zeros, place)


def assigned(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of ``docs``.

    size: UTF-8 bytes of the text and 1; text_crc32: of its bytes, unsigned.  shard: 0 to ``shards`` - 1; slot: the row's
    place in its shard, gapless from 0.  Rows of equal text are in one shard, a null text counting as an empty one.  A
    group of more than its share of all bytes fills a shard alone, as far as the others suffice to level themselves.
    Repeated rows and null ids are rows as any; extra columns are ignored; an empty table gives an empty table.  Of one
    table the shards are the same at each run, and so are the slots as long as its files are read in the same parts.
    ``row_col``, if given, numbers the rows of ``docs`` and comes with the result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"), row.alias("row"), F.spark_partition_id().alias("part"))
    rows = stored(rows, "sizes")

    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * (shards * FINE) > F.lit(total)
    own = groups.where(large).select("size", F.col("key").alias("name"))
    bundles = groups.where(~large).groupBy(bundle_of(F.col("key")).alias("name")).agg(F.sum("size").alias("size")).select("size", "name")
    # At most shards x FINE groups of their own, and LEVELS x FINE bundles.
    found = schedule([(r.size, r.name) for r in own.union(bundles).collect()], shards)
    spark = docs.sparkSession
    table = spark.createDataFrame(list(found.items()), "name string, shard int")
    # A key has 32 digits, so no bundle's name can be one.
    alone = F.broadcast(table.where(F.length("name") == 32).withColumnsRenamed({"name": "key", "shard": "alone"}))
    bundled = F.broadcast(table.where(F.length("name") < 32).withColumnsRenamed({"name": "bundle", "shard": "bundled"}))
    dealt = rows.join(alone, "key", "left").withColumn("bundle", F.when(F.col("alone").isNull(), bundle_of(F.col("key")))).join(bundled, "bundle", "left")
    dealt = stored(dealt.select("doc_id", "size", "text_crc32", F.coalesce("alone", "bundled").alias("shard"), "row", "part"), "dealt")

    # Slots: a part's rows of a shard follow those of earlier parts.  A part is what one task has read.
    ahead = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "part", "ahead")
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    placed = dealt.withColumn("inside", inside).join(stored(ahead, "ahead"), ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("inside")).alias("slot"), *([F.col("row").alias(row_col)] if row_col else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rows_a_file: int = 100_000) -> None:
    """``docs`` written to ``path`` as Parquet, a folder a shard (``shard=0`` on), each file a run of slots in order.

    Columns are those of ``docs`` and slot (which a column of that name gives way to); cases are as in ``assigned``.
    """
    free = next(f"row{i}" for i in range(len(docs.columns) + 1) if f"row{i}" not in docs.columns)
    numbered = stored(docs.withColumn(free, F.monotonically_increasing_id()), "rows")
    places = assigned(numbered, shards, id_col, text_col, free).select(free, F.col("shard").alias("shard"), "slot")
    kept = [c for c in numbered.columns if c not in ("shard", "slot")]
    # The numbers are unique, so this join has no hot key.
    full = numbered.select(*kept).join(places, free).select(*[c for c in kept if c != free], "shard", "slot")
    full.repartitionByRange("shard", F.floor(F.col("slot") / rows_a_file)).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
