"""Tree files of any size, NEXUS or Newick, read in parts by many tasks, with an index for access by number.

A command ends at a semicolon outside comments and quotes, and may take any number of lines.  Spark's reader cuts files
at all semicolons, so a part of a file begins after one, but it may be one inside a comment or a quote.  The first pass
finds for every part how it ends, for each thing that it may begin in.  Put together, that tells what every part begins
in, and how many trees and bytes lie before it.  In the second pass parts hand on their commands; only those that lie in
two parts or more are put together by a shuffle.

The index has a row for each run of trees: where it begins and how long it is.  The data source ``trees`` reads those
runs alone that hold numbers a filter asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .nexus_tokens import tokens, unquote

MARKS = re.compile(rb"[\[\]']")
#: Characters of a command, comments left out, that tell its kind.
HEAD = 16
TREE = re.compile(rb"\(|u?tree[\s*']")
#: Trees in a row of the index, and so the least that is read for any of them.
TREES_A_RUN = 1_000
#: Depth of comments, whether in a quote, and how the command began.
OUTSIDE = (0, False, b"")
MID = b"\0"
SCHEMA = "file string, number long, name string, weight double, rooted boolean, newick string"


class Scanner:
    """Where a reader stands after some pieces of a file: in how many comments, in a quote, and how the command began."""

    def __init__(self, depth: int = 0, quoted: bool = False, head: bytes = b""):
        self.depth, self.quoted, self.head = depth, quoted, head

    @property
    def outside(self) -> bool:
        return not self.depth and not self.quoted

    def begun(self, text: bytes) -> None:
        if len(self.head) < HEAD:
            blank = b" " if self.head and text[:1].isspace() else b""
            self.head = (self.head + blank + re.sub(rb"\s+", b" ", text.lstrip()[: 4 * HEAD]))[:HEAD].lower()

    def piece(self, text: bytes) -> None:
        """Reads the text between two semicolons."""
        if self.outside and b"[" not in text and b"'" not in text:
            return self.begun(text)
        at = 0
        for m in MARKS.finditer(text):
            if self.quoted:
                self.quoted = m[0] != b"'"
                if not self.quoted:
                    self.begun(text[at : m.end()])
                    at = m.end()
            elif self.depth:
                self.depth += 1 if m[0] == b"[" else -1 if m[0] == b"]" else 0
                at = m.end()
            elif m[0] == b"[":
                self.begun(text[at : m.start()])
                self.depth, at = 1, m.end()
            elif m[0] == b"'":
                self.begun(text[at : m.start()])
                self.quoted, at = True, m.start()
        if not self.depth:
            self.begun(text[at:])

    def semicolon(self) -> str | None:
        """Reads a semicolon; the kind of the command that it ends, if it ends one."""
        if not self.outside:
            self.begun(b";" if self.quoted else b"")
            return None
        found = kind(self.head)
        self.head = b""
        return found


def kind(head: bytes) -> str:
    """tree, translate, begin, end or other, of a command's first characters."""
    head = re.sub(rb"^#nexus\s*", b"", head)
    if TREE.match(head):
        return "tree"
    return next((k for k in ("translate", "begin", "end") if head.startswith(k.encode())), "other")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between semicolons, in order within a block, which is a part of a file that one task reads."""
    read = spark.read.option("lineSep", ";").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes | None, bool]]:
    """((file, block), value, first of its block) of the rows; a block's pieces follow each other."""
    before = None
    for b in batches:
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            yield (file, block), value, (file, block) != before
            before = file, block


def scanned(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(file, block, bytes, low, net, ends) of each block: how it ends, whatever it begins in.

    ``ends``, for a beginning outside, in a quote, and in 1 to ``most`` comments: depth, quoted and head at the end, the
    head of the first command that ends (null if none does) and how many trees end after that.  ``low``, ``net``: by how
    much comments are closed at most and in the end, for a beginning in more of them than the block ever closes.
    """
    begins = [(0, False), (0, True), *((d, False) for d in range(1, most + 1))]

    def run(batches):
        found = []
        for where, value, first in blocks_in(batches):
            if first:
                # A mark holds the place of the head before, so that blanks after it count.
                scanners = [Scanner(d, q, MID if d or q else b"") for d, q in begins]
                now = {"file": where[0], "block": where[1], "bytes": 0, "low": 0, "net": 0, "ends": [{"first": None, "trees": 0} for _ in begins]}
                found.append((now, scanners))
            now["bytes"] += len(value) + 1
            for m in MARKS.finditer(value):
                now["net"] += (m[0] == b"[") - (m[0] == b"]")
                now["low"] = min(now["low"], now["net"])
            for s, end in zip(scanners, now["ends"]):
                s.piece(value)
                head = s.head
                if ended := s.semicolon():
                    if end["first"] is None:
                        end["first"] = head
                    else:
                        end["trees"] += ended == "tree"
        for now, scanners in found:
            for s, end in zip(scanners, now["ends"]):
                end |= {"depth": s.depth, "quoted": s.quoted, "head": s.head}
        yield pa.RecordBatch.from_pylist([now for now, _ in found], schema=schema)

    whole = pa.int64()
    end = pa.struct([("depth", whole), ("quoted", pa.bool_()), ("head", pa.binary()), ("first", pa.binary()), ("trees", whole)])
    schema = pa.schema([("file", pa.string()), ("block", whole), ("bytes", whole), ("low", whole), ("net", whole), ("ends", pa.list_(end))])
    return pieces(spark, path).mapInArrow(run, "file string, block long, bytes long, low long, net long, ends array<struct<depth: long, quoted: boolean, head: binary, first: binary, trees: long>>")


def beginnings(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[tuple[int, bool, bytes], int, int]]:
    """What each block begins in, how many trees end before it in its file, and its first byte.

    A row a block, of some tens of MB, comes to the driver, which follows each file from block to block.  Only if a block
    closes more nested comments than were tried, it is all scanned again, with twice as many.
    """
    most = 2
    while True:
        rows = sorted(scanned(spark, path, most).collect(), key=lambda r: (r.file, r.block))
        found, deeper, file = {}, False, None
        for r in rows:
            if r.file != file:
                file, state, trees, at = r.file, OUTSIDE, 0, 0
            found[r.file, r.block] = (state, trees, at)
            at += r.bytes
            depth, quoted, head = state
            if depth > most:
                deeper |= depth + r.low <= 0
                state = depth + r.net, False, head
                continue
            end = r.ends[depth + 1 if depth else int(quoted)]
            whole = lambda x: (head + bytes(x).removeprefix(MID)).lstrip()[:HEAD]  # noqa: B023, E731
            if end.first is not None:
                trees += end.trees + (kind(whole(end.first)) == "tree")
                state = end.depth, end.quoted, bytes(end.head)
            else:
                state = end.depth, end.quoted, whole(end.head)
        if not deeper:
            return found
        most *= 2


def commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, kind, offset, text): all commands; number: of a tree, from 0, of another one that of the next tree.

    ``text`` is the command with its comments, without the semicolon, and ``offset`` its first byte.  The last command may
    lack its semicolon; blanks after the last one are none.
    """
    known = beginnings(spark, path)

    def run(batches):
        def rows():
            now, parts, head, at, number, offset = None, [], None, 0, 0, 0
            for where, value, first in blocks_in(batches):
                if first:
                    if parts:
                        yield {**head, "part": block, "text": b";".join(parts), "kind": None}
                    (state, number, at), block, parts = known[where], where[1], []
                    now, offset, inside = Scanner(*state), at, state != OUTSIDE
                    head = {"file": where[0], "number": number, "offset": -1 if inside else at}
                now.piece(value)
                parts.append(value)
                at += len(value) + 1
                if found := now.semicolon():
                    yield {**head, "part": block, "text": b";".join(parts), "kind": found}
                    number += found == "tree"
                    parts, head = [], {"file": where[0], "number": number, "offset": at}
            if parts:
                yield {**head, "part": block, "text": b";".join(parts), "kind": None}

        held, size = [], 0
        for r in rows():
            held.append(r)
            size += len(r["text"])
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    schema = pa.schema({"file": pa.string(), "number": pa.int64(), "kind": pa.string(), "offset": pa.int64(), "part": pa.int64(), "text": pa.binary()})
    found = pieces(spark, path).mapInArrow(run, "file string, number long, kind string, offset long, part long, text binary")
    whole = F.col("kind").isNotNull() & (F.col("offset") >= 0)
    # Pieces of one command: the number of trees before it and, as commands between two trees share that, its order.
    torn = found.where(~whole)
    # A few rows a block: what it began in the middle of, and what it left open.
    ends = Window.partitionBy("file").orderBy("part", F.col("offset") >= 0)
    opened = torn.withColumn("command", F.sum(F.when(F.col("offset") >= 0, 1).otherwise(0)).over(ends))
    pieces_of = F.array_sort(F.collect_list(F.struct("part", F.col("text").alias("x"))))
    joined = opened.groupBy("file", "command").agg(F.min("number").alias("number"), F.max("kind").alias("kind"), F.max("offset").alias("offset"), pieces_of.alias("x")).where("kind is not null")
    # A block ends at a semicolon, which is part of the command here.
    text = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.get("x", F.lit(0))["x"], lambda s, p: F.concat(s, F.expr("X'3B'"), p["x"]))
    every = found.where(whole).select("file", "number", "kind", "offset", "text").union(joined.select("file", "number", "kind", "offset", text.alias("text")))
    return every.where((F.col("kind") != "other") | F.col("text").cast("string").rlike(r"\S"))




#: Blanks and comments, one in another at most.
BLANKS = r"(?:\s|\[(?:[^\[\]]|\[[^\]]*\])*\])*"
BEFORE = re.compile(BLANKS)
NAMED = re.compile(rf"(?is)u?tree(?=[\s*'\[]){BLANKS}\*?{BLANKS}('(?:[^']|'')*'|[^\s=\[]+){BLANKS}=(.*)")


def parsed(text: str, number: int) -> tuple[str, float, bool | None, str]:
    """(name, weight, rooted, newick) of a tree command; a bare Newick tree is named by its number."""
    text = re.sub(r"(?i)^\s*#nexus", "", text)
    m = NAMED.match(text, BEFORE.match(text).end())
    body = m[2] if m else text
    at = BEFORE.match(body).end()
    notes = body[:at].lower()
    weight = re.search(r"\[&w\s+([\d.eE+-]+)(?:\s*/\s*([\d.]+))?\s*\]", notes)
    rooted = True if "[&r]" in notes else False if "[&u]" in notes else None
    return unquote(m[1]) if m else f"t{number}", float(weight[1]) / float(weight[2] or 1) if weight else 1.0, rooted, " ".join(body[at:].split()) + ";"


def translation(text: str) -> dict[str, str]:
    words = [unquote(t) for t in tokens(re.sub(r"(?is)^.*?translate", "", text, count=1)) if t != ","]
    return dict(zip(words[::2], words[1::2]))


def renamed(newick: str, names: dict[str, str]) -> str:
    """``newick`` with the leaves of ``names`` called so, comments kept."""
    from .newick import parse_newick, write_newick

    return write_newick(parse_newick(newick, names)) if names else newick


def table_for(tables: list[tuple[int, dict[str, str]]], number: int) -> dict[str, str]:
    """Of a file's translations, by the number of trees before each, the last one before tree ``number``."""
    return next((t for n, t in reversed(tables) if n <= number), {})


def translate_commands(found: DataFrame) -> list[tuple[str, int, str]]:
    """(file, number of the next tree, text), in order: a row a block of trees, which a file has one of as a rule."""
    rows = found.where("kind = 'translate'").select("file", "number", "offset", "text").orderBy("file", "offset").collect()
    return [(r.file, r.number, bytes(r.text).decode()) for r in rows]


def read_trees(spark: SparkSession, path: str, skip: int = 0, most: int | None = None) -> DataFrame:
    """(file, number, name, weight, rooted, newick): the trees of all files at ``path``, numbered from 0 in each.

    ``skip``: trees passed over at each file's beginning; ``most``: trees at most of each file.  Weights ``[&W 1/3]`` are
    1 where there is none; leaves are called by the translation before the tree.
    """
    found = commands(spark, path)
    tables: dict[str, list[tuple[int, dict[str, str]]]] = {}
    for file, number, text in translate_commands(found):
        tables.setdefault(file, []).append((number, translation(text)))
    some = found.where((F.col("kind") == "tree") & (F.col("number") >= skip))
    if most is not None:
        some = some.where(F.col("number") < skip + most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, number, text in zip(f["file"], f["number"].tolist(), f["text"]):
                name, weight, rooted, newick = parsed(bytes(text).decode(), number)
                rows.append((file, number, name, weight, rooted, renamed(newick, table_for(tables.get(file, []), number))))
            yield pd.DataFrame(rows, columns=["file", "number", "name", "weight", "rooted", "newick"])

    return some.select("file", "number", "text").mapInPandas(run, SCHEMA)


def write_index(spark: SparkSession, path: str, index: str, trees_a_run: int = TREES_A_RUN) -> None:
    """Parquet at ``index``: a row (file, first, last, offset, length, translate) for each run of trees in a file at ``path``.

    A run of trees is read as its bytes alone; ``translate`` is the translation command that holds for it, if any.
    """
    found = commands(spark, path)
    run = F.floor(F.col("number") / trees_a_run)
    ends = found.where("kind = 'tree'").select("file", "number", "offset", (F.col("offset") + F.octet_length("text") + 1).alias("upto"))
    runs = ends.groupBy("file", run.alias("run")).agg(F.min("number").alias("first"), F.max("number").alias("last"), F.min("offset").alias("offset"), (F.max("upto") - F.min("offset")).alias("length"))
    known = spark.createDataFrame(translate_commands(found), "tfile string, tfrom long, translate string")
    # The translation of a run is the last before its first tree; a row a block of trees.
    fit = runs.join(F.broadcast(known), (F.col("file") == F.col("tfile")) & (F.col("tfrom") <= F.col("first")), "left")
    best = fit.groupBy("file", "first", "last", "offset", "length").agg(F.max_by("translate", "tfrom").alias("translate"))
    best.repartitionByRange("file", "first").sortWithinPartitions("file", "first").write.parquet(index)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Run(InputPartition):
    def __init__(self, file: str, first: int, offset: int, length: int, translate: str | None):
        self.file, self.first, self.offset, self.length, self.translate = file, first, offset, length, translate


class TreeReader(DataSourceReader):
    """Reads the runs of an index that hold wanted numbers; comparisons of ``number`` and of ``file`` never leave the source."""

    def __init__(self, index: str):
        self.index, self.low, self.high, self.some, self.files = index, 0, None, None, None

    def pushFilters(self, filters):
        for f in filters:
            column, value = f.attribute if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if column == ("number",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if column == ("number",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                top = value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            if column == ("number",) and isinstance(f, In):
                self.some = set(value) if self.some is None else self.some & set(value)
            if column == ("file",) and isinstance(f, EqualTo):
                self.files = {value}
            # Spark looks at the rows again, for a run may hold others.
            yield f

    def wanted(self, number: int) -> bool:
        return number >= self.low and (self.high is None or number <= self.high) and (self.some is None or number in self.some)

    def partitions(self):
        system, path = opened(self.index)
        test = ds.field("last") >= self.low
        if self.high is not None:
            test &= ds.field("first") <= self.high
        if self.files is not None:
            test &= ds.field("file").isin(list(self.files))
        rows = ds.dataset(path, filesystem=system, format="parquet").to_table(filter=test).to_pylist()
        if self.some is not None:
            rows = [r for r in rows if any(r["first"] <= n <= r["last"] for n in self.some)]
        return [Run(r["file"], r["first"], r["offset"], r["length"], r["translate"]) for r in rows]

    def read(self, partition):
        if partition is None:
            return
        system, path = opened(partition.file)
        with system.open_input_file(path) as f:
            text = f.read_at(partition.length, partition.offset)
        names = translation(partition.translate) if partition.translate else {}
        scanner, number, parts = Scanner(), partition.first, []
        # The last command of a file may lack its semicolon.
        for piece in text.removesuffix(b";").split(b";"):
            scanner.piece(piece)
            parts.append(piece)
            found = scanner.semicolon()
            if found == "tree":
                if self.wanted(number):
                    name, weight, rooted, newick = parsed(b";".join(parts).decode(), number)
                    yield partition.file, number, name, weight, rooted, renamed(newick, names)
                number += 1
            elif found == "translate":
                names = translation(b";".join(parts).decode())
            if found:
                parts = []


class TreeSource(DataSource):
    """``spark.read.format("trees").load(index)``: trees by number, read through the index at ``index``.

    Spark hands filters on only if ``spark.sql.python.filterPushdown.enabled`` is set; without it all runs are read.
    """

    @classmethod
    def name(cls):
        return "trees"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format ``trees`` known to ``spark``, filters included."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
