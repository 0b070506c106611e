"""Writers: alignments, trees, sets and distances as lines of text, for ``df.write.text``; order is in the column ``k``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAIN = r"^[^\s()\[\]{}/\\,;:=*'\"`+<>-]+$"


def quoted(name: Column) -> Column:
    return F.when(name.rlike(PLAIN), name).otherwise(F.concat(F.lit("'"), F.regexp_replace(name, "'", "''"), F.lit("'")))


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fasta(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(k, value) of (tax_id, name, seq)."""
    return sequences.select(F.col("tax_id").alias("k"), F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


def phylip(sequences: DataFrame, interleave: bool = False, width: int = 60, strict: bool = False) -> DataFrame:
    name = F.rpad("name", 10, " ") if strict else F.concat("name", F.lit(" "))
    head = sequences.agg(F.lit(-1).cast("long").alias("k"), F.concat_ws(" ", F.count("*").cast("string"), F.max(F.length("seq")).cast("string")).alias("value"))
    if not interleave:
        return head.unionByName(sequences.select(F.col("tax_id").cast("long").alias("k"), F.concat(name, F.col("seq")).alias("value")))
    chunk = F.posexplode(F.split(wrapped(F.col("seq"), width), "\n")).alias("block", "chunk")
    rows = sequences.select("tax_id", name.alias("name"), chunk)
    line = F.when(F.col("block") == 0, F.concat("name", "chunk")).otherwise(F.col("chunk"))
    return head.unionByName(rows.select((F.col("block").cast("long") * 2_000_000_000 + F.col("tax_id")).alias("k"), line.alias("value")))


def nexus(sequences: DataFrame, data_type: str = "dna", symbols: str | None = None, data_block: bool = True) -> DataFrame:
    size = sequences.agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("m"))
    extra = f' symbols="{symbols}"' if symbols else ""
    kind = "data" if data_block else "characters"
    dims = F.format_string(f"#NEXUS\nbegin {kind};\n  dimensions ntax=%d nchar=%d;\n  format datatype={data_type} gap=- missing=?{extra};\n  matrix", "n", F.col("m").cast("long"))
    head = size.select(F.lit(-1).cast("long").alias("k"), dims.alias("value"))
    rows = sequences.select(F.col("tax_id").cast("long").alias("k"), F.concat(F.lit("    "), quoted(F.col("name")), F.lit(" "), F.col("seq")).alias("value"))
    end = size.select(F.lit(2**62).alias("k"), F.lit("  ;\nend;").alias("value"))
    return head.unionByName(rows).unionByName(end)


def nexus_parts(sequences: DataFrame, types: dict[str, str]) -> DataFrame:
    """(k, value) of (part, tax_id, name, seq): one file of a characters block for each part of ``types``, in its order."""
    out = None
    for place, (part, kind) in enumerate(types.items()):
        lines = nexus(sequences.where(F.col("part") == part), kind, data_block=False)
        lines = lines if place == 0 else lines.withColumn("value", F.regexp_replace("value", "^#NEXUS\n", ""))
        # Blocks follow each other; within one, lines keep their order.
        lines = lines.select((F.lit(place * (1 << 40)) + F.least(F.col("k"), F.lit((1 << 39)))).alias("k"), "value")
        out = lines if out is None else out.unionByName(lines)
    return out


def molphy(sequences: DataFrame) -> DataFrame:
    head = sequences.agg(F.lit(-1).cast("long").alias("k"), F.concat_ws(" ", F.count("*").cast("string"), F.max(F.length("seq")).cast("string")).alias("value"))
    return head.unionByName(sequences.select(F.col("tax_id").cast("long").alias("k"), F.concat("name", F.lit("\n"), wrapped(F.col("seq"))).alias("value")))


def trees_nexus(trees: DataFrame, translate: list[str] | None = None) -> DataFrame:
    """(k, value) of (tree_id, name, newick, weight); with ``translate`` leaves are written as their number in that list."""
    from sparkclade.operators.trees import rename_leaves
    from sparkclade.sources.newick import parse_newick, write_newick
    from sparkclade.sources.nexus_tokens import quote

    spark = trees.sparkSession
    if translate:
        numbers = {n: str(i + 1) for i, n in enumerate(translate)}

        def run(frames):
            for f in frames:
                yield f.assign(newick=[write_newick(rename_leaves(parse_newick(x), numbers)) for x in f["newick"]])

        trees = trees.select("tree_id", "name", "weight", "newick").mapInPandas(run, "tree_id long, name string, weight double, newick string")
    table = "\n  translate\n" + ",\n".join(f"    {i + 1} {quote(n)}" for i, n in enumerate(translate)) + "\n  ;" if translate else ""
    head = spark.createDataFrame([(-1, "#NEXUS\nbegin trees;" + table)], "k long, value string")
    weight = F.when(F.col("weight") != 1.0, F.concat(F.lit("[&W "), F.col("weight").cast("string"), F.lit("] "))).otherwise("")
    rows = trees.select(F.col("tree_id").cast("long").alias("k"), F.concat(F.lit("  tree "), quoted(F.col("name")), F.lit(" = [&U] "), weight, F.col("newick")).alias("value"))
    return head.unionByName(rows).unionByName(spark.createDataFrame([(2**62, "end;")], "k long, value string"))


def distances_phylip(distances: DataFrame, digits: int = 6) -> DataFrame:
    """(k, value) of the full table (i, j, name_i, d)."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda x: F.format_number(x["d"], digits)), " ")
    rows = distances.groupBy("i", "name_i").agg(row.alias("row"))
    return phylip_of_lines(rows, rows.agg(F.count("*").alias("n")))


def phylip_of_lines(rows: DataFrame, n: DataFrame) -> DataFrame:
    """(k, value) of the lines (i, name_i, row) of a full table, and their number (n)."""
    head = n.select(F.lit(-1).cast("long").alias("k"), F.col("n").cast("string").alias("value"))
    return head.unionByName(rows.select(F.col("i").cast("long").alias("k"), F.concat_ws(" ", "name_i", "row").alias("value")))


def distances_nexus(distances: DataFrame, digits: int = 6) -> DataFrame:
    body = distances_phylip(distances, digits).where("k >= 0").withColumn("value", F.concat(F.lit("    "), "value"))
    spark = distances.sparkSession
    edge = spark.createDataFrame([(-1, "#NEXUS\nbegin distances;\n  format triangle=both;\n  matrix"), (2**62, "  ;\nend;")], "k long, value string")
    return edge.unionByName(body)


def sets_nexus(runs: DataFrame, kind: str = "charset") -> DataFrame:
    """(k, value) of (name, first, last), zero-based runs of each set."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), lambda r: F.when(r["first"] == r["last"], (r["first"] + 1).cast("string")).otherwise(F.concat((r["first"] + 1).cast("string"), F.lit("-"), (r["last"] + 1).cast("string"))))
    rows = runs.groupBy("name").agg(F.array_join(items, " ").alias("items"))
    lines = rows.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("k"), F.concat(F.lit(f"  {kind} "), quoted(F.col("name")), F.lit(" = "), "items", F.lit(";")).alias("value"))
    edge = runs.sparkSession.createDataFrame([(-1, "#NEXUS\nbegin sets;"), (2**62, "end;")], "k long, value string")
    return edge.unionByName(lines)


def charsets_of_lengths(lengths: DataFrame) -> DataFrame:
    """(name, first, last) of (k, name, n): sets one after another."""
    end = F.sum("n").over(Window.orderBy("k"))
    return lengths.select("name", (end - F.col("n")).alias("first"), (end - 1).alias("last"))


def paml(rates: list[float], composition: list[float], dim: int = 20) -> list[str]:
    """Lines of a rate matrix, lower triangle by rows, and its composition."""
    rows, at = [], 0
    for i in range(1, dim):
        rows.append(" ".join(f"{x:.6f}" for x in rates[at : at + i]))
        at += i
    return [*rows, "", " ".join(f"{x:.6f}" for x in composition)]


def latex(text: Column) -> Column:
    return F.regexp_replace(text, r"([_%&#$])", r"\\$1")


def tabs_of_spaces(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"\s+", "\t")
