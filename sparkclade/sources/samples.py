"""Sampler output as tables: trees and parameters of runs, by lines.

Nothing here needs a file as a whole: a tree or a sample is a line, which says its generation itself, so files of any
length are split among tasks.  Two layouts are known: ``mcmc_trees_N.nex`` with ``mcmc_prams_N``, and ``base.runN.t`` with
``base.runN.p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names by layout: of trees and of parameters, with the number of the run.
LAYOUTS = {"own": (r"mcmc_trees_(\d+)[.]nex$", r"mcmc_prams_(\d+)$"), "mrbayes": (r"[.]run(\d+)[.]t$", r"[.]run(\d+)[.]p$")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines of all files at ``path``, in no order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def run_of(pattern: str) -> Column:
    return F.regexp_extract("file", pattern, 1).cast("int")


def parameters(lines: DataFrame, layout: str = "own") -> DataFrame:
    """(run, gen, k, value): lines that begin with a number are samples, of a generation and parameters from 0 on."""
    found = lines.where(F.col("file").rlike(LAYOUTS[layout][1]) & F.col("value").rlike(r"^\s*\d"))
    words = F.split(F.trim(F.translate("value", "\t", " ")), " +")
    each = found.select(run_of(LAYOUTS[layout][1]).alias("run"), F.get(words, F.lit(0)).cast("long").alias("gen"), F.posexplode(F.slice(words, 2, F.size(words) - 1)).alias("k", "value"))
    return each.select("run", "gen", "k", F.col("value").cast("double").alias("value"))


def parameter_names(lines: DataFrame, layout: str = "mrbayes") -> DataFrame:
    """(run, k, name): from the line of headings that begins with ``Gen``."""
    found = lines.where(F.col("file").rlike(LAYOUTS[layout][1]) & F.lower("value").rlike(r"^\s*#?\s*gen\s"))
    words = F.split(F.trim(F.regexp_replace(F.translate("value", "\t", " "), r"^\s*#\s*", "")), " +")
    return found.select(run_of(LAYOUTS[layout][1]).alias("run"), F.posexplode(F.slice(words, 2, F.size(words) - 1)).alias("k", "name")).distinct()


def tree_samples(lines: DataFrame, layout: str = "own") -> DataFrame:
    """(run, gen, newick): lines ``tree name = ...``, the generation being the number that ends the name; comments are left out."""
    found = lines.where(F.col("file").rlike(LAYOUTS[layout][0]))
    tree = r"(?i)^\s*tree\s+\S*?(\d+)\s*=\s*(.*;)\s*$"
    named = found.select(run_of(LAYOUTS[layout][0]).alias("run"), F.regexp_extract("value", tree, 1).alias("gen"), F.regexp_extract("value", tree, 2).alias("newick")).where("gen <> ''")
    return named.select("run", F.col("gen").cast("long").alias("gen"), F.regexp_replace("newick", r"\[[^\]]*\]\s*", "").alias("newick"))


def translations(lines: DataFrame, layout: str = "own") -> DataFrame:
    """(run, number, name): what leaves are called, from lines of a number, a name and a comma or nothing; a row a taxon."""
    found = lines.where(F.col("file").rlike(LAYOUTS[layout][0]))
    pair = r"^\s*(\d+)\s+('(?:[^']|'')*'|[^\s,;=]+)\s*[,;]?\s*$"
    named = found.select(run_of(LAYOUTS[layout][0]).alias("run"), F.regexp_extract("value", pair, 1).alias("number"), F.regexp_extract("value", pair, 2).alias("name")).where("number <> ''")
    name = F.when(F.col("name").startswith("'"), F.regexp_replace(F.expr("substring(name, 2, length(name) - 2)"), "''", "'")).otherwise(F.col("name"))
    return named.select("run", F.col("number").cast("int").alias("number"), name.alias("name"))


def translated(samples: DataFrame, names: dict[str, str]) -> DataFrame:
    """``samples`` with the leaves' numbers replaced by ``names``."""
    from sparkclade.operators.trees import rename_leaves

    from .formats import few_trees
    from .newick import parse_newick, write_newick

    def run(frames):
        for f in few_trees(frames):
            yield f.assign(newick=[write_newick(rename_leaves(parse_newick(x), names)) for x in f["newick"]])

    return samples.select("run", "gen", "newick").mapInPandas(run, "run int, gen long, newick string")


def posterior_samples(trees: DataFrame, values: DataFrame, burn_in: int = 0) -> DataFrame:
    """(run, gen, newick, parameters): trees with the parameters of their generation, from generation ``burn_in`` on."""
    rows = values.where(F.col("gen") >= burn_in).groupBy("run", "gen").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("x"))
    rows = rows.select("run", "gen", F.transform("x", lambda x: x["value"]).alias("parameters"))
    return trees.where(F.col("gen") >= burn_in).join(rows, ["run", "gen"]).select("run", "gen", "newick", "parameters")


def unmatched_samples(trees: DataFrame, values: DataFrame) -> DataFrame:
    """(run, gen, has_tree, has_parameters): generations of which one is missing."""
    a = trees.select("run", "gen").distinct().withColumn("has_tree", F.lit(True))
    b = values.select("run", "gen").distinct().withColumn("has_parameters", F.lit(True))
    return a.join(b, ["run", "gen"], "full").na.fill(False).where("not has_tree or not has_parameters")


def parameter_lines(samples: DataFrame) -> DataFrame:
    """(k, value): a line for each sample (gen, parameters), tab-separated, after one of headings."""
    width = samples.agg(F.max(F.size("parameters")).alias("n"))
    head = width.select(F.lit(-1).cast("long").alias("k"), F.concat_ws("\t", F.lit("# gen"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("p"), i.cast("string")))).alias("value"))
    rows = samples.select(F.col("gen").alias("k"), F.concat_ws("\t", F.col("gen").cast("string"), F.transform("parameters", lambda x: x.cast("string"))).alias("value"))
    return head.unionByName(rows)


def bipartitions(files: DataFrame) -> DataFrame:
    """(file, split, frequency) of program logs (file, value): the table after ``Bipartitions found``.

    Wide tables come in sections of some taxa each, and the frequencies stand in the last of them.
    """
    table = F.element_at(F.split("value", "Bipartitions found"), -1)
    row = r"^\s*([.*]+)(?:\s+([0-9.]+))?(?:\s+[0-9.]+%?)?\s*$"
    lines = files.where(F.col("value").contains("Bipartitions found")).select("file", F.posexplode(F.split(table, "\n")).alias("k", "line")).where(F.col("line").rlike(row))
    parts = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", F.regexp_extract("line", row, 1).alias("key"), F.regexp_extract("line", row, 2).alias("f")))).alias("x"))
    many = F.size(F.filter("x", lambda x: x["f"] != ""))
    sections = F.size("x") / F.col("many")
    keyed = parts.withColumn("many", many).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    piece = lambda s: F.get("x", (s * F.col("many") + F.col("at")).cast("int"))
    split = F.array_join(F.transform(F.sequence(F.lit(0), (sections - 1).cast("int")), lambda s: piece(s)["key"]), "")
    return keyed.select("file", split.alias("split"), piece((sections - 1).cast("int"))["f"].cast("double").alias("frequency"))
