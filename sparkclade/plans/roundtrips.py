"""Queries on sources and sinks: what a writer writes, a reader reads back; texts of the other formats are spelt out from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkclade.operators import pairs, recode, sites
from sparkclade.sources import formats, samples, tree_files, writers

from . import bridge as br
from .catalog import C, P, S, query, rounded


def as_file(lines: DataFrame, name: str) -> DataFrame:
    """One text (file, value) of the lines (k, value) of a writer."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "\n")
    return lines.agg(F.concat(text, F.lit("\n")).alias("value")).select(F.lit(name).alias("file"), "value")


def _named(spark, d) -> DataFrame:
    """(tax_id, name, seq) of the alignment, nations as names without blanks."""
    nation = br.table(spark, d, "nation").select(F.col("n_nationkey").alias("tax"), F.translate(F.lower("n_name"), " ", "_").alias("name"))
    return sites.sequences(br.chars(spark, d)).join(nation, "tax").select(F.col("tax").alias("tax_id"), "name", "seq")


NAMED = C + ", named AS (SELECT n_nationkey AS tax_id, replace(lower(n_name), ' ', '_') AS name, seq FROM (SELECT tax, string_agg(ch, '' ORDER BY pos) AS seq FROM chars GROUP BY tax) s JOIN nation ON n_nationkey = tax) "
READ_BACK = NAMED + "SELECT name, seq, row_number() OVER (ORDER BY tax_id) - 1 AS tax_id FROM named"


def _back(files: DataFrame) -> DataFrame:
    return formats.sequences_in(files).select("name", "seq", "tax_id")


@query(READ_BACK)
def fasta_round_trip(spark, d):
    return _back(as_file(writers.fasta(_named(spark, d)), "a.fasta"))


@query(READ_BACK)
def phylip_round_trip(spark, d):
    return _back(as_file(writers.phylip(_named(spark, d)), "a.phy"))


@query(READ_BACK)
def phylip_interleaved_round_trip(spark, d):
    return _back(as_file(writers.phylip(_named(spark, d), interleave=True), "a.phy"))


@query(READ_BACK)
def nexus_round_trip(spark, d):
    return _back(as_file(writers.nexus(_named(spark, d)), "a.nex"))


@query(NAMED + "SELECT name, seq FROM named UNION ALL SELECT name, translate(seq, 'agct', 'rryy') FROM named")
def nexus_parts_round_trip(spark, d):
    """Two parts in one file: the alignment, and it recoded."""
    a = _named(spark, d)
    both = a.withColumn("part", F.lit("one")).unionByName(a.withColumn("seq", F.translate("seq", "agct", "rryy")).withColumn("part", F.lit("two")))
    return formats.sequences_in(as_file(writers.nexus_parts(both, {"one": "dna", "two": "dna"}), "p.nex")).select("name", "seq")


@query(READ_BACK)
def clustal_read(spark, d):
    rows = _named(spark, d).select("tax_id", "name", F.posexplode(F.split(writers.wrapped(F.col("seq")), "\n")).alias("block", "chunk"))
    body = rows.select((F.col("block").cast("long") * 1000 + F.col("tax_id")).alias("k"), F.concat_ws("      ", "name", "chunk").alias("value"))
    gap = rows.select((F.col("block").cast("long") * 1000 + 999).alias("k")).distinct().select("k", F.lit("\n").alias("value"))
    head = spark.createDataFrame([(-1, "CLUSTAL W (1.83) multiple sequence alignment\n\n")], "k long, value string")
    return _back(as_file(head.union(body).union(gap), "a.aln"))


@query(READ_BACK)
def pir_read(spark, d):
    lines = _named(spark, d).select(F.col("tax_id").alias("k"), F.concat(F.lit(">DL;"), "name", F.lit("\na comment\n"), writers.wrapped(F.col("seq")), F.lit("*")).alias("value"))
    return _back(as_file(lines, "a.pir"))


@query(READ_BACK)
def gde_read(spark, d):
    lines = _named(spark, d).select(F.col("tax_id").alias("k"), F.concat(F.lit('{\nname "'), "name", F.lit('"\ntype "DNA"\nsequence "'), writers.wrapped(F.col("seq")), F.lit('"\n}')).alias("value"))
    return _back(as_file(lines, "a.gde"))


@query(NAMED + "SELECT name, 'dna' AS data_type, length(seq)::INTEGER AS n FROM named")
def sniffed_type(spark, d):
    """A format and a type that no suffix tells."""
    return formats.sequences_in(as_file(writers.fasta(_named(spark, d)), "a.txt")).select("name", "data_type", F.length("seq").alias("n"))


@query("WITH x AS (SELECT p_partkey AS pos, CASE WHEN p_size <= 15 THEN 'small' ELSE 'large' END AS name FROM part WHERE p_size <= 15 OR p_size > 35), g AS (SELECT name, pos, pos - row_number() OVER (PARTITION BY name ORDER BY pos) AS g FROM x) SELECT name, min(pos) AS first, max(pos) AS last FROM g GROUP BY name, g")
def charsets_round_trip(spark, d):
    """Sets of sites as runs, written as a sets block, read, and their lists taken apart again."""
    part = br.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), "p_size")
    mask = lambda keep: recode.runs_of_mask(part.select("pos", keep.alias("keep")))
    runs = mask(F.col("p_size") <= 15).withColumn("name", F.lit("small")).unionByName(mask(F.col("p_size") > 35).withColumn("name", F.lit("large")))
    found = formats.sets_in(as_file(writers.sets_nexus(runs), "s.nex")).where("kind = 'charset'")
    ends = found.select("name", F.explode(F.split(F.trim("items"), " +")).alias("run")).select("name", F.split("run", "-").alias("w"))
    return ends.select("name", (F.get("w", F.lit(0)).cast("long") - 1).alias("first"), (F.coalesce(F.get("w", F.lit(1)), F.get("w", F.lit(0))).cast("long") - 1).alias("last"))


@query(C + ", sited AS (SELECT DISTINCT pos FROM chars), k AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS n FROM sited) SELECT pos, (k < 10 OR (k >= 19 AND k <= 39 AND (k - 19) % 3 = 0) OR k >= 90) AS keep FROM k")
def char_list_mask(spark, d):
    """A character list over all sites of the alignment, which are as many as there are parts."""
    sited = recode.numbered_sites(br.chars(spark, d))
    mask = recode.mask_of_char_list(spark, "1-10 20 - 40\\3 91-.", sited.count())
    return sited.join(mask.withColumnRenamed("pos", "new_pos"), "new_pos").select("pos", "keep")


@query(S + "SELECT tree_id, split_key, round(br_len, 6) AS br_len FROM splits")
def trees_nexus_round_trip(spark, d):
    """Trees written with a translate command and read back."""
    taxa = br.taxa(spark, d)
    trees = br.trees(spark, d).select("tree_id", F.concat(F.lit("t"), F.col("tree_id").cast("string")).alias("name"), "newick", F.lit(1.0).alias("weight"))
    back = formats.trees_in(as_file(writers.trees_nexus(trees, taxa), "t.nex")).select(F.substring("name", 2, 20).cast("long").alias("tree_id"), "newick")
    return rounded(formats.splits_of(back, taxa).select("tree_id", "split_key", "br_len"), "br_len")


@query(S + "SELECT tree_id, split_key FROM splits")
def phyloxml_read(spark, d):
    """The trees as nested clades."""
    from sparkclade.sources.newick import children, parse_newick

    def xml(text: str) -> str:
        nodes = parse_newick(text)
        below = children(nodes)

        def clade(n: int) -> str:
            length = "" if nodes[n].length is None else f"<branch_length>{nodes[n].length}</branch_length>"
            return f"<clade>{f'<name>{nodes[n].name}</name>' if nodes[n].is_leaf else ''}{length}{''.join(map(clade, below[n]))}</clade>"

        return f"<phyloxml><phylogeny>{clade(0)}</phylogeny></phyloxml>"

    def run(frames):
        for f in frames:
            yield f.assign(value=[xml(x) for x in f["newick"]]).rename(columns={"tree_id": "file"})[["file", "value"]].astype({"file": str})

    files = br.trees(spark, d).mapInPandas(run, "file string, value string")
    trees = formats.trees_in(files.select(F.concat("file", F.lit(".xml")).alias("file"), "value")).select(F.split("file", "[.]")[0].cast("long").alias("tree_id"), "newick")
    return formats.splits_of(trees, br.taxa(spark, d)).select("tree_id", "split_key")


@query(C + ", pr AS (SELECT x.tax AS i, y.tax AS j, count(*) FILTER (x.ch <> y.ch) * 1.0::DOUBLE / count(*) AS d FROM chars x JOIN chars y ON x.pos = y.pos GROUP BY 1, 2) SELECT i, j, round(d, 6) AS d FROM pr")
def distances_round_trip(spark, d):
    half = rounded(pairs.p_distances(br.chars(spark, d), ignore_gaps=False), "d")
    own = br.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    full = half.union(half.select("j", "i", "d")).union(own.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))
    lines = writers.distances_phylip(full.withColumn("name_i", F.concat(F.lit("t"), F.col("i").cast("string"))), 6)
    return formats.distances_in(as_file(lines, "d.phy")).select("i", "j", "d")


@query("SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def numbers_read(spark, d):
    lines = br.table(spark, d, "orders").select(F.concat_ws("  ", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")).alias("value"))
    return formats.numbers_of(lines, 1).agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("SELECT round(sum(p_retailprice), 2) AS total, count(*) AS n FROM part")
def numbers_file_read(spark, d):
    """One column of a whole text, its two lines of heading passed over."""
    lines = br.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("\t", F.col("p_retailprice").cast("string"), F.lit("x")).alias("value"))
    head = spark.createDataFrame([(-2, "a heading"), (-1, "price note")], "k long, value string")
    return formats.numbers_in(as_file(head.union(lines), "n.txt"), 0, 2).agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("WITH p AS (SELECT p_size % 5 AS edge, p_retailprice AS r, p_partkey % 97 AS q FROM part), t AS (SELECT edge, r / sum(r) OVER (PARTITION BY q) AS x FROM p) SELECT edge::BIGINT AS edge, round(sum(x), 4) AS heat FROM t GROUP BY edge")
def jplace_read(spark, d):
    """Placements as a document of fields and lists, read and summed by edge."""
    p = br.table(spark, d, "part")
    row = F.array((F.col("p_size") % 5).cast("double"), F.col("p_retailprice").cast("double"))
    doc = p.groupBy((F.col("p_partkey") % 97).alias("q")).agg(F.collect_list(row).alias("p")).agg(F.collect_list(F.struct("p")).alias("placements"))
    text = doc.select(F.lit("x.jplace").alias("file"), F.to_json(F.struct(F.array(F.lit("edge_num"), F.lit("like_weight_ratio")).alias("fields"), "placements")).alias("value"))
    return rounded(formats.jplace_heat(formats.placements_in(text)), "heat", digits=4)


@query(r"SELECT p_partkey AS pos, regexp_replace(replace(p_name, ' ', '_'), '([_%&#$])', '\\\1', 'g') AS latex FROM part")
def latex_names(spark, d):
    return br.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), writers.latex(F.translate("p_name", " ", "_")).alias("latex"))


@query("SELECT c_custkey AS k, regexp_replace(trim(c_name || '   ' || c_mktsegment), '\\s+', chr(9), 'g') AS line FROM customer")
def tabs_of_spaces(spark, d):
    return br.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), writers.tabs_of_spaces(F.concat_ws("   ", "c_name", "c_mktsegment")).alias("line"))


@query("WITH l AS (SELECT n_nationkey AS k, n_name AS name, length(n_name) AS n FROM nation) SELECT name, (sum(n) OVER (ORDER BY k) - n)::BIGINT AS first, (sum(n) OVER (ORDER BY k) - 1)::BIGINT AS last FROM l")
def charsets_of_lengths(spark, d):
    n = br.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.length("n_name").cast("long").alias("n"))
    return writers.charsets_of_lengths(n)


# -- sampler output


def _tree_lines(spark, d, layout: str) -> DataFrame:
    """Lines of two runs' tree files: trees of even and of odd suppliers, leaves by number, generations by tens."""
    numbers = {n: str(i + 1) for i, n in enumerate(br.taxa(spark, d))}

    def run(frames):
        from sparkclade.operators.trees import rename_leaves
        from sparkclade.sources.newick import parse_newick, write_newick

        for f in formats.few_trees(frames):
            yield f.assign(newick=[write_newick(rename_leaves(parse_newick(x), numbers)) for x in f["newick"]])

    trees = br.trees(spark, d).mapInPandas(run, "tree_id long, newick string")
    own = layout == "own"
    file = _file(F.lit("/x/mcmc_trees_%d.nex" if own else "/x/base.run%d.t"))
    line = F.concat(F.lit("  tree t_" if own else "   tree gen."), (F.col("tree_id") * 10).cast("string"), F.lit(" = [&U] " if own else " = [&U][&W 1] "), "newick")
    body = trees.select(file.alias("file"), line.alias("value"))
    words = spark.createDataFrame([("#NEXUS",), ("begin trees;",), ("  translate",), *[(f"    {i + 1} {n.replace(' ', '_')}{',' if i < 24 else ''}",) for i, n in enumerate(numbers)], ("  ;",)], "value string")
    return words.crossJoin(F.broadcast(body.select("file").distinct())).select("file", "value").union(body)


def _file(pattern: Column) -> Column:
    return F.replace(pattern, F.lit("%d"), (F.col("tree_id") % 2).cast("string"))


def _parameter_lines(spark, d, layout: str) -> DataFrame:
    """Two parameters a sample: a supplier's balance and nation; every seventh sample lacks."""
    own = layout == "own"
    file = _file(F.lit("/x/mcmc_prams_%d" if own else "/x/base.run%d.p"))
    sep = "  " if own else "\t"
    rows = br.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "tree_id").where("tree_id % 7 <> 3")
    body = rows.select(file.alias("file"), F.concat_ws(sep, (F.col("tree_id") * 10).cast("string"), F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string")).alias("value"))
    head = ["# genPlus1 a b"] if own else ["[ID: 1234]", "Gen\tbalance\tnation"]
    return spark.createDataFrame([(x,) for x in head], "value string").crossJoin(F.broadcast(body.select("file").distinct())).select("file", "value").union(body)


POSTERIOR = S + ", kept AS (SELECT * FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey * 10 >= 100) SELECT (s_suppkey % 2)::INTEGER AS run, s_suppkey * 10 AS gen, split_key, round(s_acctbal, 2) AS balance, s_nationkey::DOUBLE AS nation FROM kept JOIN splits ON tree_id = s_suppkey"


def _posterior(spark, d, layout):
    lines = _tree_lines(spark, d, layout).union(_parameter_lines(spark, d, layout))
    trees, values = samples.tree_samples(lines, layout), samples.parameters(lines, layout)
    names = {str(i + 1): n for i, n in enumerate(br.taxa(spark, d))}
    found = samples.posterior_samples(samples.translated(trees, names), values, burn_in=100)
    splits = formats.splits_of(found.select(F.struct("run", "gen").alias("tree_id"), "newick").select((F.col("tree_id.gen") * 2 + F.col("tree_id.run")).alias("tree_id"), "newick"), list(names.values()))
    each = splits.select((F.col("tree_id") % 2).cast("int").alias("run"), F.expr("tree_id div 2").alias("gen"), "split_key")
    return each.join(found, ["run", "gen"]).select("run", "gen", "split_key", F.round(F.col("parameters")[0], 2).alias("balance"), F.col("parameters")[1].alias("nation"))


@query(POSTERIOR)
def posterior_samples(spark, d):
    """Trees and parameters of two runs, read by lines, joined by generation, after the burn-in."""
    return _posterior(spark, d, "own")


@query(POSTERIOR)
def posterior_samples_mrbayes(spark, d):
    return _posterior(spark, d, "mrbayes")


@query("SELECT (s_suppkey % 2)::INTEGER AS run, s_suppkey * 10 AS gen, true AS has_tree, false AS has_parameters FROM supplier WHERE s_suppkey % 7 = 3")
def unmatched_samples(spark, d):
    lines = _tree_lines(spark, d, "own").union(_parameter_lines(spark, d, "own"))
    return samples.unmatched_samples(samples.tree_samples(lines), samples.parameters(lines))


@query("WITH s AS (SELECT s_suppkey % 2 AS run, s_suppkey AS g, s_acctbal::DOUBLE AS a, s_nationkey::DOUBLE AS b FROM supplier WHERE s_suppkey % 7 <> 3 AND s_suppkey * 10 >= 100), l AS (SELECT 0 AS k, a AS v FROM s UNION ALL SELECT 1, b FROM s) SELECT k, count(*) AS n, round(avg(v), 4) AS mean, round(var_samp(v), 3) AS variance FROM l GROUP BY k")
def parameter_summary(spark, d):
    """Means over all runs of what the parameter files hold, after the burn-in."""
    from sparkclade.operators import diagnostics as dg

    values = samples.parameters(_parameter_lines(spark, d, "own")).where("gen >= 100")
    return dg.summarize(values, "k").withColumns({"mean": F.round("mean", 4), "variance": F.round("variance", 3)})


@query("SELECT r.run::INTEGER AS run, n.k::INTEGER AS k, n.name FROM range(2) r(run), (VALUES (0, 'balance'), (1, 'nation')) n(k, name)")
def parameter_names(spark, d):
    return samples.parameter_names(_parameter_lines(spark, d, "mrbayes"))


@query("SELECT r.run::INTEGER AS run, (n_nationkey + 1)::INTEGER AS number, replace(n_name, ' ', '_') AS name FROM nation, range(2) r(run)")
def translate_command(spark, d):
    return samples.translations(_tree_lines(spark, d, "own"))


@query("SELECT event_id AS gen, 0 AS k, round(value, 6) AS value FROM events UNION ALL SELECT event_id, 1, event_id % 7 + 0.5 FROM events")
def parameters_round_trip(spark, d):
    """Samples written as lines of parameters and read back."""
    rows = br.table(spark, d, "events").select(F.col("event_id").alias("gen"), F.array(F.col("value").cast("double"), F.col("event_id") % 7 + F.lit(0.5)).alias("parameters"))
    lines = samples.parameter_lines(rows).select(F.lit("/x/mcmc_prams_0").alias("file"), "value")
    return rounded(samples.parameters(lines).select("gen", "k", "value"), "value")


@query(S + ", n AS (SELECT split_key, count(*) AS n FROM splits WHERE bit_count(split_key) BETWEEN 2 AND 23 GROUP BY 1) SELECT (SELECT string_agg(CASE WHEN (split_key >> i) & 1 = 1 THEN '*' ELSE '.' END, '' ORDER BY i) FROM range(25) r(i)) AS split, n::DOUBLE AS frequency FROM n")
def bipartition_log(spark, d):
    """A table of splits in two sections of taxa, frequencies in the second, as some programs log it."""
    from sparkclade.operators import splits as sp

    n = br.splits(spark, d).where(~sp.is_trivial(F.col("split_key"), br.N_TAX)).groupBy("split_key").agg(F.count("*").alias("n"))
    text = n.select("split_key", sp.split_string(F.col("split_key"), br.N_TAX).alias("t"), "n")
    first = text.select(F.col("split_key").alias("k"), F.substring("t", 1, 15).alias("value"))
    last = text.select((F.col("split_key") + (1 << 40)).alias("k"), F.concat(F.expr("substring(t, 16)"), F.lit("    "), F.col("n").cast("string"), F.lit("   1.0%")).alias("value"))
    marks = spark.createDataFrame([(-3, "some words"), (-2, "Bipartitions found in one or more trees:"), (-1, "         1111"), (1 << 40, "\n-----------")], "k long, value string")
    return samples.bipartitions(as_file(marks.union(first).union(last), "log")).select("split", "frequency")


def _tree_files(spark, d) -> str:
    """A folder of files of tree commands over two lines each, with semicolons in comments."""
    from sparkclade.operators.lineage import folder

    path = f"{folder(spark)}/trees-{uuid.uuid4().hex}"
    line = F.concat(F.lit("tree t"), F.col("tree_id").cast("string"), F.lit(" [of a supplier; its number]\n  = [&U] "), F.col("newick"))
    br.trees(spark, d).select(line.alias("value")).write.text(path)
    return path


def _splits_back(spark, d, trees: DataFrame) -> DataFrame:
    named = trees.select(F.substring("name", 2, 20).cast("long").alias("tree_id"), "newick")
    return rounded(formats.splits_of(named, br.taxa(spark, d)).select("tree_id", "split_key", "br_len"), "br_len")


@query(S + "SELECT tree_id, split_key, round(br_len, 6) AS br_len FROM splits")
def tree_files_round_trip(spark, d):
    """Trees written to files and read back in parts."""
    return _splits_back(spark, d, tree_files.read_trees(spark, _tree_files(spark, d)))


@query(S + "SELECT tree_id, split_key, round(br_len, 6) AS br_len FROM splits")
def tree_index_round_trip(spark, d):
    """Trees written to files and read back through an index of runs of ten."""
    path = _tree_files(spark, d)
    tree_files.write_index(spark, path, f"{path}-index", 10)
    tree_files.register(spark)
    return _splits_back(spark, d, spark.read.format("trees").load(f"{path}-index"))
