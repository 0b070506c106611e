"""Masks as tables, subsetting, recoding and translation of alignments in long form (tax, pos, ch)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkclade.functions.genetic_code import IUPAC, codon_table, plain_codons

from .lineage import cut

#: The six amino-acid groups of Dayhoff recoding.
DAYHOFF = ("c", "stpag", "ndeq", "hrk", "milv", "fyw")
COMPLEMENT = {k: next(c for c, s in IUPAC.items() if set(s) == {"acgt"[3 - "acgt".index(x)] for x in of}) for k, of in IUPAC.items()}


def numbered_sites(chars: DataFrame) -> DataFrame:
    """(pos, new_pos): sites numbered 0 on in order; ranges of sites are ranked on their own and offset by the sites before them."""
    sites = chars.select("pos").distinct()
    bucket = F.floor(F.col("pos") / 1024)
    n = sites.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = sites.withColumn("bucket", bucket).withColumn("own", F.row_number().over(Window.partitionBy("bucket").orderBy("pos"))).join(n, "bucket")
    return rank.select("pos", (F.col("ahead") + F.col("own") - 1).alias("new_pos"))


def numbered(rows: DataFrame, order: tuple[str, ...], within: str) -> DataFrame:
    """``rows`` with ``k``: their numbers from 0 in ``order``, which begins with ``within``, in each group of it.

    Ranges of rows are numbered on their own and offset by those before, so no task sorts a group whole.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    parts = cut(parts)
    n = parts.groupBy(within, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = n.select(within, "part", "first", F.coalesce(F.sum("n").over(Window.partitionBy(within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return parts.join(ahead, [within, "part"]).withColumn("k", F.col("ahead") + F.col("at") - F.col("first")).select(*rows.columns, "k")


def renumbered(chars: DataFrame) -> DataFrame:
    """Sites numbered 0 on in order, without gaps in the numbers; the site table, one row a site, is what is sorted."""
    return chars.join(numbered_sites(chars), "pos").select("tax", F.col("new_pos").alias("pos"), "ch")


def subset_by_mask(chars: DataFrame, mask: DataFrame, inverse: bool = False) -> DataFrame:
    """Sites whose ``mask`` (pos, keep) is true, or false if ``inverse``; positions keep their numbers."""
    return chars.join(mask.where(~F.col("keep") if inverse else F.col("keep")).select("pos"), "pos", "left_semi")


def subset_by_char_set(chars: DataFrame, char_set: DataFrame, exclude: bool = False) -> DataFrame:
    return chars.join(char_set.select("pos").distinct(), "pos", "left_anti" if exclude else "left_semi")


def char_partition(chars: DataFrame, parts: DataFrame) -> DataFrame:
    """(tax, pos, ch, subset): sites by their subset in ``parts`` (pos, subset), others in ``remainder``."""
    return chars.join(parts, "pos", "left").select("tax", "pos", "ch", F.coalesce("subset", F.lit("remainder")).alias("subset"))


def overlapping_sites(parts: DataFrame) -> DataFrame:
    return parts.distinct().groupBy("pos").agg(F.count("*").alias("n")).where("n > 1")


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("keep", "other"), "pos").select("pos", (F.col("keep") & F.col("other")).alias("keep"))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("keep", "other"), "pos").select("pos", (F.col("keep") | F.col("other")).alias("keep"))


def mask_not(a: DataFrame) -> DataFrame:
    return a.select("pos", (~F.col("keep")).alias("keep"))


def runs_of_mask(mask: DataFrame) -> DataFrame:
    """(first, last): maximal runs of kept sites, by gaps and islands within blocks that are then joined up."""
    kept = mask.where("keep").select("pos").withColumn("block", F.floor(F.col("pos") / 4096))
    w = Window.partitionBy("block").orderBy("pos")
    island = kept.withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = island.groupBy("block", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    over = Window.orderBy("first")
    starts = runs.withColumn("new", (F.col("first") - F.lag("last", 1, -2).over(over) > 1).cast("int"))
    return starts.withColumn("run", F.sum("new").over(over)).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")


def parse_char_list(text: str, length: int) -> list[tuple[int, int, int]]:
    """NEXUS character list, 1-based: ``1 3-5 6-10\\2 7-. all`` as zero-based (first, last, step)."""
    out = []
    for word in re.sub(r"\s*([-\\])\s*", r"\1", text.strip().lower()).split():
        if word == "all":
            out.append((0, length - 1, 1))
            continue
        m = re.fullmatch(r"(\d+|\.)(?:-(\d+|\.))?(?:\\(\d+))?", word)
        if not m:
            raise ValueError(f"{word!r} is not a character list")
        first, last = (length if x == "." else int(x) for x in (m[1], m[2] or m[1]))
        if not 1 <= first <= last <= length:
            raise ValueError(f"{word!r} is out of 1 to {length}")
        out.append((first - 1, last - 1, int(m[3] or 1)))
    return out


def mask_of_char_list(spark, text: str, length: int, invert: bool = False) -> DataFrame:
    """(pos, keep) for sites 0 to ``length`` - 1."""
    spans = spark.createDataFrame(parse_char_list(text, length), "first long, last long, step long")
    listed = spans.select(F.explode(F.sequence("first", "last", "step")).alias("pos")).distinct().withColumn("hit", F.lit(True))
    keep = F.col("hit").isNotNull()
    return spark.range(length).withColumnRenamed("id", "pos").join(listed, "pos", "left").select("pos", (~keep if invert else keep).alias("keep"))


def recode_groups(groups: tuple[str, ...], symbols: str = "", first_letter: bool = False, gap: str = "x") -> Column:
    """``ch`` by group: the group's first letter, or one of ``symbols``; characters in ``gap`` become gaps."""
    to = [g[0] for g in groups] if first_letter else list(symbols or "123456789"[: len(groups)])
    return F.translate("ch", "".join(groups) + gap, "".join(t * len(g) for g, t in zip(groups, to)) + "-" * len(gap))


def recode_dayhoff(first_letter: bool = False) -> Column:
    return recode_groups(DAYHOFF, "123456", first_letter)


def recode_ry(ambiguities_to_gaps: bool = True, use01: bool = False) -> Column:
    """Purines and pyrimidines; other ambiguities become gaps."""
    r, y = ("0", "1") if use01 else ("r", "y")
    rest = "swkmbdhvn" if ambiguities_to_gaps else ""
    return F.translate("ch", "agrcty" + rest, r * 3 + y * 3 + "-" * len(rest))


def recode_ry_positions(positions: tuple[int, ...], size: int = 3) -> Column:
    """RY at the given codon positions (1 on) only."""
    return F.when((F.col("pos") % size + 1).isin(*positions), recode_ry()).otherwise(F.col("ch"))


def codon_position_mask(chars: DataFrame, which: int, size: int = 3) -> DataFrame:
    """(pos, keep) for zero-based sites; ``which`` from 1."""
    return chars.select("pos").distinct().select("pos", (F.col("pos") % size == which - 1).alias("keep"))


def codons(chars: DataFrame) -> DataFrame:
    """(tax, codon_pos, codon) of zero-based sites, whole codons only."""
    grouped = chars.groupBy("tax", F.floor(F.col("pos") / 3).alias("codon_pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("three"))
    return grouped.where(F.size("three") == 3).select("tax", "codon_pos", F.array_join(F.transform("three", lambda x: x["ch"]), "").alias("codon"))


def translate(chars: DataFrame, table_id: int = 1) -> DataFrame:
    """(tax, pos, ch): amino acids; ``---`` is a gap, codons that no table holds are ``x``.  The table is a few thousand rows."""
    code = codon_table(chars.sparkSession, table_id)
    return codons(chars).join(F.broadcast(code), "codon", "left").select("tax", F.col("codon_pos").alias("pos"), F.coalesce("aa", F.lit("x")).alias("ch"))


def check_translation(dna: DataFrame, protein: DataFrame, table_id: int = 1) -> DataFrame:
    """(tax, pos, expected, found): places at which a protein alignment isn't the translation."""
    expected = translate(dna, table_id).withColumnRenamed("ch", "expected")
    return expected.join(protein.withColumnRenamed("ch", "found"), ["tax", "pos"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))


def codon_usage(chars: DataFrame, table_id: int = 1) -> DataFrame:
    """(aa, codon, n) over all taxa."""
    code = codon_table(chars.sparkSession, table_id)
    return codons(chars).groupBy("codon").agg(F.count("*").alias("n")).join(F.broadcast(code), "codon").select("aa", "codon", "n")


def codon_column_states(chars: DataFrame, table_id: int = 1) -> DataFrame:
    """(codon_pos, aas, codons): different amino acids and codons of each column of codons, gaps apart."""
    code = codon_table(chars.sparkSession, table_id)
    return codons(chars).join(F.broadcast(code), "codon").where("aa not in ('-', 'x')").groupBy("codon_pos").agg(F.sort_array(F.collect_set("aa")).alias("aas"), F.sort_array(F.collect_set("codon")).alias("codons"))


def has_amino_acids_mask(chars: DataFrame, aas: str, table_id: int = 1) -> DataFrame:
    """(codon_pos, keep): columns that hold any of ``aas``."""
    return codon_column_states(chars, table_id).select("codon_pos", F.arrays_overlap("aas", F.array(*map(F.lit, aas))).alias("keep"))


def constant_amino_acid_mask(chars: DataFrame, table_id: int = 1) -> DataFrame:
    return codon_column_states(chars, table_id).select("codon_pos", (F.size("aas") == 1).alias("keep"))


def degenerate_codons_mask(chars: DataFrame, table_id: int = 1) -> DataFrame:
    """(codon_pos, keep): columns in which one amino acid has more than one codon."""
    code = codon_table(chars.sparkSession, table_id)
    n = codons(chars).join(F.broadcast(code), "codon").where("aa not in ('-', 'x')").groupBy("codon_pos", "aa").agg(F.count_distinct("codon").alias("k"))
    return n.groupBy("codon_pos").agg((F.max("k") > 1).alias("keep"))


def degenerate_sites_mask(chars: DataFrame, table_id: int = 1) -> DataFrame:
    """(pos, keep): codon positions at which some amino acid of the column has more than one base."""
    code = codon_table(chars.sparkSession, table_id)
    found = codons(chars).join(F.broadcast(code), "codon").where("aa not in ('-', 'x')")
    base = found.select("codon_pos", "aa", F.posexplode(F.split("codon", "")).alias("k", "base")).where("base <> ''")
    n = base.groupBy("codon_pos", "k", "aa").agg(F.count_distinct("base").alias("n")).groupBy("codon_pos", "k").agg((F.max("n") > 1).alias("keep"))
    return n.select((F.col("codon_pos") * 3 + F.col("k")).alias("pos"), "keep")


def degenerate(chars: DataFrame, table_id: int = 1) -> DataFrame:
    """(tax, pos, ch): each codon replaced by the code of all bases that its amino acid allows at each position."""
    spark = chars.sparkSession
    plain = codon_table(spark, table_id).where("codon rlike '^[acgt]{3}$'")
    bit = F.expr("CASE base WHEN 'a' THEN 1 WHEN 'c' THEN 2 WHEN 'g' THEN 4 ELSE 8 END")
    base = plain.select("aa", F.posexplode(F.split("codon", "")).alias("k", "base")).where("base <> ''")
    sets = base.groupBy("aa", "k").agg(F.bit_or(bit).alias("bits"))
    letter = spark.createDataFrame([(sum(1 << "acgt".index(x) for x in of), c) for c, of in IUPAC.items()], "bits int, code string")
    codes = sets.join(F.broadcast(letter), "bits").groupBy("aa").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]), "").alias("wide"))
    table = codon_table(spark, table_id).join(codes, "aa").select("codon", "wide")
    new = codons(chars).join(F.broadcast(table), "codon", "left").withColumn("wide", F.coalesce("wide", "codon"))
    return new.select("tax", F.posexplode(F.split("wide", "")).alias("k", "ch"), "codon_pos").where("ch <> ''").select("tax", (F.col("codon_pos") * 3 + F.col("k")).alias("pos"), "ch")


def indelize_codons(chars: DataFrame, aas: str, table_id: int = 1) -> DataFrame:
    """(tax, codon_pos, codon): codons of the given amino acids become gaps."""
    code = codon_table(chars.sparkSession, table_id)
    hit = F.col("aa").isin(*aas)
    return codons(chars).join(F.broadcast(code), "codon", "left").select("tax", "codon_pos", F.when(hit, "---").otherwise(F.col("codon")).alias("codon"))


def blend(*alignments: DataFrame) -> DataFrame:
    """Site p of the k-th of n alignments where p mod n is k."""
    n = len(alignments)
    parts = [a.where(F.col("pos") % n == k).select("tax", "pos", "ch") for k, a in enumerate(alignments)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ligate(a: DataFrame, b: DataFrame, length_a: int) -> DataFrame:
    """b's sites after a's; the taxa are the same."""
    return a.select("tax", "pos", "ch").unionByName(b.select("tax", (F.col("pos") + length_a).alias("pos"), "ch"))


def concatenate(a: DataFrame, b: DataFrame, length_a: int) -> DataFrame:
    """b's sites after a's by taxon, gaps where a taxon lacks one of them."""
    whole = ligate(a, b, length_a)
    every = whole.select("tax").distinct().crossJoin(whole.select("pos").distinct())
    return every.join(whole, ["tax", "pos"], "left").select("tax", "pos", F.coalesce("ch", F.lit("-")).alias("ch"))


def put_gaps(dna: DataFrame, protein: DataFrame) -> DataFrame:
    """(tax, pos, ch): unaligned DNA (tax, pos, ch) spread out as its aligned protein is."""
    order = Window.partitionBy("tax").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = protein.withColumn("nth", F.coalesce(F.sum((F.col("ch") != "-").cast("long")).over(order), F.lit(0)))
    three = placed.select("tax", F.col("pos").alias("p"), F.col("ch").alias("aa"), "nth", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    source = F.when(F.col("aa") != "-", F.col("nth") * 3 + F.col("k"))
    want = three.select("tax", (F.col("p") * 3 + F.col("k")).alias("new_pos"), source.alias("pos"))
    return want.join(dna, ["tax", "pos"], "left").select("tax", F.col("new_pos").alias("pos"), F.coalesce("ch", F.lit("-")).alias("ch"))


def reverse_complement(seq: Column) -> Column:
    """Of a lower-case string with IUPAC codes."""
    return F.translate(F.reverse(seq), "".join(COMPLEMENT), "".join(COMPLEMENT.values()))


def propagate_match_chars(chars: DataFrame, match: str = ".") -> DataFrame:
    """The match character replaced by the first taxon's character."""
    first = chars.groupBy("pos").agg(F.min_by("ch", "tax").alias("first"))
    return chars.join(first, "pos").select("tax", "pos", F.when(F.col("ch") == match, F.col("first")).otherwise(F.col("ch")).alias("ch"))


def rename_for_phylip(taxa: DataFrame, base: str = "s") -> DataFrame:
    """(name, short): a dictionary of short names, by order of name; ranges of names are numbered on their own."""
    ranged = taxa.select("name").repartitionByRange("name").sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id())
    # The partition is in the upper bits of the id, and its rows are numbered in the lower 33.
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    ahead = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranged.withColumn("part", part).join(F.broadcast(ahead), "part").select("name", F.concat(F.lit(base), (F.col("ahead") + row).cast("string")).alias("short"))


def alignment_of(sequences: DataFrame) -> DataFrame:
    """(tax, pos, ch) of (tax, seq); sequences of different lengths are an error of the job."""
    n = sequences.agg(F.max(F.length("seq")).alias("width"))
    same = F.when(F.length("seq") == F.col("width"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("sequence "), F.col("tax").cast("string"), F.lit(" is of another length"))))
    return sequences.crossJoin(F.broadcast(n)).select("tax", F.posexplode(F.split(same, "")).alias("pos", "ch")).where("ch <> ''").select("tax", F.col("pos").cast("long").alias("pos"), "ch")


def duplicate_names(sequences: DataFrame) -> DataFrame:
    """(name, n, first): names that several sequences (tax, name) have."""
    return sequences.groupBy("name").agg(F.count("*").alias("n"), F.min("tax").alias("first")).where("n > 1")


def site_slices(chars: DataFrame, sites: DataFrame) -> DataFrame:
    """(pos, slice): the characters of all taxa, in order, at each of ``sites`` (pos)."""
    some = chars.join(sites.select("pos").distinct(), "pos", "left_semi")
    return some.groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tax", "ch"))), lambda x: x["ch"]), "").alias("slice"))


def mrp_slices(matrix: DataFrame) -> DataFrame:
    """(tree_id, split_key, slice): each column of a matrix representation as taxa with their characters, unknown ones left out."""
    known = matrix.where("ch <> '?'").groupBy("tree_id", "split_key").agg(F.array_sort(F.collect_list(F.struct("tax", "ch"))).alias("x"))
    return known.select("tree_id", "split_key", F.array_join(F.transform("x", lambda x: F.concat(x["tax"].cast("string"), F.lit("="), x["ch"])), " ").alias("slice"))


#: Characters that sequences of a type may hold.
VALID = {"dna": "acgtrywsmkbdhvnx?-", "protein": "acdefghiklmnpqrstvwybzxuo*?-"}


def change_data_type(chars: DataFrame, to: str, symbols: str = "", equates: str = "") -> DataFrame:
    """``chars`` as data of another type: dna, protein, or standard with the given symbols and equates.

    A character that the type has not is an error of the job, which names it.
    """
    valid = symbols + equates + "?-" if to == "standard" else VALID[to]
    ok = F.lit(valid).contains(F.col("ch")) & (F.length("ch") == 1)
    checked = F.when(ok, F.col("ch")).otherwise(F.raise_error(F.concat(F.col("ch"), F.lit(f" is no character of {to} data"))))
    return chars.withColumn("ch", checked)


def pseudo_translate(chars: DataFrame, code: dict[str, str]) -> DataFrame:
    """(tax, pos, ch): codons by any code; gaps stay gaps, codons that the code has not are an error of the job."""
    table = chars.sparkSession.createDataFrame([("---", "-"), *code.items()], "codon string, aa string")
    found = codons(chars).join(F.broadcast(table), "codon", "left")
    checked = F.coalesce("aa", F.raise_error(F.concat(F.lit("the code has no codon "), F.col("codon"))).cast("string"))
    return found.select("tax", F.col("codon_pos").alias("pos"), checked.alias("ch"))


def code_of_23(table_id: int = 1) -> dict[str, str]:
    """A code in which leucine, arginine and serine are two states each: a single change at the third position does not
    lead from one to the other.  The states of the rarer codons are ``1``, ``2`` and ``3``."""
    code = plain_codons(table_id)
    out = dict(code)
    for mark, aa in zip("123", "lrs"):
        blocks: dict[str, list[str]] = {}
        for codon, a in code.items():
            if a == aa:
                blocks.setdefault(codon[:2], []).append(codon)
        most = max(blocks, key=lambda b: (len(blocks[b]), b))
        out.update({c: mark for b, some in blocks.items() if b != most for c in some})
    return out


def recode_motifs(chars: DataFrame, converter: dict[str, str], positions: tuple[int, ...] | None = None) -> DataFrame:
    """(tax, pos, ch): motifs of consecutive sites replaced by ``converter``, at ``positions`` of them (1 on) only if given.

    Motifs that the converter has not stay; the length of all is that of the first.
    """
    size = len(next(iter(converter)))
    table = chars.sparkSession.createDataFrame(list(converter.items()), "motif string, other string")
    grouped = chars.groupBy("tax", F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("x"))
    found = grouped.withColumn("motif", F.array_join(F.transform("x", lambda x: x["ch"]), "")).join(F.broadcast(table), "motif", "left")
    each = found.select("tax", "other", F.posexplode("x").alias("k", "x"))
    hit = F.col("other").isNotNull() & (F.lit(True) if positions is None else (F.col("k") + 1).isin(*positions))
    return each.select("tax", F.col("x.pos").alias("pos"), F.when(hit, F.substring(F.col("other"), F.col("k") + 1, F.lit(1))).otherwise(F.col("x.ch")).alias("ch"))


def empty_alignment(taxa: DataFrame, length: int) -> DataFrame:
    sites = taxa.sparkSession.range(length).withColumnRenamed("id", "pos")
    return sites.crossJoin(F.broadcast(taxa.select("tax"))).select("tax", "pos", F.lit("?").alias("ch"))


def conserved_blocks(chars: DataFrame, n_tax: int, b1: float = 0.5, b2: float = 0.85, b3: int = 8, b4: int = 10) -> DataFrame:
    """(first, last): conserved blocks by windowed rules: sites conserved in more than ``b1`` of the taxa, no run of more
    than ``b3`` others, flanks conserved in ``b2``, at least ``b4`` long, no site with a gap."""
    top = chars.where("ch <> '-'").groupBy("pos", "ch").agg(F.count("*").alias("n")).groupBy("pos").agg((F.max("n") / n_tax).alias("top"))
    gaps = chars.groupBy("pos").agg(F.max(F.col("ch") == "-").alias("gap"))
    s = gaps.join(top, "pos", "left").na.fill(0.0, ["top"])
    order = Window.orderBy("pos")
    ok = (F.col("top") > b1) & ~F.col("gap")
    s = s.withColumn("ok", ok).withColumn("run", F.sum((F.col("ok") != F.coalesce(F.lag("ok").over(order), ~F.col("ok"))).cast("int")).over(order))
    runs = s.groupBy("run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("ok").alias("ok"), F.max("gap").alias("gap"))
    wall = (~F.col("ok") & ((F.col("last") - F.col("first") + 1 > b3) | F.col("gap"))).cast("int")
    blocks = runs.withColumn("block", F.sum(wall).over(Window.orderBy("first"))).where(wall == 0)
    spans = blocks.groupBy("block").agg(F.min("first").alias("f"), F.max("last").alias("l"))
    edge = s.where((F.col("top") >= b2) & ~F.col("gap")).select("pos")
    flanked = spans.join(edge, (F.col("pos") >= F.col("f")) & (F.col("pos") <= F.col("l"))).groupBy("block").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return flanked.where(F.col("last") - F.col("first") + 1 >= b4).select("first", "last")
