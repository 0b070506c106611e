"""Statistics by site and by taxon over an alignment in long form: ``chars`` (tax, pos, ch).

Gap is ``-``, missing ``?``; ``symbols`` are the states, ``ambiguities`` maps other characters to those they may be.
Each operator is one or two aggregations keyed by site or taxon, combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DNA = "acgt"


def is_symbol(symbols: str = DNA) -> Column:
    return F.col("ch").isin(*symbols)


def is_gap() -> Column:
    return F.col("ch").isin("-", "?")


def char_counts(chars: DataFrame, *by: str, symbols: str = DNA) -> DataFrame:
    """(by..., ch, n): how often each symbol occurs, overall or by the given columns."""
    return chars.where(is_symbol(symbols)).groupBy(*by, "ch").agg(F.count("*").alias("n"))


def site_summary(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(pos, n_tax, n_sym, n_gap, n_ambig, n_kinds, low): one pass for every mask that looks at a whole column.

    n_kinds: different symbols; low: the count of the rarest symbol present.
    """
    counts = [F.count_if(F.col("ch") == s).alias(f"_{i}") for i, s in enumerate(symbols)]
    wide = chars.groupBy("pos").agg(F.count("*").alias("n_tax"), F.count_if(is_gap()).alias("n_gap"), *counts)
    each = F.array(*[F.col(f"_{i}") for i in range(len(symbols))])
    present = F.filter(each, lambda x: x > 0)
    wide = wide.withColumns({"n_sym": F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), "n_kinds": F.size(present), "low": F.coalesce(F.array_min(present), F.lit(0))})
    return wide.select("pos", "n_tax", "n_sym", "n_gap", (F.col("n_tax") - F.col("n_sym") - F.col("n_gap")).alias("n_ambig"), "n_kinds", "low")


def site_entropy(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(pos, entropy): Shannon entropy in bits over the symbols of each site that has any."""
    n = char_counts(chars, "pos", symbols=symbols)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("pos"))
    return n.withColumn("p", p).groupBy("pos").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def entropy_mean_variance(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(mean, variance): of the sites' entropies; sample variance."""
    return site_entropy(chars, symbols).agg(F.avg("entropy").alias("mean"), F.var_samp("entropy").alias("variance"))


def simple_constant_mask(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(pos, keep): at most one symbol and no ambiguity; gaps don't count, sites of gaps alone are left out."""
    return site_summary(chars, symbols).where("n_gap < n_tax").select("pos", ((F.col("n_kinds") <= 1) & (F.col("n_ambig") == 0)).alias("keep"))


def constant_mask(chars: DataFrame, ambiguities: dict[str, str], symbols: str = DNA) -> DataFrame:
    """(pos, keep): some symbol agrees with every character that is no gap; a site of gaps alone is constant.

    Characters are sets of symbols in the bits of a number, so the test is one ``bit_and``.
    """
    bit = {s: 1 << i for i, s in enumerate(symbols)}
    value = bit | {a: sum(bit[s] for s in of) for a, of in ambiguities.items()}
    mask = F.lit((1 << len(symbols)) - 1)
    for ch, b in value.items():
        mask = F.when(F.col("ch") == ch, F.lit(b)).otherwise(mask)
    return chars.groupBy("pos").agg((F.bit_and(mask) != 0).alias("keep"))


def invariant_symbols(chars: DataFrame, ambiguities: dict[str, str], symbols: str = DNA) -> DataFrame:
    """(pos, states): the symbols, as bits in their order, that all taxa may have at a site."""
    bit = {s: 1 << i for i, s in enumerate(symbols)}
    value = bit | {a: sum(bit[s] for s in of) for a, of in ambiguities.items()}
    mask = F.lit((1 << len(symbols)) - 1)
    for ch, b in value.items():
        mask = F.when(F.col("ch") == ch, F.lit(b)).otherwise(mask)
    return chars.groupBy("pos").agg(F.bit_and(mask).cast("long").alias("states"))


def gapped_mask(chars: DataFrame) -> DataFrame:
    return chars.groupBy("pos").agg(F.max(F.col("ch") == "-").alias("keep"))


def all_gaps_mask(chars: DataFrame, and_missing: bool = True) -> DataFrame:
    return chars.groupBy("pos").agg(F.min(is_gap() if and_missing else F.col("ch") == "-").alias("keep"))


def enough_chars_mask(chars: DataFrame, per_cent: float = 85, symbols: str = DNA) -> DataFrame:
    return site_summary(chars, symbols).select("pos", (F.col("n_sym") >= per_cent * 0.01 * F.col("n_tax")).alias("keep"))


def autapomorphy_mask(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(pos, keep): just two symbols, one of them in a single taxon."""
    return site_summary(chars, symbols).select("pos", ((F.col("n_kinds") == 2) & (F.col("low") == 1)).alias("keep"))


def diversity_mask(chars: DataFrame, diversity: int = 1, symbols: str = DNA) -> DataFrame:
    return site_summary(chars, symbols).select("pos", (F.col("n_kinds") == diversity).alias("keep"))


def no_gaps_or_ambiguities_mask(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    return site_summary(chars, symbols).select("pos", (F.col("n_sym") == F.col("n_tax")).alias("keep"))


def informative_mask(chars: DataFrame, missing: str = "-?nx", symbols: str = DNA) -> DataFrame:
    """(pos, keep): sites that may bear on the topology.

    Without ambiguities: three symbols or more, or two of which neither is single; with gaps, more than two taxa must
    have symbols.  With a single ambiguity and no gap, a site of one symbol tells nothing; all other ambiguous ones may.
    """
    s = site_summary(chars.withColumn("ch", F.when(F.col("ch").isin(*missing), "-").otherwise(F.col("ch"))), symbols)
    varied = (F.col("n_kinds") > 2) | ((F.col("n_kinds") == 2) & (F.col("low") > 1))
    keep = F.when(F.col("n_ambig") == 0, varied & ((F.col("n_gap") == 0) | (F.col("n_sym") > 2))).when((F.col("n_gap") == 0) & (F.col("n_ambig") == 1), F.col("n_kinds") > 1).otherwise(True)
    return s.select("pos", keep.alias("keep"))


def char_diversity(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    return site_summary(chars, symbols).select("pos", F.col("n_kinds").cast("long").alias("diversity"))


def diversity_distribution(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(diversity, n): number of sites with each count of different symbols, zero included."""
    every = chars.sparkSession.range(len(symbols) + 1).withColumnRenamed("id", "diversity")
    n = char_diversity(chars, symbols).groupBy("diversity").agg(F.count("*").alias("n"))
    return every.join(n, "diversity", "left").select("diversity", F.coalesce("n", F.lit(0)).alias("n"))


def mean_chars_per_site(chars: DataFrame, include_constant: bool = True, skip_all_gap: bool = True, symbols: str = DNA) -> DataFrame:
    """(mean): different symbols a site; sites of gaps alone are left out, or count as zero."""
    d = char_diversity(chars, symbols)
    if skip_all_gap:
        d = d.where("diversity > 0")
    if not include_constant:
        d = d.where("diversity <> 1")
    return d.agg(F.avg("diversity").alias("mean"))


def constant_sites(chars: DataFrame, ambiguities: dict[str, str], symbols: str = DNA) -> DataFrame:
    """(n, proportion): sites of the constant mask."""
    return constant_mask(chars, ambiguities, symbols).agg(F.count_if("keep").alias("n"), (F.count_if("keep") / F.count("*")).alias("proportion"))


def simple_constant_sites(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    return site_summary(chars, symbols).agg(F.count_if(F.col("n_kinds") == 1).alias("n"))


def site_patterns(chars: DataFrame) -> DataFrame:
    """(pattern, n, first_pos): different columns, with how often and where first."""
    column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tax", "ch"))), lambda x: x["ch"]), "")
    return chars.groupBy("pos").agg(column.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def unconstrained_log_like(chars: DataFrame) -> DataFrame:
    """(log_like): sum of n ln n over the patterns, less N ln N.  Gaps and ambiguities make it meaningless: leave them out."""
    return site_patterns(chars).agg((F.sum(F.col("n") * F.log("n")) - F.sum("n") * F.log(F.sum("n"))).alias("log_like"))


def sequence_sites(chars: DataFrame) -> DataFrame:
    return chars.groupBy("tax").agg(F.count_if(~is_gap()).alias("n_sites"))


def covarion_stats(chars: DataFrame, group_a: list[int], group_b: list[int]) -> DataFrame:
    """(kind, n): sites alike in both groups (1: the same character, 2: another), in the first only (3), the second only (4), neither (5).

    Gaps are characters like any other.
    """
    of = lambda g: F.col("tax").isin(*g)
    ends = [f(F.when(of(g), F.col("ch"))).alias(n) for g, a in ((group_a, "a"), (group_b, "b")) for f, n in ((F.min, f"{a}0"), (F.max, f"{a}1"))]
    kind = F.when((F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1")), F.when(F.col("a0") == F.col("b0"), 1).otherwise(2)).when(F.col("a0") == F.col("a1"), 3).when(F.col("b0") == F.col("b1"), 4).otherwise(5)
    found = chars.groupBy("pos").agg(*ends).groupBy(kind.cast("long").alias("kind")).agg(F.count("*").alias("n"))
    return chars.sparkSession.range(1, 6).withColumnRenamed("id", "kind").join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def composition(chars: DataFrame, ambiguities: dict[str, str], symbols: str = DNA, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ch, p): mean composition of the sequences, weighted by their sites without gap.

    In each sequence an ambiguity is shared among its symbols in proportion to their own frequencies, to a fixed point.
    Only counts of characters by sequence reach Python, never sites.
    """
    counts = chars.where(~is_gap()).groupBy(*by, "tax", "ch").agg(F.count("*").alias("n"))
    names = [*by, "tax"]

    def share(group: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(group["ch"], group["n"]))
        own = np.array([n.get(s, 0) for s in symbols], float)
        sets = [(n.get(a, 0), np.array([s in of for s in symbols], float)) for a, of in ambiguities.items() if n.get(a, 0)]
        sets += [(n[c], np.ones(len(symbols))) for c in "nx" if c not in ambiguities and n.get(c, 0)]
        total, p = own.sum() + sum(k for k, _ in sets), np.full(len(symbols), 1.0 / len(symbols))
        for _ in range(1000):
            now = own + sum((k * m * p / max((m * p).sum(), 1e-300) for k, m in sets), np.zeros(len(symbols)))
            now = now / total
            if np.abs(now - p).sum() < 1e-12:
                break
            p = now
        return pd.DataFrame({**{c: group[c].iloc[0] for c in names}, "ch": list(symbols), "w": now * total})

    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in names)
    shares = counts.groupBy(*names).applyInPandas(share, f"{kinds}, ch string, w double")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return shares.groupBy(*by, "ch").agg(F.sum("w").alias("w")).select(*by, "ch", (F.col("w") / F.sum("w").over(whole)).alias("p"))


def duplicate_sequences(sequences: DataFrame) -> DataFrame:
    """(tax, first): sequences (tax, seq) that an earlier taxon has too, with the first such."""
    first = F.min("tax").over(Window.partitionBy(F.xxhash64("seq"), "seq"))
    return sequences.select("tax", first.alias("first")).where("tax > first")


def blank_sequences(chars: DataFrame) -> DataFrame:
    return chars.groupBy("tax").agg(F.min(is_gap()).alias("blank")).where("blank").select("tax")


def sequences(chars: DataFrame) -> DataFrame:
    """(tax, seq): the alignment's rows as strings."""
    return chars.groupBy("tax").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("seq"))


def x_squared(counts: DataFrame) -> DataFrame:
    """(x_squared, dof) of a table in long form (r, c, n); cells that are missing are zero."""
    rows, columns = counts.groupBy("r").agg(F.sum("n").alias("nr")), counts.groupBy("c").agg(F.sum("n").alias("nc"))
    cells = rows.crossJoin(F.broadcast(columns)).join(counts.groupBy("r", "c").agg(F.sum("n").alias("n")), ["r", "c"], "left")
    total = F.sum("nr").over(Window.partitionBy("c"))
    e = F.col("nr") * F.col("nc") / total
    o = F.coalesce("n", F.lit(0))
    cells = cells.withColumn("x", (o - e) * (o - e) / e)
    return cells.agg(F.sum("x").alias("x_squared"), ((F.count_distinct("r") - 1) * (F.count_distinct("c") - 1)).alias("dof"))


def composition_chi_squared(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(x_squared, dof) of the taxon by symbol counts."""
    return x_squared(char_counts(chars, "tax", symbols=symbols).select(F.col("tax").alias("r"), F.col("ch").alias("c"), "n"))


def composition_chi_squared_rows(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(tax, x_squared): each taxon's part of the statistic."""
    n = char_counts(chars, "tax", symbols=symbols)
    taxa, columns = n.groupBy("tax").agg(F.sum("n").alias("nr")), n.groupBy("ch").agg(F.sum("n").alias("nc"))
    cells = taxa.crossJoin(F.broadcast(columns)).join(n, ["tax", "ch"], "left")
    e = F.col("nr") * F.col("nc") / F.sum("nr").over(Window.partitionBy("ch"))
    o = F.coalesce("n", F.lit(0))
    return cells.withColumn("x", (o - e) * (o - e) / e).groupBy("tax").agg(F.sum("x").alias("x_squared"))


def simple_big_x_squared(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(x_squared): against the mean count of each symbol; for alignments without gaps and ambiguities."""
    n = char_counts(chars, "tax", symbols=symbols).groupBy("tax").pivot("ch", list(symbols)).agg(F.sum("n")).na.fill(0)
    long = n.select("tax", F.explode(F.create_map(*[x for s in symbols for x in (F.lit(s), F.col(s))])).alias("ch", "n"))
    e = F.avg("n").over(Window.partitionBy("ch"))
    return long.withColumn("e", e).where("e > 0").agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("x_squared"))


def composition_report(chars: DataFrame, parts: DataFrame, symbols: str = DNA) -> DataFrame:
    """(part, tax, level, n, and each symbol's share): composition by part and taxon, by part, and of all, in one pass.

    ``parts``: (pos, part).  level: 0 for a taxon in a part, 1 for a part, 3 for all; what a row sums over is null there.
    """
    told = chars.where(F.col("ch").isin(list(symbols))).join(parts, "pos")
    shares = [(F.count_if(F.col("ch") == c) / F.count("*")).alias(c) for c in symbols]
    return told.rollup("part", "tax").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *shares).select("part", "tax", "level", "n", *symbols)
