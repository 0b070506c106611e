"""Tests of trees by resampling site log likelihoods: draws as matrices, by blocks of sites.

``site_log_likes`` has a row (tree_id, pos, ln) for each tree and site or pattern; with a column n, that many sites are
alike.  A replicate draws all sites with replacement, so the numbers of times that patterns come are multinomial.  Blocks
of patterns share a replicate's draws by a multinomial of their own, and each block draws within: its weights by
replicate, times its log likelihoods by tree, are what it adds to each replicate.  No draw is ever a row.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Patterns of a block: with a thousand replicates, its weights are 32 MB.
PATTERNS_A_BLOCK = 4_096
#: Blocks at most, for the driver deals each replicate's draws to them; beyond, blocks grow.
MOST_BLOCKS = 4_096
#: Lengths of replicates, as shares of the sites, for the approximately unbiased test.
SCALES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4)
#: Replicates whose weights a task holds at once.
REPLICATES_AT_ONCE = 500


def resampled(site_log_likes: DataFrame, replicates: int, seed: int = 1, scales: tuple[float, ...] = (1.0,)) -> DataFrame:
    """(scale, rep, tree_id, x): each tree's log likelihood of each replicate of ``scale`` times the sites.

    Draws depend on seed, scale and the patterns alone, so lost executors draw the same again.  An empty table gives an
    empty table.
    """
    rows = site_log_likes if "n" in site_log_likes.columns else site_log_likes.withColumn("n", F.lit(1))
    rows = rows.select("tree_id", "pos", F.col("ln").cast("double").alias("ln"), F.col("n").cast("long").alias("n"))
    found = rows.agg(F.approx_count_distinct("pos")).first()[0]
    blocks = max(1, min(MOST_BLOCKS, found // PATTERNS_A_BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int"))
    # A row a block.  Any tree tells how many sites a block has; each has all of them.
    first = dealt.groupBy("block", "tree_id").agg(F.sum("n").alias("n")).groupBy("block").agg(F.min("n").alias("n"), F.max("n").alias("most"))
    sizes = sorted(map(tuple, first.collect()))
    if any(n != most for _, n, most in sizes):
        raise ValueError("trees have different sites")
    total = sum(n for _, n, _ in sizes)
    shares, place = np.array([n for _, n, _ in sizes], float) / max(total, 1), {b: k for k, (b, _, _) in enumerate(sizes)}
    # By scale, replicates x blocks: how many of a replicate's sites each block draws.
    draws = [np.random.default_rng([seed, k]).multinomial(round(s * total), shares, replicates) if sizes else None for k, s in enumerate(scales)]

    def draw(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # By place of the pattern, and of the tree: the same order at each run.
        wide = group.pivot(index=["pos", "n"], columns="tree_id", values="ln").sort_index()
        ln, n = wide.to_numpy(), wide.index.get_level_values("n").to_numpy()
        out = []
        for k, scale in enumerate(scales):
            rng, many = np.random.default_rng([seed, k, key[0]]), draws[k][:, place[key[0]]]
            for at in range(0, replicates, REPLICATES_AT_ONCE):
                x = rng.multinomial(many[at : at + REPLICATES_AT_ONCE], n / n.sum()) @ ln
                rep = np.arange(at, at + len(x))
                out.append(pd.DataFrame({"scale": scale, "rep": np.repeat(rep, x.shape[1]), "tree_id": np.tile(wide.columns.to_numpy(), len(x)), "x": x.ravel()}))
        return pd.concat(out)

    kind = rows.schema["tree_id"].dataType.simpleString()
    parts = dealt.groupBy("block").applyInPandas(draw, f"scale double, rep int, tree_id {kind}, x double")
    return parts.groupBy("scale", "rep", "tree_id").agg(F.sum("x").alias("x"))


def totals(site_log_likes: DataFrame) -> DataFrame:
    """(tree_id, log_like) over all sites."""
    ln = F.col("ln") * F.col("n") if "n" in site_log_likes.columns else F.col("ln")
    return site_log_likes.groupBy("tree_id").agg(F.sum(ln).alias("log_like"))


def kh_sh(boot: DataFrame, trees: DataFrame) -> DataFrame:
    """(tree_id, log_like, kh, sh) of replicates (rep, tree_id, x) and ``totals``: p values of the two tests."""
    centred = boot.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy("tree_id")))
    # A row: the best tree.
    first = trees.orderBy(F.desc("log_like"), "tree_id").limit(1).select(F.col("tree_id").alias("best"), F.col("log_like").alias("best_log_like"))
    by_rep = Window.partitionBy("rep")
    told = centred.crossJoin(F.broadcast(first)).withColumns({"top": F.max("c").over(by_rep), "cb": F.max(F.when(F.col("tree_id") == F.col("best"), F.col("c"))).over(by_rep)})
    judged = told.join(trees, "tree_id").withColumn("delta", F.col("best_log_like") - F.col("log_like"))
    p = lambda c: F.avg((F.col(c) - F.col("c") >= F.col("delta")).cast("int"))
    return judged.groupBy("tree_id").agg(F.first("log_like").alias("log_like"), p("cb").alias("kh"), p("top").alias("sh"))


def wins(boot: DataFrame) -> DataFrame:
    """(tree_id, scale, won, n): in how many of a scale's replicates a tree is the best one, ties to the first, of how many."""
    best = boot.groupBy("scale", "rep").agg(F.min_by("tree_id", F.struct(-F.col("x"), "tree_id")).alias("tree_id"))
    n = best.groupBy("scale").agg(F.count("*").alias("n"))
    every = boot.select("tree_id").distinct().crossJoin(F.broadcast(n))
    return every.join(best.groupBy("tree_id", "scale").agg(F.count("*").alias("won")), ["tree_id", "scale"], "left").na.fill(0, ["won"]).select("tree_id", "scale", "won", "n")


def au_p(scale: np.ndarray, won: np.ndarray, n: np.ndarray) -> float:
    """The approximately unbiased p value from the bootstrap probabilities at several scales.

    Their normal quantiles are d x sqrt(scale) + c / sqrt(scale), of the signed distance d and the curvature c of the
    region in which the tree is best: both by least squares, weighted by the quantiles' variances; p is that of d - c.
    """
    normal, p = NormalDist(), won / n
    use = (won > 0) & (won < n)
    if use.sum() < 2:
        # Never or always the best, whatever the scale.
        return float(p.mean())
    z = np.array([-normal.inv_cdf(x) for x in p[use]])
    weight = n[use] * np.array([normal.pdf(x) for x in z]) ** 2 / (p[use] * (1 - p[use]))
    root = np.sqrt(scale[use])
    x = np.stack([root, 1 / root], 1) * np.sqrt(weight)[:, None]
    (d, c), *_ = np.linalg.lstsq(x, z * np.sqrt(weight), rcond=None)
    return 1 - normal.cdf(d - c)


def tree_tests(site_log_likes: DataFrame, replicates: int = 1000, seed: int = 1, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """(tree_id, log_like, kh, sh, bp, au): tests of trees of site log likelihoods (tree_id, pos, ln, n if patterns).

    kh, sh: p values of the two tests on replicates of all sites; bp: the share of those in which the tree is best; au:
    the approximately unbiased test, from replicates of each of ``scales``.
    """
    if 1.0 not in scales:
        scales = (*scales, 1.0)
    # Worked out once: likelihoods cost more than what is drawn from them.
    site_log_likes = cut(site_log_likes)
    trees = totals(site_log_likes)
    boot = resampled(site_log_likes, replicates, seed, scales).persist()
    won = wins(boot)
    kind = trees.schema["tree_id"].dataType.simpleString()

    def judge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p = au_p(*(g[c].to_numpy(float) for c in ("scale", "won", "n")))
        return pd.DataFrame([(key[0], float((g["won"] / g["n"])[g["scale"] == 1.0].iloc[0]), p)], columns=["tree_id", "bp", "au"])

    shares = won.groupBy("tree_id").applyInPandas(judge, f"tree_id {kind}, bp double, au double")
    return kh_sh(boot.where("scale = 1"), trees).join(shares, "tree_id")

