"""All-pairs comparisons of taxa: joins on site with tax a below tax b, so each pair meets once a site."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkclade.functions.stats import chi_squared_tail, chi_squared_tail_np

from .recode import numbered
from .sites import DNA, char_counts, is_symbol


def site_pairs(chars: DataFrame) -> DataFrame:
    """(i, j, pos, a, b) for i < j."""
    left = chars.select("pos", F.col("tax").alias("i"), F.col("ch").alias("a"))
    right = chars.select("pos", F.col("tax").alias("j"), F.col("ch").alias("b"))
    return left.join(right, "pos").where("i < j")


def p_distances(chars: DataFrame, ignore_gaps: bool = True, by_compared: bool = True) -> DataFrame:
    """(i, j, d): share of sites at which two taxa differ.

    Only ``-`` is a gap.  Pairs without a site in common are at distance 1.  Without ``by_compared`` the divisor is the
    whole length.
    """
    both = (F.col("a") != "-") & (F.col("b") != "-") if ignore_gaps else F.lit(True)
    n = F.count_if(both) if by_compared else F.count("*")
    return site_pairs(chars).groupBy("i", "j").agg(F.when(F.count_if(both) == 0, 1.0).otherwise(F.count_if(both & (F.col("a") != F.col("b"))) / n).alias("d"))


def pair_counts(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(i, j, a, b, n): how often symbol a in taxon i stands over b in j."""
    return site_pairs(chars.where(is_symbol(symbols))).groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))


def composition_distances(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(i, j, d): Euclidean distance of the compositions."""
    n = char_counts(chars, "tax", symbols=symbols)
    p = n.select("tax", "ch", (F.col("n") / F.sum("n").over(Window.partitionBy("tax"))).alias("p"))
    taxa = p.select("tax").distinct()
    kinds = p.select("ch").distinct()
    full = taxa.crossJoin(F.broadcast(kinds)).join(p, ["tax", "ch"], "left").na.fill(0.0, ["p"])
    left, right = full.select("ch", F.col("tax").alias("i"), F.col("p").alias("a")), full.select("ch", F.col("tax").alias("j"), F.col("p").alias("b"))
    return left.join(right, "ch").where("i < j").groupBy("i", "j").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("d"))


def bowker(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(i, j, q, dof): Bowker's statistic of symmetry; cells that are empty both ways don't count."""
    n = pair_counts(chars, symbols)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    off = n.where("a <> b").groupBy("i", "j", low.alias("x"), high.alias("y")).agg(F.sum(F.when(F.col("a") < F.col("b"), F.col("n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("a") > F.col("b"), F.col("n")).otherwise(0)).alias("v"))
    q = off.groupBy("i", "j").agg(F.sum((F.col("u") - F.col("v")) * (F.col("u") - F.col("v")) / (F.col("u") + F.col("v"))).alias("q"), F.count("*").alias("dof"))
    return n.select("i", "j").distinct().join(q, ["i", "j"], "left").na.fill(0.0, ["q"]).na.fill(0, ["dof"])


def matched_pairs(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(i, j, qb, qs, qr, pb, ps, pr): Bowker's, Stuart's and the internal test with their tails; null where singular."""
    dim = len(symbols)

    def test(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros((dim, dim))
        f[[symbols.index(x) for x in g["a"]], [symbols.index(x) for x in g["b"]]] = g["n"]
        s, off = f + f.T, np.triu_indices(dim, 1)
        used = s[off] > 0
        qb, dof = float((((f - f.T)[off] ** 2)[used] / s[off][used]).sum()), int(used.sum())
        d = (f.sum(1) - f.sum(0))[:-1]
        v = np.diag(f.sum(1) + f.sum(0) - 2 * np.diag(f)) - (s - np.diag(np.diag(s)))
        try:
            qs = float(d @ np.linalg.solve(v[:-1, :-1], d))
        except np.linalg.LinAlgError:
            qs = None
        tail = lambda x, k: chi_squared_tail_np(x, k) if x is not None and k > 0 else None
        qr = None if qs is None else qb - qs
        return pd.DataFrame([(*key, qb, qs, qr, tail(qb, dof), tail(qs, dim - 1), tail(qr, dof - dim + 1))], columns=["i", "j", "qb", "qs", "qr", "pb", "ps", "pr"])

    n = pair_counts(chars, symbols)
    kind = n.schema["i"].dataType.simpleString()
    return n.groupBy("i", "j").applyInPandas(test, f"i {kind}, j {kind}, qb double, qs double, qr double, pb double, ps double, pr double")


def most_divergent_pair(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """The row of ``matched_pairs`` of the pair with the largest p-distance, ties by taxon."""
    d = p_distances(chars.where(is_symbol(symbols))).orderBy(F.desc("d"), "i", "j").limit(1).select("i", "j", "d")
    return matched_pairs(chars, symbols).join(F.broadcast(d), ["i", "j"])


def overall_marginal_symmetry(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(q, dof, p): marginal symmetry over all taxa at once, from the taxon by symbol counts at sites of symbols only."""
    n_tax = chars.select("tax").distinct().count()
    whole = chars.where(is_symbol(symbols)).groupBy("pos").agg(F.collect_list(F.struct("tax", "ch")).alias("column")).where(F.size("column") == n_tax)
    pattern = F.array_join(F.transform(F.array_sort("column"), lambda x: x["ch"]), "")
    found = whole.groupBy(pattern.alias("pattern")).agg(F.count("*").cast("double").alias("n"))
    free = len(symbols) - 1

    def gather(frames):
        # Sum and cross products of the indicator vectors of all taxa: a fixed size, whatever the number of sites.
        d = n_tax * free
        total, cross, n = np.zeros(d), np.zeros((d, d)), 0.0
        for f in frames:
            for pattern, k in zip(f["pattern"], f["n"]):
                x = np.zeros(d)
                for t, c in enumerate(pattern):
                    if (at := symbols.index(c)) < free:
                        x[t * free + at] = 1
                total, n = total + k * x, n + k
                cross += k * np.outer(x, x)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "cross": [cross.ravel().tolist()]})

    parts = found.mapInPandas(gather, "n double, total array<double>, cross array<double>").toPandas()
    d = n_tax * free
    n, total = parts["n"].sum(), np.sum(parts["total"].tolist(), axis=0)
    cross = np.sum(parts["cross"].tolist(), axis=0).reshape(d, d)
    lift = np.kron(np.eye(n_tax)[:-1] - np.eye(n_tax)[1:], np.eye(free))
    v = lift @ (cross - np.outer(total, total) / n) @ lift.T
    u = lift @ total
    try:
        q = float(u @ np.linalg.solve(v, u))
    except np.linalg.LinAlgError:
        q = None
    return chars.sparkSession.createDataFrame([(q, free * (n_tax - 1))], "q double, dof int").withColumn("p", chi_squared_tail("q", "dof"))


def log_det(chars: DataFrame, symbols: str = DNA) -> DataFrame:
    """(i, j, d): LogDet (paralinear) distance from the divergence matrices of symbols; null where undefined."""
    dim = len(symbols)

    def of(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        f = np.zeros((dim, dim))
        f[[symbols.index(x) for x in g["a"]], [symbols.index(x) for x in g["b"]]] = g["n"]
        f /= f.sum()
        top, below = np.linalg.det(f), np.prod(f.sum(0)) * np.prod(f.sum(1))
        d = -(np.log(top) - 0.5 * np.log(below)) / dim if top > 0 and below > 0 else None
        return pd.DataFrame([(*key, d)], columns=["i", "j", "d"])

    n = pair_counts(chars, symbols)
    kind = n.schema["i"].dataType.simpleString()
    return n.groupBy("i", "j").applyInPandas(of, f"i {kind}, j {kind}, d double")


def rate_matrix_from_pairs(chars: DataFrame, symbols: str = DNA) -> np.ndarray:
    """Exchange rates (last one 1) from the logarithm of the mean substitution matrix of all pairs."""
    rows = pair_counts(chars, symbols).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    f = np.zeros((len(symbols),) * 2)
    for r in rows:
        f[symbols.index(r.a), symbols.index(r.b)] += r.n
    f = (f + f.T) / (2 * f.sum())
    pi = f.sum(1)
    val, vec = np.linalg.eig(f / pi[:, None])
    q = (vec @ np.diag(np.log(np.maximum(val.real, 1e-12))) @ np.linalg.inv(vec)).real
    r = q / pi[None, :]
    r = (r + r.T) / 2
    upper = np.triu_indices(len(symbols), 1)
    return np.maximum(r[upper] / r[upper][-1], 1e-13)


def flat_triangle(distances: DataFrame, upper: bool = True) -> DataFrame:
    """(k, d): one triangle of a symmetric distance table (i, j, d) as a numbered vector, by rows."""
    d = distances.select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "d").where("lo < hi")
    order = ("lo", "hi") if upper else ("hi", "lo")
    below = Window.partitionBy(order[0]).orderBy(order[1])
    rows = d.groupBy(order[0]).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.withColumn("own", F.row_number().over(below)).join(rows, order[0]).select((F.col("ahead") + F.col("own") - 1).alias("k"), "d")


def bootstrap(chars: DataFrame, n_sites: int, replicates: int, seed: int = 1, part: DataFrame | None = None) -> DataFrame:
    """(replicate, new_pos, tax, ch): sites drawn with replacement, within their partition if ``part`` (pos, subset) is given.

    Draws are hashes of seed, replicate and place, so a lost executor draws the same again.  Sites are numbered 0 to
    ``n_sites`` - 1 by their order.
    """
    sites = chars.select("pos").distinct()
    sites = sites.withColumn("subset", F.lit("all")) if part is None else sites.join(part, "pos")
    # A row a subset.
    many = sites.groupBy("subset").agg(F.count("*").alias("m"))
    sites = numbered(sites.select("subset", "pos"), ("subset", "pos"), "subset").join(many, "subset")
    draw = sites.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "replicate", "subset", "k"), F.col("m"))
    picked = draw.select("replicate", "subset", F.col("pos").alias("new_pos"), drawn.alias("k"))
    return picked.join(sites.select("subset", "k", "pos"), ["subset", "k"]).join(chars, "pos").select("replicate", "new_pos", "tax", "ch")


def neighbour_joining(distances: DataFrame, weighed: bool = False) -> DataFrame:
    """(set, newick): the neighbour-joining tree of each set of a table (set, i, j, d); one task a set.

    ``weighed``: distances to a new node are weighed to the least variance (BIONJ), where plain joining takes the mean.
    """

    def join(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*g["i"], *g["j"]})
        at = {n: k for k, n in enumerate(names)}
        d = np.zeros((len(names),) * 2)
        for i, j, x in zip(g["i"], g["j"], g["d"]):
            d[at[i], at[j]] = d[at[j], at[i]] = x
        return pd.DataFrame([(key[0], nj_newick([str(n) for n in names], d, weighed))], columns=["set", "newick"])

    kind = distances.schema["set"].dataType.simpleString()
    return distances.groupBy("set").applyInPandas(join, f"set {kind}, newick string")


def nj_newick(names: list[str], d: np.ndarray, weighed: bool = False) -> str:
    """Saitou and Nei's joining, least Q first, ties by place; ``weighed``: Gascuel's variances, in proportion to distances."""
    labels, d = list(names), d.astype(float).copy()
    v = d.copy()
    while len(labels) > 3:
        n, r = len(labels), d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(int(np.argmin(q)), q.shape))
        a = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        share = 0.5
        if weighed and v[i, j] > 0:
            share = min(1.0, max(0.0, 0.5 + (v[j].sum() - v[i].sum()) / (2 * (n - 2) * v[i, j])))
        new = share * (d[i] - a) + (1 - share) * (d[j] - d[i, j] + a)
        label = f"({labels[i]}:{a:.10g},{labels[j]}:{d[i, j] - a:.10g})"
        keep = [k for k in range(n) if k not in (i, j)]
        joined = share * v[i] + (1 - share) * v[j] - share * (1 - share) * v[i, j]
        d, v = (np.block([[x[np.ix_(keep, keep)], y[keep][:, None]], [y[keep][None, :], np.zeros((1, 1))]]) for x, y in ((d, new), (v, joined)))
        labels = [labels[k] for k in keep] + [label]
    if len(labels) == 3:
        a, b, c = d[0, 1], d[0, 2], d[1, 2]
        return f"({labels[0]}:{(a + b - c) / 2:.10g},{labels[1]}:{(a + c - b) / 2:.10g},{labels[2]}:{(b + c - a) / 2:.10g});"
    return f"({','.join(f'{x}:{d[0, 1] / 2:.10g}' for x in labels)});" if len(labels) == 2 else f"{''.join(labels)};"
