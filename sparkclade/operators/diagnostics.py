"""Diagnostics of sampler output: ``samples`` (run, gen, value), one row a sample, by any grouping columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .resampling import kh_sh, resampled, totals

MAX_LAG = 1000


def summarize(samples: DataFrame, *by: str, skip: int = 0) -> DataFrame:
    """(by..., n, mean, variance) after the first ``skip`` samples of each group, by gen; sample variance."""
    kept = samples.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("gen"))).where(F.col("_k") > skip) if skip else samples
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))


def ess_of(gamma: np.ndarray, n: int) -> float:
    """Effective sample size of ``n`` samples from autocovariances at lags 0 on: pairs of lags are added while their sum is positive."""
    if not len(gamma):
        return float(n)
    zero = var = gamma[0]
    for k in range(2, len(gamma), 2):
        if gamma[k - 1] + gamma[k] <= 0:
            break
        var += 2 * (gamma[k - 1] + gamma[k])
    # Without variance there is no effective sample.
    return float(n * zero / var) if var > 0 else 0.0


def ess(x: np.ndarray) -> float:
    n, d = len(x), x - x.mean()
    return ess_of(np.array([d[: n - k] @ d[k:] / (n - k) for k in range(min(n // 3, MAX_LAG))]), n)


#: Samples of a block; each has those of the next block that its lags reach.
SAMPLES_A_BLOCK = 50_000


def effective_sample_size(samples: DataFrame, *by: str) -> DataFrame:
    """(by..., ess); lags are at most 1,000.

    Python sees a block of samples at a time: sums of lagged products add up over blocks.
    """
    w = Window.partitionBy(*by)
    x = samples.select(*by, "gen", "value").withColumns({"k": F.row_number().over(w.orderBy("gen")) - 1, "n": F.count("*").over(w), "d": F.col("value") - F.avg("value").over(w)})
    own = F.floor(F.col("k") / SAMPLES_A_BLOCK)
    reach = (F.col("k") % SAMPLES_A_BLOCK < MAX_LAG) & (own > 0)
    dealt_ = x.withColumn("block", F.explode(F.when(reach, F.array(own - 1, own)).otherwise(F.array(own)))).select(*by, "block", "k", "n", "d")

    def products(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, n = g.sort_values("k"), int(g["n"].iloc[0])
        d, most = g["d"].to_numpy(float), min(n // 3, MAX_LAG)
        size = min(len(d), SAMPLES_A_BLOCK)
        found = [float(d[: min(size, len(d) - lag)] @ d[lag : lag + min(size, len(d) - lag)]) if lag < len(d) else 0.0 for lag in range(most)]
        return pd.DataFrame({**{c: [v] * max(most, 1) for c, v in zip(by, key)}, "n": n, "lag": range(max(most, 1)), "s": found or [0.0]})

    kinds = "".join(f"{c} {samples.schema[c].dataType.simpleString()}, " for c in by)
    lags = dealt_.groupBy(*by, "block").applyInPandas(products, f"{kinds}n long, lag int, s double").groupBy(*by, "n", "lag").agg(F.sum("s").alias("s"))

    def fold(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, n = g.sort_values("lag"), int(g["n"].iloc[0])
        gamma = g["s"].to_numpy(float) / (n - g["lag"].to_numpy())
        return pd.DataFrame([(*key, ess_of(gamma[: min(n // 3, MAX_LAG)], n))], columns=[*by, "ess"])

    return lags.groupBy(*by).applyInPandas(fold, f"{kinds}ess double")


def autocovariances(samples: DataFrame, most: int, *by: str) -> DataFrame:
    """(by..., lag, gamma) for lags 0 to ``most`` by equi joins on the sample's number: any length of chain."""
    w = Window.partitionBy(*by)
    x = samples.withColumns({"k": F.row_number().over(w.orderBy("gen")), "d": F.col("value") - F.avg("value").over(w)}).select(*by, "k", "d")
    lags = x.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most))))
    other = x.select(*by, F.col("k").alias("k2"), F.col("d").alias("d2"))
    met = lags.withColumn("k2", F.col("k") + F.col("lag")).join(other, [*by, "k2"])
    return met.groupBy(*by, "lag").agg(F.avg(F.col("d") * F.col("d2")).alias("gamma"))


def histogram(values: DataFrame, bin_size: float, *by: str, value: str = "value") -> DataFrame:
    """(by..., bin, n): bin is the lower edge."""
    return values.groupBy(*by, (F.floor(F.col(value) / bin_size) * F.lit(bin_size)).alias("bin")).agg(F.count("*").alias("n"))


def nice_bin_size(low: float, high: float) -> float:
    """A step of 1, 2 or 5 by a power of ten that gives some tens of bins."""
    raw = max(high - low, 1e-300) / 20
    power = 10 ** np.floor(np.log10(raw))
    return float(next(p for p in (power, 2 * power, 5 * power, 10 * power) if p >= raw))


def log_mean_exp(samples: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(by..., log_mean): log of the mean of exp(x), about the greatest x."""
    top = samples.groupBy(*by).agg(F.max(value).alias("_m")) if by else samples.agg(F.max(value).alias("_m"))
    x = samples.join(top, list(by)) if by else samples.crossJoin(F.broadcast(top))
    out = x.groupBy(*by).agg((F.log(F.avg(F.exp(F.col(value) - F.col("_m")))) + F.first("_m")).alias("log_mean"))
    return out


def log_harmonic_mean(samples: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(by..., log_mean): log of the harmonic mean of exp(x)."""
    m = log_mean_exp(samples.withColumn(value, -F.col(value)), *by, value=value)
    return m.withColumn("log_mean", -F.col("log_mean"))


def stepping_stone(samples: DataFrame) -> DataFrame:
    """(run, log_marginal) of (run, beta, value): over the steps from each beta to the next, log mean of exp of the
    likelihood by the difference of the betas."""
    steps = samples.groupBy("run", "beta").agg(F.max("value").alias("top"))
    nxt = F.lead("beta").over(Window.partitionBy("run").orderBy("beta"))
    steps = steps.withColumn("step", nxt - F.col("beta")).where("step is not null")
    x = samples.join(steps, ["run", "beta"])
    each = x.groupBy("run", "beta", "step", "top").agg(F.avg(F.exp(F.col("step") * (F.col("value") - F.col("top")))).alias("m"))
    return each.groupBy("run").agg(F.sum(F.log("m") + F.col("step") * F.col("top")).alias("log_marginal"))


def lpml(site_likes: DataFrame) -> DataFrame:
    """(lpml) of (sample, pos, like): sum over sites of the log of the harmonic mean of their likelihoods."""
    return site_likes.groupBy("pos").agg((-F.log(F.avg(1 / F.col("like")))).alias("x")).agg(F.sum("x").alias("lpml"))


def newton_raftery(samples: DataFrame, delta: float = 0.1, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(log_marginal): the marginal likelihood with a share ``delta`` from the prior, to a fixed point.

    Each round is one aggregation; only its value goes to the driver.
    """
    x = samples.select("value").persist()
    row = x.agg(F.count("*"), F.max("value")).first()
    n, top = row[0], row[1]
    # Work relative to the greatest value, on the log scale: u is the log of the estimate less the greatest.
    l = F.exp(F.col("value") - top)

    def after(u: float) -> float:
        r = float(np.exp(u))
        w = delta * r + (1 - delta) * l
        a, b = x.agg(F.sum(l / w), F.sum(1 / w)).first()
        return float(np.log(delta * n / (1 - delta) + a) - np.log(delta * n / ((1 - delta) * r) + b))

    u = float(np.log(x.agg(F.avg(l)).first()[0]))
    for _ in range(rounds):
        # Steffensen's step: two rounds give the limit of a geometric approach.
        one = after(u)
        two = after(one)
        bend = two - 2 * one + u
        jump = (one - u) ** 2 / bend if abs(bend) > 1e-12 else 0.0
        new = u - jump if 0 < abs(jump) < 10 * abs(one - u) else two
        done, u = abs(new - u) <= tolerance, new
        if done or abs(one - u) <= tolerance:
            break
    x.unpersist()
    return samples.sparkSession.createDataFrame([(u + top,)], "log_marginal double")


def acceptance(proposals: DataFrame) -> DataFrame:
    """(proposal, temp, proposed, accepted, rate) of (proposal, temp, accepted)."""
    return proposals.groupBy("proposal", "temp").agg(F.count("*").alias("proposed"), F.count_if("accepted").alias("accepted")).withColumn("rate", F.col("accepted") / F.col("proposed"))


def rell(site_log_likes: DataFrame, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """(tree_id, log_like, kh, sh): tests of trees by resampling estimated log likelihoods of (tree_id, pos, ln).

    With a column n, a row stands for that many sites.
    """
    site_log_likes = cut(site_log_likes)
    return kh_sh(resampled(site_log_likes, replicates, seed).persist(), totals(site_log_likes))
