"""Resampling by blocks of patterns against moments, closed forms and expansion into sites."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclade.operators import pairs, recode, resampling


def likes(spark, ln, n):
    """``ln``: trees x patterns."""
    return spark.createDataFrame([(t, f"p{k}", float(x), int(n[k])) for t, row in enumerate(ln) for k, x in enumerate(row)], "tree_id int, pos string, ln double, n int")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    ln = np.log(rng.uniform(0.01, 1, (3, 60)))
    return ln, rng.integers(1, 9, 60)


def test_moments_over_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(resampling, "PATTERNS_A_BLOCK", 7)
    monkeypatch.setattr(resampling, "REPLICATES_AT_ONCE", 300)
    ln, n = data
    table = likes(spark, ln, n)
    out = resampling.resampled(table.repartition(5), 2000, scales=(1.0, 0.5)).collect()
    again = {tuple(r) for r in resampling.resampled(table.repartition(2), 2000, scales=(1.0, 0.5)).collect()}
    assert {(r.scale, r.rep, r.tree_id, round(r.x, 6)) for r in out} == {(s, k, t, round(x, 6)) for s, k, t, x in again}
    total = n.sum()
    mean, var = ln @ n / total, (ln**2) @ n / total - (ln @ n / total) ** 2
    for scale in (1.0, 0.5):
        m = round(scale * total)
        for t in range(3):
            x = np.array([r.x for r in out if r.scale == scale and r.tree_id == t])
            assert len(x) == 2000 and abs(x.mean() - m * mean[t]) < 4 * math.sqrt(m * var[t] / 2000) and abs(x.var() / (m * var[t]) - 1) < 0.15
    a, b = (np.array([r.x for r in sorted(out, key=lambda r: r.rep) if r.scale == 1 and r.tree_id == t]) for t in (0, 1))
    cov = (ln[0] * ln[1]) @ n / total - mean[0] * mean[1]
    assert abs(np.cov(a, b)[0, 1] / total - cov) < 0.15 * math.sqrt(var[0] * var[1])


def test_two_trees_have_closed_p_values(spark):
    """The difference of two trees is one sum, and all tests of the worse one tell its normal tail."""
    rng = np.random.default_rng(2)
    ln = np.stack([np.full(200, -2.0), -2.0 - rng.normal(0.02, 0.5, 200)])
    n = np.full(200, 5)
    diff = ln[0] - ln[1]
    z = diff @ n / math.sqrt(n.sum() * ((diff**2) @ n / n.sum() - (diff @ n / n.sum()) ** 2))
    tail = 1 - NormalDist().cdf(abs(z))
    got = {r.tree_id: r for r in resampling.tree_tests(likes(spark, ln, n), 2000).collect()}
    best = 0 if z > 0 else 1
    worse = got[1 - best]
    assert got[best].kh == got[best].sh == 1
    for p in (worse.kh, worse.sh, worse.bp, worse.au):
        assert abs(p - tail) < 0.04
    assert abs(got[best].au - (1 - tail)) < 0.04 and abs(got[best].log_like - ln[best] @ n) < 1e-6


@pytest.mark.parametrize("d, c", [(0.5, 0.2), (1.5, 0.3), (-0.4, -0.1)])
def test_unbiased_p_of_exact_probabilities(d, c):
    scale = np.array(resampling.SCALES)
    p = 1 - np.array([NormalDist().cdf(d * math.sqrt(s) + c / math.sqrt(s)) for s in scale])
    n = np.full(len(scale), 1e6)
    assert abs(resampling.au_p(scale, p * n, n) - (1 - NormalDist().cdf(d - c))) < 1e-6
    assert resampling.au_p(scale, n * 0, n) == 0 and resampling.au_p(scale, n, n) == 1


def test_patterns_stand_for_their_sites(spark, data):
    ln, n = data
    sites = likes(spark, ln, n).withColumn("pos", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat_ws(":", "pos", k)))).drop("n")
    a, b = ({r.tree_id: r.x for r in resampling.resampled(t, 3000).groupBy("tree_id").agg(F.variance("x").alias("x")).collect()} for t in (likes(spark, ln, n), sites))
    assert all(abs(a[t] / b[t] - 1) < 0.15 for t in a)
    assert {r.tree_id: round(r.log_like, 6) for r in resampling.totals(sites).collect()} == {t: round(float(ln[t] @ n), 6) for t in range(3)}


def test_nothing_and_unequal_trees(spark, data):
    ln, n = data
    table = likes(spark, ln, n)
    assert resampling.resampled(table.where("false"), 10).count() == 0
    with pytest.raises(ValueError):
        resampling.resampled(table.where("tree_id > 0 or pos > 'p3'"), 10)


def test_bootstrap_within_subsets(spark):
    """Every replicate has each subset's length, and columns of that subset alone."""
    sites = [(p, "ab"[p % 3 == 0], f"c{p}") for p in range(0, 120, 2)]
    chars = spark.createDataFrame([(t, p, f"{t}{c}") for p, _, c in sites for t in range(3)], "tax int, pos long, ch string").repartition(6)
    part = spark.createDataFrame([(p, s) for p, s, _ in sites], "pos long, subset string")
    rows = pairs.bootstrap(chars, 0, 5, part=part).collect()
    of = {c: s for _, s, c in sites}
    at = {p: s for p, s, _ in sites}
    assert len(rows) == 5 * 60 * 3 and all(of[r.ch[1:]] == at[r.new_pos] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.replicate, r.new_pos), set()).add(r.ch[1:])
    assert len(by) == 300 and all(len(x) == 1 for x in by.values()) and len({frozenset((k[1], *v) for k, v in by.items() if k[0] == i) for i in range(5)}) == 5
    numbers = recode.numbered(part.select("subset", "pos"), ("subset", "pos"), "subset").collect()
    assert {(r.subset, r.pos): r.k for r in numbers} == {(s, p): sorted(q for q, x, _ in sites if x == s).index(p) for p, s, _ in sites}


def test_running_convergence(spark, tmp_path):
    """Three batches of two runs, one of them partly sampled again, end at what all trees give at once."""
    from sparkclade.operators import splits as sp
    from sparkclade.streaming import convergence

    rng = np.random.default_rng(3)
    keys = [12, 24, 48, 6, 40, 56, 14]
    rows = [(run, gen, int(k)) for run in "ab" for gen in range(30) for k in rng.choice(keys, 3, replace=False)]
    for batch, (low, high) in enumerate(((0, 10), (5, 20), (20, 30))):
        some = [r for r in rows if low <= r[1] < high]
        spark.createDataFrame(some, "run string, gen long, split_key long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, gen long, split_key long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    convergence.running_convergence(stream, out, 7).awaitTermination()
    found = convergence.compared_runs(spark, out)
    want = sp.compare_runs(spark.createDataFrame(rows, "run string, tree_id long, split_key long"), 7).first()
    last = found.where("batch = 2").first()
    assert found.select("batch").distinct().count() == 3 and last.run_a == "a" and last.run_b == "b"
    assert abs(last.asdoss - want.asdoss) < 1e-12 and abs(last.max_difference - want.max_difference) < 1e-12
    first = sp.compare_runs(spark.createDataFrame([r for r in rows if r[1] < 10], "run string, tree_id long, split_key long"), 7).first()
    assert abs(found.where("batch = 0").first().asdoss - first.asdoss) < 1e-12


def test_weighed_joining():
    """Path lengths give their tree back under either weighing; of others, the new node's distances have the least variance."""
    from sparkclade.sources.newick import parse_newick, split_keys

    names = list("ABCDE")
    length = {"A": 0.1, "B": 0.4, "C": 0.2, "D": 0.7, "E": 0.3}
    inner = {frozenset("AB"): 0.15, frozenset("ABC"): 0.25}
    d = np.array([[0 if x == y else length[x] + length[y] + sum(v for k, v in inner.items() if (x in k) != (y in k)) for y in names] for x in names])
    for weighed in (False, True):
        found = {k: x for _, _, k, x in split_keys(parse_newick(pairs.nj_newick(names, d, weighed)), {c: i for i, c in enumerate(names)})}
        assert abs(found[24] - 0.25) < 1e-9 and abs(found[28] - 0.15) < 1e-9 and abs(found[2] - 0.4) < 1e-9 and abs(found[8] - 0.7) < 1e-9
    noisy = d + np.array([[0, 0, 3, 1, 2], [0, 0, 1, 2, 0], [3, 1, 0, 1, 1], [1, 2, 1, 0, 0], [2, 0, 1, 0, 0]]) * 0.02
    assert pairs.nj_newick(names, noisy, True) != pairs.nj_newick(names, noisy)
