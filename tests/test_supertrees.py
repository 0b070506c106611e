"""Quartet joining, quartet likelihood, distance counts and reduced consensus against brute force."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from sparkclade.operators import supertrees as st


def random_tree(rng, taxa, resolve=1.0):
    """Internal splits (masks without the lowest taxon) of a tree on ``taxa``; each is kept with chance ``resolve``."""
    low, *rest = taxa
    clades = [1 << t for t in rest]
    keys = []
    while len(clades) > 2:
        a, b = rng.sample(range(len(clades)), 2)
        new = clades[a] | clades[b]
        clades = [c for i, c in enumerate(clades) if i not in (a, b)] + [new]
        keys.append(new)
    return sorted(k for k in keys if rng.random() < resolve and k.bit_count() < len(taxa) - 1)


def all_trees(mask):
    """Splits of every binary tree on ``mask``."""
    taxa = st.bits(mask)
    low = 1 << taxa[0]
    trees = [[1 << taxa[1], 1 << taxa[2]]]
    done = low | 1 << taxa[1] | 1 << taxa[2]
    for t in taxa[3:]:
        grown = []
        for tree in trees:
            for edge in [*tree, done ^ low]:
                # Clades above the edge take the new leaf in, the edge's own stays, with a clade of both.
                bit = 1 << t
                clades = [k | bit if edge & ~k == 0 and k != edge else k for k in tree] + [bit]
                clades += [edge | bit] if edge != done ^ low else [edge]
                grown.append(clades)
        trees, done = grown, done | 1 << t
    return [sorted(k for k in tree if 1 < k.bit_count() < len(taxa) - 1) for tree in trees]


def quartets_of(mask, keys):
    out = set()
    for four in itertools.combinations(st.bits(mask), 4):
        m = sum(1 << t for t in four)
        for k in keys:
            side = k & m
            if side.bit_count() == 2:
                out.add((m, side if side & m & -m else m ^ side))
    return out


def cut_keys(keys, mask):
    low = mask & -mask
    found = {(k & mask) ^ mask if k & mask & low else k & mask for k in keys}
    return sorted(k for k in found if 1 < k.bit_count() < mask.bit_count() - 1)


def tables(spark, trees, n_tax, whole=None):
    """``trees``: (mask, keys); splits may be given of the whole tree."""
    splits = [(i, k) for i, (_, keys) in enumerate(trees) for k in keys]
    return spark.createDataFrame(splits, "tree_id int, split_key long"), spark.createDataFrame([(i, m) for i, (m, _) in enumerate(trees)], "tree_id int, mask long")


def test_quartet_table(spark):
    rng = random.Random(1)
    whole = [random_tree(rng, range(9), 0.8) for _ in range(6)]
    masks = [sum(1 << t for t in rng.sample(range(9), rng.randint(3, 9))) for _ in whole]
    trees = list(zip(masks, whole)) * 2
    want = Counter(q for m, keys in trees for q in quartets_of(m, cut_keys(keys, m)))
    assert {(r.four, r.side): r.n for r in st.quartet_table(*tables(spark, trees, 9)).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_quartet_joining_finds_the_tree(spark, seed):
    """Trees cut from one tree, all fours of taxa together in some, give that tree, some odd trees among them or not."""
    rng = random.Random(seed)
    n = 10
    true = random_tree(rng, range(n))
    trees = []
    for drop in itertools.combinations(range(n), 2):
        m = sum(1 << t for t in range(n) if t not in drop)
        trees.append((m, cut_keys(true, m)))
    trees += [((1 << n) - 1, random_tree(rng, range(n))) for _ in range(3)]
    found = st.quartet_joining(st.quartet_table(*tables(spark, trees, n)))
    assert found.splits == true and found.placed == (1 << n) - 1 and found.unplaced == {}


def test_votes_are_only_added(spark):
    """After each addition the votes added up so far are those counted from nothing."""
    rng = random.Random(4)
    n = 8
    trees = [((1 << n) - 1, random_tree(rng, range(n))) for _ in range(4)]
    table = st.quartet_table(*tables(spark, trees, n))
    rows = [(r.four, r.side, r.n) for r in table.collect()]
    tree, new, kept = st.Growing(rows[0][0], rows[0][1]), rows[0][0], Counter()
    for x in [t for t in range(n) if not rows[0][0] >> t & 1]:
        for r in st.votes_of(spark, table, tree, new).collect():
            kept[r.other, r.node, r.port] += r.n
        want = Counter()
        for four, side, k in rows:
            three = four & tree.placed
            if three.bit_count() == 3:
                other = four ^ three
                mate = (side if side & other else four ^ side) ^ other
                node = next(i for i, p in enumerate(tree.nodes) if all((m & three).bit_count() == 1 for m in p))
                want[other, node, next(i for i, m in enumerate(tree.nodes[node]) if m & mate)] += k
        live = {k: v for k, v in kept.items() if not k[0] & tree.placed}
        assert live == want
        edges = tree.edges()
        assert len(edges) == 2 * tree.placed.bit_count() - 3
        tree.add(x, edges[rng.randrange(len(edges))])
        new = 1 << x


def test_quartet_joining_without_answer(spark):
    """Two trees that share two taxa: the second one's others cannot be placed but by breaking ties."""
    trees = [(0b1111, [0b1100]), (0b110011, [0b110000])]
    table = st.quartet_table(*tables(spark, trees, 6))
    left = st.quartet_joining(table, break_ties=False)
    assert left.placed == 0b1111 and set(left.unplaced) == {4, 5} and left.splits == [0b1100]
    full = st.quartet_joining(table)
    assert full.placed == 0b111111 and len(full.splits) == 3
    assert st.quartet_joining(table.where("false")) == st.Joined([], 0, {})


def test_quartet_likelihood(spark):
    rng = random.Random(8)
    whole = [random_tree(rng, range(8), 0.7) for _ in range(5)]
    trees = [(sum(1 << t for t in rng.sample(range(8), 6)), k) for k in whole]
    sup = whole[0]
    own = quartets_of(255, sup)
    hits = sum(len(quartets_of(m, cut_keys(k, m)) & own) for m, k in trees)
    misses = sum(len(quartets_of(m, cut_keys(k, m)) - own) for m, k in trees)
    table = st.quartet_hits(st.quartet_table(*tables(spark, trees, 8)), spark.createDataFrame([(k,) for k in sup], "split_key long"), 8)
    assert tuple(table.first()) == (hits, misses, len(own), 3 * math.comb(8, 4))
    f = lambda q: hits * math.log(q / len(own)) + misses * math.log((1 - q) / (210 - len(own)))
    assert abs(st.qpa_log_like(table, 0.4).first()[0] - f(0.4)) < 1e-9
    best = st.qpa_best(table).first()
    assert abs(best.log_like - f(best.q)) < 1e-9 and all(f(best.q) >= f(best.q + e) for e in (-0.01, 0.01))
    star = st.quartet_hits(st.quartet_table(*tables(spark, trees, 8)), spark.createDataFrame([], "split_key long"), 8)
    assert tuple(star.first()) == (0, hits + misses, 0, 210) and abs(st.qpa_log_like(star, 0.4).first()[0] + (hits + misses) * math.log(210)) < 1e-9


@pytest.mark.parametrize("taxa", [range(4), range(5), range(6), (1, 3, 4, 8, 9, 20, 33)])
def test_trees_by_shared_splits(taxa):
    rng = random.Random(3)
    mask = sum(1 << t for t in taxa)
    every = all_trees(mask)
    assert len(every) == len(set(map(tuple, every))) == st.double_factorial(2 * len(taxa) - 5)
    for resolve in (1.0, 0.5, 0.0):
        keys = random_tree(rng, list(taxa), resolve)
        want = Counter(len(set(t) & set(keys)) for t in every)
        got = st.trees_by_shared(mask, keys)
        assert {s: n for s, n in enumerate(got) if n} == want
        z = sum(math.exp(-0.8 * (len(t) + len(keys) - 2 * len(set(t) & set(keys)))) for t in every)
        assert abs(st.log_normaliser(mask, keys, 0.8) - math.log(z)) < 1e-9


def test_distances_of_many_taxa():
    """60 taxa: all trees are counted, and but for trees that share a cherry hardly any is near."""
    keys = random_tree(random.Random(1), range(60))
    got = st.trees_by_shared((1 << 60) - 1, keys)
    assert sum(got) == st.double_factorial(115) and got[57] == 1 and got[56] == 2 * 57 and min(got) >= 0


def profile(trees, need, least=2):
    """Statements by brute force: every two disjoint sets of taxa, those that enough trees part, and no wider one of as many."""
    every = 0
    for m, _ in trees:
        every |= m
    found = {}
    taxa = st.bits(every)
    for code in itertools.product(range(3), repeat=len(taxa)):
        i, o = (sum(1 << t for t, c in zip(taxa, code) if c == k) for k in (1, 2))
        if i.bit_count() < least or o.bit_count() < least or (i & -i) < (o & -o):
            continue
        n = sum(any(not i & ~a and not o & ~b for k in cut_keys(keys, m) for a, b in ((k, m ^ k), (m ^ k, k))) for m, keys in trees)
        if n >= need:
            found[i, o] = n
    within = lambda x, y: any(not x[0] & ~a and not x[1] & ~b for a, b in (y, y[::-1]))
    return {(*x, n) for x, n in found.items() if not any(x != y and m >= n and within(x, y) for y, m in found.items())}


@pytest.mark.parametrize("seed", range(3))
def test_reduced_profiles(spark, seed):
    rng = random.Random(seed)
    first = random_tree(rng, range(7))
    trees = [(127, first), (127, first)]
    for _ in range(3):
        # The same tree with two taxa changed, or cut.
        a, b = rng.sample(range(1, 7), 2)
        swap = lambda k: k & ~(1 << a | 1 << b) | (k >> a & 1) << b | (k >> b & 1) << a  # noqa: B023, E731
        trees.append((127, sorted(swap(k) for k in first)))
    m = 127 ^ 1 << rng.randrange(7)
    trees.append((m, cut_keys(first, m)))
    splits, masks = tables(spark, trees, 7)
    for share, need in ((None, 6), (0.5, 4)):
        plan = st.reduced_profile(splits, masks, share)
        got = {(r.inside, r.outside, r.n) for r in plan.collect()}
        assert got == profile(trees, need)
        assert all(r.excluded == 127 & ~(r.inside | r.outside) and abs(r.proportion - r.n / 6) < 1e-12 for r in plan.collect())
        text = plan._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_profiles_by_group(spark):
    """Groups of different sizes at once; a tree without splits leaves nothing that all agree on."""
    rng = random.Random(6)
    trees = [(127, random_tree(rng, range(7))) for _ in range(5)] + [(127, [])]
    splits, masks = tables(spark, trees, 7)
    of = {0: "a", 1: "a", 2: "a", 3: "b", 4: "c", 5: "c"}
    groups = spark.createDataFrame(list(of.items()), "tree_id int, grp string")
    got = {(r.grp, r.inside, r.outside, r.n) for r in st.reduced_profile(splits, masks, None, groups).collect()}
    want = {(g, *x) for g in "abc" for some in [[t for i, t in enumerate(trees) if of[i] == g]] for x in profile(some, len(some))}
    assert got == want and any(g == "b" for g, *_ in got) and not any(g == "c" for g, *_ in got)
    assert st.reduced_profile(splits.where("false"), masks).count() == 0


# -- quartet distances by shared leaves


def by_quartets(n, a, b):
    """Resolved quartets of two trees as sets: shared, in both but different, and each one's number."""
    x, y = ({f: s for f, s in quartets_of((1 << n) - 1, k)} for k in (a, b))
    both = x.keys() & y.keys()
    return sum(x[f] == y[f] for f in both), sum(x[f] != y[f] for f in both), len(x), len(y)


def test_quartet_distance_kernel():
    from sparkclade.operators import quartet_distance as qd

    rng = random.Random(9)
    for n in (4, 5, 7, 9):
        for _ in range(12):
            a, b = (random_tree(rng, range(n), rng.choice([1.0, 0.6, 0.2])) for _ in range(2))
            x, y = (qd.nodes_of((np.array(k, np.int64).reshape(-1, 1) >> np.arange(n)) & 1) for k in (a, b))
            assert all((s.sum(0) == 1).all() for s in x)
            assert (*qd.shared_and_different(qd.padded(x), qd.padded(y)), qd.resolved_count(x), qd.resolved_count(y)) == by_quartets(n, a, b)


def test_quartet_distance_of_many_taxa():
    """200 taxa: two hundred million quartets without one of them spelt out."""
    from sparkclade.operators import quartet_distance as qd

    rng = random.Random(1)
    sides = []
    for _ in range(2):
        keys = random_tree(rng, range(200))
        sides.append(np.array([[k >> t & 1 for t in range(200)] for k in keys]))
    began = time.time()
    x, y = (qd.nodes_of(s) for s in sides)
    same, other = qd.shared_and_different(qd.padded(x), qd.padded(y))
    assert same + other == math.comb(200, 4) == qd.resolved_count(x) and 0.2 < same / math.comb(200, 4) < 0.6
    assert qd.shared_and_different(qd.padded(x), qd.padded(x)) == (math.comb(200, 4), 0) and time.time() - began < 30


def test_quartet_distances_of_trees(spark):
    from sparkclade.operators import quartet_distance as qd

    rng = random.Random(12)
    trees = [random_tree(rng, range(8), 0.7) for _ in range(5)]
    trees.append(trees[1])
    splits = spark.createDataFrame([(t, k) for t, keys in enumerate(trees) for k in keys], "tree_id long, split_key long")
    got = {(r.i, r.j): r.different for r in qd.quartet_distances(splits, 8).collect()}
    want = {}
    for i, j in itertools.combinations([t for t, k in enumerate(trees) if k], 2):
        same, other, n, m = by_quartets(8, trees[i], trees[j])
        want[i, j] = n + m - 2 * same - other
    assert got == want


def test_consensus_in_rounds(spark):
    """As if splits were tried one by one."""
    from sparkclade.operators import splits as sp

    rng = random.Random(13)
    trees = [random_tree(rng, range(9)) for _ in range(12)]
    rows = spark.createDataFrame([(t, k, 1.0) for t, keys in enumerate(trees) for k in keys], "tree_id long, split_key long, br_len double")
    table = Counter(k for keys in trees for k in keys)
    want = {k: p for k, p in sp.consensus_splits([(k, n / 12) for k, n in table.items()], 9)}
    assert {r.split_key: r.proportion for r in sp.consensus_table(rows, 9).collect()} == pytest.approx(want)
    clash = {(r.a, r.b) for r in sp.clashing(rows, 9).collect()}
    assert clash == {(a, b) for a in table for b in table if a & b and a & ~b and b & ~a}


def test_sampled_stability(spark):
    """All quartets: the measure itself, without error; a third of them: within the stated error, nearly always."""
    from sparkclade.operators import splits as sp

    rng = random.Random(21)
    trees = [random_tree(rng, range(14)) for _ in range(3)]
    rows = spark.createDataFrame([(t, k) for t, keys in enumerate(trees) for k in keys], "tree_id long, split_key long")
    whole = {r.tax: r for r in sp.leaf_stability(sp.quartet_counts(rows, 14)).collect()}
    full = {r.tax: r for r in sp.sampled_stability(rows, 14, 1.0).collect()}
    assert all(abs(full[t].ls_max - r.ls_max) < 1e-12 and abs(full[t].ls_diff - r.ls_diff) < 1e-12 and full[t].ls_max_error == 0 for t, r in whole.items())
    some = sp.sampled_stability(rows, 14, 1 / 3).collect()
    assert 14 == len(some) and 0.25 * 286 * 14 < sum(r.n for r in some) < 0.42 * 286 * 14
    off = [abs(r.ls_max - whole[r.tax].ls_max) / r.ls_max_error for r in some]
    assert max(off) < 4.5 and sum(x < 2.5 for x in off) >= 12
