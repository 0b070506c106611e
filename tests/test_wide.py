"""Trees of more taxa than a long has bits, against brute force over Python's sets."""

import random

import pytest
from pyspark.sql import functions as F

from sparkclade.operators import splits as sp
from sparkclade.operators.taxon_sets import as_int
from sparkclade.sources.formats import splits_of

N = 200
TAXA = [f"t{i}" for i in range(N)]
FULL = (1 << N) - 1


def drawn(rng, names):
    """A random resolved tree, and one near it: two of its leaves have changed places."""
    parts = [(n, f"{n}:1") for n in names]
    rng.shuffle(parts)
    texts = [t for _, t in parts]
    while len(texts) > 3:
        a, b = (texts.pop(rng.randrange(min(len(texts), 40))) for _ in "ab")
        texts.append(f"({a},{b}):{rng.randrange(1, 9)}")
    one = f"({','.join(texts)});"
    x, y = rng.sample(names, 2)
    return one, one.replace(f"{x}:", "!:").replace(f"{y}:", f"{x}:").replace("!:", f"{y}:")


@pytest.fixture(scope="module")
def told(spark):
    rng = random.Random(4)
    texts = [t for _ in range(2) for t in drawn(rng, TAXA)]
    trees = spark.createDataFrame(list(enumerate(texts)), "tree_id long, newick string")
    splits = splits_of(trees, TAXA).cache()
    found = {}
    for r in splits.collect():
        key = sum(1 << i for i, c in enumerate(r.split) if c == "*")
        assert key == as_int(r.split_key)
        found.setdefault(r.tree_id, {})[key] = r.br_len
    return splits, found


def inner(keys):
    return {k for k in keys if 1 < k.bit_count() < N - 1}


def clash(a, b):
    return bool(a & b and a & ~b and b & ~a)


def test_distances(told):
    splits, found = told
    got = {(r.i, r.j): r for r in sp.tree_distances(splits).collect()}
    assert len(got) == 6
    for (i, j), r in got.items():
        a, b = found[i], found[j]
        assert r.sd == len(a.keys() ^ b.keys())
        assert r.wrf == pytest.approx(sum(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys()))
        assert r.bld == pytest.approx(sum((a.get(k, 0) - b.get(k, 0)) ** 2 for k in a.keys() | b.keys()) ** 0.5)


def test_conflicts_and_consensus(told):
    splits, found = told
    got = {(r.i, r.j): r.n for r in sp.conflicts(splits, N).collect()}
    want = {(i, j): sum(clash(a, b) for a in inner(found[i]) for b in inner(found[j])) for i in found for j in found if i < j}
    assert got == {k: n for k, n in want.items() if n}

    every = set().union(*map(inner, found.values()))
    kept = {as_int(r.split_key) for r in sp.semi_strict(splits, N).collect()}
    assert kept == {a for a in every if not any(clash(a, b) for b in every)}

    table = [(k, sum(k in found[t] for t in found) / 4) for k in every]
    assert {as_int(r.split_key) for r in sp.consensus_table(splits, N).collect()} == {k for k, _ in sp.consensus_splits(table, N)}
    assert splits_of(sp.consensus(splits, TAXA).withColumn("tree_id", F.lit(1)), TAXA).count() == len(sp.consensus_splits(table, N)) + N


def test_supertree_support(spark, told):
    splits, found = told
    rng = random.Random(2)
    masks = {t: sum(1 << i for i in rng.sample(range(N), 150)) for t in found}
    text = lambda m: "".join("*" if m >> i & 1 else "." for i in range(N))
    tree_masks = spark.createDataFrame([(t, text(m)) for t, m in masks.items()], "tree_id long, m string").select("tree_id", sp.key_of_string(F.col("m"), N).alias("mask"))
    sup = splits.where("tree_id = 0").where(~sp.is_trivial(F.col("split_key"), N)).select("split_key")

    def cut(keys, m):
        low = m & -m
        k = {m ^ (x & m) if x & low else x & m for x in keys}
        return {x for x in k if 1 < x.bit_count() < m.bit_count() - 1}

    want = {t: len(cut(found[t], m) ^ cut(inner(found[0]), m)) for t, m in masks.items()}
    assert {r.tree_id: r.sd for r in sp.supertree_distances(splits, tree_masks, sup).collect()} == want

    def kind(key, t):
        m = masks[t]
        a, o = key & m, m & ~key
        if a.bit_count() < 2 or o.bit_count() < 2:
            return "r"
        mine = [k & m for k in found[t]]
        if a in mine or o in mine:
            return "s"
        return "q" if any(a & b and a & m & ~b and o & b and o & m & ~b for b in mine) else "p"

    got = {as_int(r.split_key): (r.s, r.p, r.q, r.r) for r in sp.support_spqr(splits, tree_masks, sup).collect()}
    assert got == {k: tuple([kind(k, t) for t in found].count(c) for c in "spqr") for k in inner(found[0])}


def test_key_and_matrix(spark, told):
    splits, found = told
    key = next(iter(inner(found[2])))
    assert {r.tree_id for r in sp.trees_with_split(splits, key).collect()} == {t for t in found if key in found[t]}
    text = "".join("*" if key >> i & 1 else "." for i in range(N))
    one = spark.createDataFrame([(1, text)], "tree_id long, s string").select("tree_id", sp.key_of_string(F.col("s"), N).alias("split_key"))
    assert one.select(sp.split_string(F.col("split_key"), N).alias("s")).first().s == text
    taxa = spark.range(N).select(F.col("id").cast("int").alias("tax"))
    matrix = sp.mrp(one, taxa, taxa.withColumn("tree_id", F.lit(1)), N)
    back, masks = sp.reverse_mrp(matrix, N)
    assert [as_int(r.split_key) for r in back.collect()] == [key] and [as_int(r.mask) for r in masks.collect()] == [FULL]


def test_quartets(spark):
    """70 taxa: the quartets with taxon 0 of a caterpillar."""
    names = [f"t{i}" for i in range(70)]
    text = "(t0,t1)"
    for n in names[2:]:
        text = f"({text},{n})"
    splits = splits_of(spark.createDataFrame([(1, text + ";")], "tree_id long, newick string"), names)
    got = sp.quartets(splits, 70, 0)
    assert got.count() == 69 * 68 * 67 // 6 and {r.topology for r in got.select("topology").distinct().collect()} == {1}


def test_tables_are_made_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """A small file's one task would hold all that its rows become; groups by its key need no other shuffle."""
    import os

    from pyspark.sql import functions as F

    from sparkclade.plans import bridge, wide

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    monkeypatch.setattr(bridge, "SITES_A_TASK", 20)
    monkeypatch.setattr(bridge, "TREES_A_TASK", 2)
    for t, key in ((bridge.chars, "pos"), (bridge.plain, "pos"), (bridge.splits, "tree_id"), (wide.splits, "tree_id"), (wide.leaves, "tree_id")):
        made = t(spark, d)
        per_task = made.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(key).alias("n"), F.count("*").alias("rows"))
        assert per_task.count() > 1, t
        plan = made.groupBy(key).count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, t


def test_trees_stay_where_they_were_dealt(spark, monkeypatch):
    """Splits and masks of wide trees are made by as many tasks as the trees need, and meet there without a further shuffle."""
    import os

    from sparkclade.plans import bridge, wide

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    monkeypatch.setattr(bridge, "TREES_A_TASK", 2)
    splits, masks = wide.splits(spark, d), wide.masks(spark, d)
    most = masks.groupBy(F.spark_partition_id().alias("task")).count().agg(F.count("*").alias("tasks"), F.max("count").alias("rows")).first()
    assert most.tasks > 1 and most.rows < masks.count()
    cut = sp.cut_to_taxa(splits.join(masks, "tree_id"))
    for made, dealings in ((splits.select("tree_id").distinct(), 1), (cut, 2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == dealings, plan
