"""Set algebra on tree splits: ``splits`` (tree_id, split_key, br_len) with canonical keys (bit 0 clear), leaves included.

Keys are longs for up to 62 taxa and arrays of longs beyond (``taxon_sets``); all comparisons are equi joins on the key.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .taxon_sets import as_int, for_taxa, gathered, in_column, members, memberships, of_text
from .tree_pairs import by_taxon, clashes, distances, each_two, numbered, rounded, with_inner, with_lengths


def canonical(raw: Column, n_tax: int) -> Column:
    sets = for_taxa(n_tax)
    return F.when(sets.holds(raw, F.lit(0)), sets.without(sets.literal((1 << n_tax) - 1, n_tax), raw)).otherwise(raw)


def split_string(key: Column, n_tax: int) -> Column:
    """``.`` and ``*`` by taxon."""
    if n_tax > 62:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_tax - 1)), lambda i: F.when(for_taxa(n_tax).holds(key, i), "*").otherwise(".")), "")
    return F.concat(*[F.when(key.bitwiseAND(F.lit(1 << i)) != 0, "*").otherwise(".") for i in range(n_tax)])


def key_of_string(text: Column, n_tax: int) -> Column:
    return of_text(text, n_tax)


def key_of_names(names: list[str], taxa: list[str]) -> int:
    """Canonical key of a set of taxa."""
    raw = sum(1 << taxa.index(n) for n in set(names))
    return raw ^ ((1 << len(taxa)) - 1) if raw & 1 else raw


def clade_size(key: Column, n_tax: int = 62) -> Column:
    return for_taxa(n_tax).size(key)


def is_trivial(key: Column, n_tax: int) -> Column:
    size = clade_size(key, n_tax)
    return (size <= 1) | (size >= n_tax - 1)


def split_table(splits: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(split_key, n, proportion, mean_br_len) over all trees, weighted by ``weights`` (tree_id, w) if given."""
    w = splits.join(weights, "tree_id") if weights is not None else splits.withColumn("w", F.lit(1.0))
    total = (weights.agg(F.sum("w").alias("total")) if weights is not None else splits.select("tree_id").distinct().agg(F.count("*").cast("double").alias("total")))
    s = w.groupBy("split_key").agg(F.sum("w").alias("n"), (F.sum(F.col("br_len") * F.col("w")) / F.sum("w")).alias("mean_br_len"))
    return s.crossJoin(F.broadcast(total)).select("split_key", "n", (F.col("n") / F.col("total")).alias("proportion"), "mean_br_len")


def write_splits(table: DataFrame, n_tax: int, least: float = 0.05, leaves: bool = True) -> DataFrame:
    """(split, proportion) in order of proportion, then string."""
    t = table.where(F.col("proportion") >= least)
    t = t if leaves else t.where(~is_trivial(F.col("split_key"), n_tax))
    return t.select(split_string(F.col("split_key"), n_tax).alias("split"), "proportion").orderBy(F.desc("proportion"), "split")


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables (split_key, n, total) as one; totals add up."""
    both = a.unionByName(b)
    total = a.select("total").limit(1).unionByName(b.select("total").limit(1)).agg(F.sum("total").alias("total"))
    return both.groupBy("split_key").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).withColumn("proportion", F.col("n") / F.col("total"))


def compare_tables(a: DataFrame, b: DataFrame, n_tax: int, least: float = 0.1, both: bool = False, no_leaves: bool = True) -> DataFrame:
    """(split_key, p1, p2): splits of two tables of which either, or ``both``, reach ``least``."""
    side = lambda t, name: t.select("split_key", F.col("proportion").alias(name))
    t = side(a, "p1").join(side(b, "p2"), "split_key", "full").na.fill(0.0, ["p1", "p2"])
    if no_leaves:
        t = t.where(~is_trivial(F.col("split_key"), n_tax))
    reach = (F.col("p1") >= least) & (F.col("p2") >= least) if both else (F.col("p1") >= least) | (F.col("p2") >= least)
    return t.where(reach)


def compare_runs(splits: DataFrame, n_tax: int, least: float = 0.1) -> DataFrame:
    """(run_a, run_b, asdoss, max_difference, mean_difference) of each two runs of (run, tree_id, split_key): over internal
    splits that either run has in ``least`` of its trees."""
    total = splits.groupBy("run").agg(F.count_distinct("tree_id").alias("trees"))
    return compared_counts(splits.groupBy("run", "split_key").agg(F.count("*").alias("n")), total, n_tax, least)


def compared_counts(counts: DataFrame, total: DataFrame, n_tax: int, least: float = 0.1) -> DataFrame:
    """``compare_runs`` of counts (run, split_key, n) and the trees of each run (run, trees)."""
    p = counts.where(~is_trivial(F.col("split_key"), n_tax)).join(F.broadcast(total), "run").select("run", "split_key", (F.col("n") / F.col("trees")).alias("p"))
    # Runs are few: each split is told for all of them, 0 where it is absent.
    runs = F.broadcast(total.select("run"))
    every = p.select("split_key").distinct().crossJoin(runs).join(p, ["run", "split_key"], "left").na.fill(0.0, ["p"])
    a, b = every.select(F.col("run").alias("run_a"), "split_key", F.col("p").alias("p1")), every.select(F.col("run").alias("run_b"), "split_key", F.col("p").alias("p2"))
    met = a.join(b, "split_key").where((F.col("run_a") < F.col("run_b")) & (F.greatest("p1", "p2") >= least))
    d = F.abs(F.col("p1") - F.col("p2"))
    return met.groupBy("run_a", "run_b").agg(F.avg(d / F.sqrt(F.lit(2.0))).alias("asdoss"), F.max(d).alias("max_difference"), F.avg(d).alias("mean_difference"))


def same_trees(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(tree_id, same): whether the trees of one number have the same splits, of the same lengths."""
    met = a.select("tree_id", "split_key", F.col("br_len").alias("x"), F.lit(1).alias("ina")).join(b.select("tree_id", "split_key", F.col("br_len").alias("y"), F.lit(1).alias("inb")), ["tree_id", "split_key"], "full")
    ok = F.col("ina").isNotNull() & F.col("inb").isNotNull() & ((F.abs(F.col("x") - F.col("y")) <= tolerance) | (F.col("x").isNull() & F.col("y").isNull()))
    return met.groupBy("tree_id").agg(F.min(F.coalesce(ok, F.lit(False))).alias("same"))


def asdoss(pairs: DataFrame) -> DataFrame:
    """(asdoss, max_difference, mean_difference) of compared splits: the sample deviation of two is their difference by root 2."""
    d = F.abs(F.col("p1") - F.col("p2"))
    return pairs.agg(F.avg(d / F.sqrt(F.lit(2.0))).alias("asdoss"), F.max(d).alias("max_difference"), F.avg(d).alias("mean_difference"))


#: Trees, or splits of many taxa, of a block; each two blocks are compared in a task of their own.
TREES_A_BLOCK, SPLITS_A_BLOCK = 250, 1_000


def blocks_of_pairs(trees: DataFrame, *keep: str, size: int = TREES_A_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows of ``trees`` (tree_id, ...) dealt to each two blocks of ``size`` trees, as the one and as the other: (one, other, ...).

    All pairs of trees meet by an equi join on the blocks, whatever their number; nothing is broadcast.
    """
    n = trees.agg((F.floor(F.approx_count_distinct("tree_id") / size) + 1).cast("int").alias("blocks"))
    dealt = trees.crossJoin(F.broadcast(n)).withColumn("own", F.pmod(F.xxhash64("tree_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names = ["one", "other", *keep]
    return dealt.select("own", every, *keep).toDF(*names), dealt.select(every, "own", *keep).toDF(*names)


def tree_distances(splits: DataFrame, *only: str, digits: int | None = None) -> DataFrame:
    """(i, j, sd, diffs_i, diffs_j, wrf, bld) of each two trees, i < j: symmetric difference, its two parts, the sum of
    length differences and the root of the sum of their squares; or ``only`` some of these five, in this order.

    With ``digits``, wrf and bld are rounded where kinds of trees meet, not a pair of trees at a time; bld's square
    is rounded to 8 digits before.
    """
    types = {"sd": "long", "diffs_i": "long", "diffs_j": "long", "wrf": "double", "bld": "double"}
    names = [n for n in types if not only or n in only]

    def compare(ones: list, others: list) -> list[np.ndarray]:
        found = dict(zip(types, distances(ones, others)))
        if digits is not None:
            finish = {"wrf": lambda x: rounded(x, digits), "bld": lambda x: rounded(np.sqrt(rounded(x * x, 8)), digits)}
            found |= {n: f(found[n]) for n, f in finish.items() if n in names}
        return [found[n] for n in names]

    parts = (names.index("diffs_i"), names.index("diffs_j")) if {"diffs_i", "diffs_j"} <= set(names) else None
    if parts is None and {"diffs_i", "diffs_j"} & set(names):
        raise ValueError("diffs_i and diffs_j come together")
    return each_two(with_lengths(splits), numbered, compare, ", ".join(f"{n} {types[n]}" for n in names), mirrored=parts)


def tree_lengths(splits: DataFrame) -> DataFrame:
    return splits.groupBy("tree_id").agg(F.sum("br_len").alias("len"))


def trees_with_split(splits: DataFrame, key: int) -> DataFrame:
    """``key``: a canonical key, as a number whatever the number of taxa."""
    sets = in_column(splits, "split_key")
    wanted = sets.literal(key, max(key.bit_length(), 1))
    # Words beyond the last one that is not 0 are 0 in the key too.
    same = (F.slice("split_key", 1, F.size(wanted)) == wanted) & (sets.size(F.col("split_key")) == key.bit_count()) if sets.wide else F.col("split_key") == wanted
    return splits.where(same).select("tree_id").distinct()


def consistent_trees(splits: DataFrame, constraints: DataFrame) -> DataFrame:
    """(tree_id, consistent): whether a tree has all the splits of ``constraints`` (split_key)."""
    need = constraints.select("split_key").distinct()
    found = splits.join(need, "split_key", "left_semi").groupBy("tree_id").agg(F.count_distinct("split_key").alias("k"))
    wanted = need.agg(F.count("*").alias("wanted"))
    return splits.select("tree_id").distinct().join(found, "tree_id", "left").crossJoin(F.broadcast(wanted)).select("tree_id", (F.coalesce("k", F.lit(0)) == F.col("wanted")).alias("consistent"))


def topologies(splits: DataFrame, n_tax: int) -> DataFrame:
    """(tree_id, topology): internal splits in order, as text."""
    inner = splits.where(~is_trivial(F.col("split_key"), n_tax))
    return inner.groupBy("tree_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("split_key")), lambda x: x.cast("string")), ",").alias("topology"))


def tree_probabilities(splits: DataFrame, n_tax: int) -> DataFrame:
    """(topology, n, p, first_tree): posterior of each topology."""
    trees = topologies(splits, n_tax)
    t = trees.groupBy("topology").agg(F.count("*").alias("n"), F.min("tree_id").alias("first_tree"))
    total = F.broadcast(trees.agg(F.count("*").alias("total")))
    return t.crossJoin(total).select("topology", "n", (F.col("n") / F.col("total")).alias("p"), "first_tree")


def track_splits(splits: DataFrame, order: DataFrame, tracked: DataFrame, window: int = 200, stride: int = 100) -> DataFrame:
    """(split_key, hop, frequency): how often each of ``tracked`` occurs in hopping windows of trees; full windows only.

    ``order`` (tree_id, k) numbers the trees from 0.
    """
    n = order.agg((F.floor((F.max("k") + 1 - window) / stride) + 1).alias("windows"))
    hops = order.crossJoin(F.broadcast(n)).withColumn("hop", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("k") - window + 1) / stride)), F.floor(F.col("k") / stride)))).where("hop < windows").select("tree_id", "hop")
    every = tracked.select("split_key").distinct().crossJoin(hops.select("hop").distinct())
    hit = splits.join(tracked.select("split_key").distinct(), "split_key", "left_semi").join(hops, "tree_id").groupBy("split_key", "hop").agg(F.count("*").alias("n"))
    return every.join(hit, ["split_key", "hop"], "left").select("split_key", "hop", (F.coalesce("n", F.lit(0)) / window).alias("frequency"))


def incompatible(a: Column, b: Column, n_tax: int) -> Column:
    """Whether two splits cannot be in one tree; canonical keys leave taxon 0 out, so three of four cells are to be looked at."""
    sets = for_taxa(n_tax)
    return sets.some(sets.both(a, b)) & sets.some(sets.without(a, b)) & sets.some(sets.without(b, a))


def clashing(kinds: DataFrame, n_tax: int) -> DataFrame:
    """(a, b): all pairs of splits of ``kinds`` (split_key) that conflict, told both ways.

    Of two that do, a has a taxon that b has, and one that b has not.  They meet at the lowest of either kind, so a key is
    two taxa, of which there are as many as the taxa squared, and no key holds a large share of all splits.
    """
    sets = for_taxa(n_tax)
    if sets.wide:
        return clashing_blocks(kinds, n_tax)
    every = sets.literal((1 << n_tax) - 1, n_tax)
    told = kinds.select("split_key").distinct()
    a = told.select(F.col("split_key").alias("a"), F.explode(members(F.col("split_key"), n_tax)).alias("here")).select("a", "here", F.explode(members(F.col("a"), n_tax)).alias("there")).where("here <> there")
    b = told.select(F.col("split_key").alias("b"), F.explode(members(F.col("split_key"), n_tax)).alias("here")).select("b", "here", F.explode(members(sets.without(every, F.col("b")), n_tax)).alias("there"))
    met = a.join(b, ["here", "there"]).where((sets.first(sets.both(F.col("a"), F.col("b"))) == F.col("here")) & (sets.first(sets.without(F.col("a"), F.col("b"))) == F.col("there")))
    return met.where(sets.some(sets.without(F.col("b"), F.col("a")))).select("a", "b")


def clashing_blocks(kinds: DataFrame, n_tax: int) -> DataFrame:
    """``clashing`` of splits of many taxa, which would meet at the square of their taxa: each two blocks of splits are
    compared as matrices by split and taxon, and the number of shared taxa tells which conflict."""
    told = kinds.select(F.xxhash64("split_key").alias("tree_id"), "split_key").distinct()
    left, right = blocks_of_pairs(told, "split_key", size=SPLITS_A_BLOCK)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # Numbers of taxa are small whole numbers, so exact in floats, which multiply faster.
        x, y = (memberships(t["split_key"], n_tax, each=True).astype(np.float32) for t in (a, b))
        shared = x @ y.T
        i, j = np.nonzero((shared > 0) & (shared < x.sum(1)[:, None]) & (shared < y.sum(1)[None, :]))
        return pd.DataFrame({"a": a["split_key"].to_numpy()[i], "b": b["split_key"].to_numpy()[j]})

    return left.groupBy("one", "other").cogroup(right.groupBy("one", "other")).applyInPandas(compare, "a array<long>, b array<long>")


def conflicts(splits: DataFrame, n_tax: int) -> DataFrame:
    """(i, j, n): numbers of conflicting pairs of splits of each two trees, i < j, that have any."""
    inner = splits.where(~is_trivial(F.col("split_key"), n_tax))

    def compare(ones: list, others: list) -> list[np.ndarray]:
        n = clashes(ones, others)
        return [n > 0, n]

    return each_two(with_inner(inner, F.lit(True)), by_taxon(n_tax), compare, "n long", kinds_a_block=250, only=True)


def mrp(splits: DataFrame, taxa: DataFrame, tree_taxa: DataFrame, n_tax: int) -> DataFrame:
    """(tree_id, split_key, tax, ch): matrix representation: 1 in the clade, 0 in the tree, ? not in the tree."""
    inner = splits.where(~is_trivial(F.col("split_key"), n_tax)).select("tree_id", "split_key")
    cells = inner.crossJoin(F.broadcast(taxa.select("tax"))).join(tree_taxa.select("tree_id", "tax", F.lit(True).alias("here")), ["tree_id", "tax"], "left")
    inside = for_taxa(n_tax).holds(F.col("split_key"), F.col("tax"))
    return cells.select("tree_id", "split_key", "tax", F.when(F.col("here").isNull(), "?").when(inside, "1").otherwise("0").alias("ch"))


def cut_to_taxa(told: DataFrame) -> DataFrame:
    """(tree_id, key) of (tree_id, split_key, mask): internal splits cut to the taxa ``mask``, named by the part without
    the lowest of them."""
    sets, mask = in_column(told, "mask"), F.col("mask")
    inside = sets.both(F.col("split_key"), mask)
    key = F.when(sets.holds(inside, sets.first(mask)), sets.without(mask, inside)).otherwise(inside)
    size = sets.size(F.col("key"))
    return told.select("tree_id", "mask", key.alias("key")).where((size > 1) & (size < sets.size(mask) - 1)).select("tree_id", "key").distinct()


def supertree_distances(splits: DataFrame, tree_masks: DataFrame, supertree: DataFrame) -> DataFrame:
    """(tree_id, sd): symmetric difference of each input tree and the supertree (split_key) cut to its taxa.

    ``tree_masks`` (tree_id, mask): the taxa of each tree.
    """
    own = cut_to_taxa(splits.join(tree_masks, "tree_id"))
    # The supertree has at most twice as many splits as there are taxa.
    pruned = cut_to_taxa(tree_masks.crossJoin(F.broadcast(supertree.select("split_key"))))
    one = own.withColumn("a", F.lit(1)).join(pruned.withColumn("b", F.lit(1)), ["tree_id", "key"], "full").where("a is null or b is null")
    return tree_masks.select("tree_id").join(one.groupBy("tree_id").agg(F.count("*").alias("sd")), "tree_id", "left").na.fill(0, ["sd"])


def judged_support(splits: DataFrame, tree_masks: DataFrame, supertree: DataFrame) -> DataFrame:
    """(tree_id, split_key, kind): whether each input tree supports (s), permits (p), conflicts with (q) or is irrelevant
    to (r) each supertree split."""
    inner = splits.join(tree_masks, "tree_id")
    pairs = tree_masks.crossJoin(F.broadcast(supertree.select("split_key")))
    sets = in_column(tree_masks, "mask")
    key, mask, inside, outside, b, m = (F.col(c) for c in ("split_key", "mask", "inside", "outside", "b", "m"))
    pairs = pairs.withColumn("inside", sets.both(key, mask)).withColumn("outside", sets.without(mask, key))
    relevant = (sets.size(inside) > 1) & (sets.size(outside) > 1)
    mine = inner.select("tree_id", sets.both(key, mask).alias("b"), mask.alias("m")).distinct()
    met = pairs.where(relevant).join(mine, "tree_id")
    same = (b == inside) | (b == outside)
    meet = lambda x, y: sets.some(sets.both(x, y))
    # None of the four parts is empty.
    clash = meet(inside, b) & sets.some(sets.without(inside, b)) & meet(outside, b) & sets.some(sets.without(outside, b))
    judged = met.groupBy("tree_id", "split_key").agg(F.max(same).alias("same"), F.max(clash).alias("clash"))
    kind = F.when(F.col("same").isNull(), "r").when(F.col("same"), "s").when(F.col("clash"), "q").otherwise("p")
    return pairs.select("tree_id", "split_key").join(judged, ["tree_id", "split_key"], "left").select("tree_id", "split_key", kind.alias("kind"))


def support_spqr(splits: DataFrame, tree_masks: DataFrame, supertree: DataFrame) -> DataFrame:
    """(split_key, s, p, q, r): input trees that support, permit, conflict with or are irrelevant to each supertree split."""
    return judged_support(splits, tree_masks, supertree).groupBy("split_key").agg(*[F.count_if(F.col("kind") == c).alias(c) for c in "spqr"])


def weighted_support(judged: DataFrame) -> DataFrame:
    """(split_key, ws, wp, wv, wv_plus, wv_minus) of ``judged_support``: a tree's support weighs one over the number of
    splits that it supports, its permission likewise; conflicts weigh one each."""
    many = judged.where("kind in ('s', 'p')").groupBy("tree_id", "kind").agg(F.count("*").alias("many"))
    w = judged.join(many, ["tree_id", "kind"], "left")
    of = lambda c: F.sum(F.when(F.col("kind") == c, 1 / F.col("many")).otherwise(0.0))
    t = w.groupBy("split_key").agg(of("s").alias("ws"), of("p").alias("wp"), F.count_if(F.col("kind") == "q").alias("q"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    s, p, q = F.col("ws"), F.col("wp"), F.col("q")
    return t.select("split_key", "ws", "wp", ratio(s - q, s + q).alias("wv"), ratio(s - q + p, s + q + p).alias("wv_plus"), ratio(s - q - p, s + q + p).alias("wv_minus"))


def reverse_mrp(matrix: DataFrame, n_tax: int = 62) -> tuple[DataFrame, DataFrame]:
    """Splits (tree_id, split_key) and taxa (tree_id, mask) of the trees that a matrix (tree_id, split_key, tax, ch) represents.

    Columns are named by (tree_id, split_key); only their characters are read.
    """
    of = lambda c: gathered(F.when(c, F.col("tax")), n_tax)
    columns = matrix.groupBy("tree_id", "split_key").agg(of(F.col("ch") == "1").alias("ones"), of(F.col("ch") != "?").alias("mask"))
    # All columns of a tree have the same taxa.
    masks = columns.groupBy("tree_id").agg(F.max("mask").alias("mask"), F.assert_true(F.min("mask") == F.max("mask"), "columns of one tree differ in taxa").alias("ok")).select("tree_id", "mask")
    return columns.select("tree_id", F.col("ones").alias("split_key")).distinct(), masks


def compatible_pairs(splits: DataFrame, n_tax: int) -> DataFrame:
    """(i, j): trees, i < j, no split of which conflicts."""
    inner = ~is_trivial(F.col("split_key"), n_tax)
    return each_two(with_inner(splits, inner), by_taxon(n_tax), lambda ones, others: [clashes(ones, others) == 0], "", kinds_a_block=250, only=True)


def semi_strict(splits: DataFrame, n_tax: int) -> DataFrame:
    """(split_key): internal splits of some tree that no tree contradicts."""
    kinds = splits.where(~is_trivial(F.col("split_key"), n_tax)).select("split_key").distinct()
    return kinds.join(clashing(kinds, n_tax).select(F.col("a").alias("split_key")).distinct(), "split_key", "left_anti")


def component_usage(used: DataFrame) -> DataFrame:
    """(split_key, component, n, proportion): which model component the branches of each split have, of (split_key, component)."""
    n = used.groupBy("split_key", "component").agg(F.count("*").alias("n"))
    return n.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("split_key")))


def support_indices(spqr: DataFrame) -> DataFrame:
    """V = (s - q)/(s + q), V+ = (s + p - q)/(s + p + q), V- = (s - q - p)/(s + q + p), and coverage, null without relevant trees."""
    ratio = lambda a, b: F.when(b > 0, a / b)
    s, p, q, r = (F.col(c) for c in "spqr")
    return spqr.select("split_key", ratio(s - q, s + q).alias("v"), ratio(s + p - q, s + p + q).alias("v_plus"), ratio(s - q - p, s + q + p).alias("v_minus"), ratio(s + p + q, s + p + q + r).alias("coverage"))


def consensus_splits(table: list[tuple[int, float]], n_tax: int, least: float = 0.0) -> list[tuple[int, float]]:
    """Splits of the majority-rule tree with compatible ones added, in order of proportion and then string (``*`` first)."""
    text = lambda k: "".join("*" if k >> i & 1 else "." for i in range(n_tax))
    kept: list[tuple[int, float]] = []
    for key, p in sorted(table, key=lambda x: (-x[1], text(x[0]))):
        if p < least or len(kept) >= n_tax - 3:
            break
        if 1 < bin(key).count("1") < n_tax - 1 and not any(key & k and key & ~k and k & ~key for k, _ in kept):
            kept.append((key, p))
    return kept


def newick_of_splits(splits: list[tuple[int, float | None]], taxa: list[str], lengths: dict[int, float] | None = None) -> str:
    """The tree of compatible canonical splits, rooted at taxon 0's node, with the splits' values as labels."""
    lengths = lengths or {}
    full = ((1 << len(taxa)) - 1) & ~1
    values = dict(splits)
    sets = sorted({k for k, _ in splits if bin(k).count("1") > 1 and k != full} | {1 << i for i in range(1, len(taxa))}, key=lambda k: bin(k).count("1"))
    children: dict[int, list[int]] = {}
    for i, k in enumerate(sets):
        parent = next((m for m in sets[i + 1 :] if m & k == k and m != k), full)
        children.setdefault(parent, []).append(k)

    def render(k: int) -> str:
        length = f":{lengths[k]:.10g}" if k in lengths else ""
        if k not in children:
            return taxa[k.bit_length() - 1] + length
        label = "" if values.get(k) is None else f"{values[k]:.10g}"
        return f"({','.join(render(c) for c in sorted(children[k], key=lambda c: c & -c))}){label}{length}"

    first = taxa[0] + (f":{lengths[full]:.10g}" if full in lengths else "")
    return f"({','.join([first, *(render(c) for c in sorted(children.get(full, []), key=lambda c: c & -c))])});"


def consensus_table(splits: DataFrame, n_tax: int, least: float = 0.0) -> DataFrame:
    """(split_key, proportion): internal splits of the majority-rule tree with compatible ones added.

    The order is that of proportion and then string (``*`` first), as if splits were tried one by one.  In each round all
    stay that no undecided split both beats and contradicts, and what contradicts them goes: as many rounds as the
    longest chain of splits that each lose to the next, and no task sees all splits.
    """
    table = split_table(splits).where((F.col("proportion") >= least) & ~is_trivial(F.col("split_key"), n_tax)).select("split_key", "proportion")
    # The place in the order as one value: strings with a star before those with a dot are the greater in reversed bits.
    text = F.translate(split_string(F.col("split_key"), n_tax), ".*", "01")
    left = cut(table.withColumn("order", F.struct("proportion", text.alias("text"))))
    order = lambda c: left.select(F.col("split_key").alias(c), F.col("order").alias(f"order_{c}"))
    # (a, b): b loses to a.
    beaten = cut(clashing(left, n_tax).join(order("a"), "a").join(order("b"), "b").where("order_a > order_b").select("a", "b"))
    kept = []
    while not left.isEmpty():
        live = beaten.join(left.select(F.col("split_key").alias("a")), "a", "left_semi")
        stay = cut(left.join(live.select(F.col("b").alias("split_key")), "split_key", "left_anti"))
        kept.append(stay)
        lost = beaten.join(stay.select(F.col("split_key").alias("a")), "a", "left_semi").select(F.col("b").alias("split_key"))
        left = cut(left.join(stay, "split_key", "left_anti").join(lost, "split_key", "left_anti"))
    found = reduce(DataFrame.union, kept) if kept else left
    return found.select("split_key", "proportion")


def consensus(splits: DataFrame, taxa: list[str], least: float = 0.0) -> DataFrame:
    """(newick): majority rule with compatible splits added.  Of the tree's splits there are fewer than taxa."""
    n = len(taxa)
    table = consensus_table(splits, n, least)
    kept = [(as_int(r.split_key), r.proportion) for r in table.collect()]
    # Lengths of the tree's own branches: internal ones and those of leaves.
    own = splits.join(table, "split_key", "left_semi").unionByName(splits.where(is_trivial(F.col("split_key"), n)))
    lengths = {as_int(r.split_key): r.x for r in own.groupBy("split_key").agg(F.avg("br_len").alias("x")).collect()}
    return splits.sparkSession.createDataFrame([(newick_of_splits(kept, taxa, lengths),)], "newick string")


def strict_consensus(splits: DataFrame, n_tax: int) -> DataFrame:
    """(split_key): internal splits of every tree."""
    return split_table(splits).where((F.col("proportion") > 1 - 1e-9) & ~is_trivial(F.col("split_key"), n_tax)).select("split_key")


def resolved(side: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Quartets of a tree of ``first`` and three later taxa: the three, and which of them (1, 2, 3) is ``first``'s mate.

    ``side``: 0 or 1 by split and taxon.  Quartets that no split resolves are left out.
    """
    rest = np.array(list(combinations(range(first + 1, side.shape[1]), 3)), np.int32)
    topology = np.zeros(len(rest), np.int32)
    for s in side == 1:
        a, (b, c, d) = s[first], s[rest].T
        for k, mate in enumerate((b, c, d), 1):
            # The first taxon and its mate on one side, the two others on the other.
            alone = (b == a).astype(int) + (c == a) + (d == a) == 1
            topology[alone & (mate == a)] = k
    found = np.flatnonzero(topology)
    return rest[found], topology[found]


#: Multipliers of a quartet's taxa, and of their sum, for a hash of 32 bits that SQL can work out too.
SPREAD, GOLDEN = (7919, 104729, 1299709, 15485863), 2654435761


def in_sample(first: int, rest: np.ndarray, fraction: float, seed: int = 0) -> np.ndarray:
    """Whether each quartet of ``first`` and three taxa is in a sample: by hash of the four, so the same of every tree."""
    code = first * SPREAD[0] + rest.astype(np.int64) @ np.array(SPREAD[1:], np.int64) + seed
    return (code * GOLDEN) % (1 << 32) < fraction * (1 << 32)


def quartets(splits: DataFrame, n_tax: int, with_first: int | None = None, fraction: float = 1.0) -> DataFrame:
    """(tree_id, a, b, c, d, topology): resolved quartets a < b < c < d; topology 1 is ab|cd, 2 ac|bd, 3 ad|bc.

    A tree's splits are laid over all quartets at once, those of one first taxon at a time; cost is of the fourth power
    in the taxa, and of the third if only the quartets ``with_first`` taxon are asked for.  Of ``fraction`` of them
    (``in_sample``) alone are rows made.
    """
    inner = splits.where(~is_trivial(F.col("split_key"), n_tax)).select("tree_id", "split_key")

    def expand(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        side = memberships(group["split_key"], n_tax)
        out = []
        for first in range(n_tax - 3) if with_first is None else (with_first,):
            rest, topology = resolved(side, first)
            if fraction < 1:
                some = in_sample(first, rest, fraction)
                rest, topology = rest[some], topology[some]
            out.append(pd.DataFrame({"a": first, "b": rest[:, 0], "c": rest[:, 1], "d": rest[:, 2], "topology": topology}))
        found = pd.concat(out)
        return found.assign(tree_id=key[0])[["tree_id", "a", "b", "c", "d", "topology"]]

    return inner.groupBy("tree_id").applyInPandas(expand, "tree_id long, a int, b int, c int, d int, topology int")


def quartet_counts(splits: DataFrame, n_tax: int, with_first: int | None = None, fraction: float = 1.0) -> DataFrame:
    """(a, b, c, d, topology, n): in how many trees each quartet is resolved so.

    Trees of one topology resolve the same quartets, so one of each is expanded and weighs as many as there are.
    """
    kinds = tree_probabilities(splits, n_tax).select(F.col("first_tree").alias("tree_id"), "n")
    some = splits.join(kinds.select("tree_id"), "tree_id", "left_semi")
    return quartets(some, n_tax, with_first, fraction).join(kinds, "tree_id").groupBy("a", "b", "c", "d", "topology").agg(F.sum("n").alias("n"))


def triplet_counts(clades: DataFrame, n_tax: int) -> DataFrame:
    """(a, b, c, topology, n) of rooted clades (tree_id, split_key): topology 1 is a|bc, 2 b|ac, 3 c|ab.

    A rooted tree is an unrooted one with a leaf more, and its triplets are the quartets with that leaf.
    """
    if n_tax < 62:
        one_more = F.shiftleft("split_key", 1)
    else:
        text = F.concat(F.lit("."), split_string(F.col("split_key"), n_tax))
        one_more = of_text(text, n_tax + 1)
    wide = clades.select("tree_id", one_more.alias("split_key"))
    found = quartet_counts(wide, n_tax + 1, 0)
    return found.select((F.col("b") - 1).alias("a"), (F.col("c") - 1).alias("b"), (F.col("d") - 1).alias("c"), "topology", "n")


def quartet_distances(found: DataFrame) -> DataFrame:
    """(i, j, different): quartets resolved in both trees of a pair, but differently, or in one only."""
    n = found.groupBy("tree_id").agg(F.count("*").alias("n"))
    side = lambda t: found.select(F.col("tree_id").alias(t), "a", "b", "c", "d", F.col("topology").alias(f"t{t}"))
    met = side("i").join(side("j"), ["a", "b", "c", "d"]).where("i < j").groupBy("i", "j").agg(F.count_if(F.col("ti") == F.col("tj")).alias("same"), F.count("*").alias("both"))
    a, b = n.select(F.col("tree_id").alias("i"), F.col("n").alias("ni")), n.select(F.col("tree_id").alias("j"), F.col("n").alias("nj"))
    return a.join(b, F.col("i") < F.col("j")).join(met, ["i", "j"], "left").na.fill(0, ["same", "both"]).select("i", "j", (F.col("ni") + F.col("nj") - F.col("both") - F.col("same")).alias("different"))


def leaf_stability(counts: DataFrame, trees: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(tax, ls_max, ls_diff, ls_ent) of ``quartet_counts`` or ``triplet_counts``: means over the leaf's quartets of the
    greatest frequency of a topology, its lead over the second, and one less their entropy by that of three equal ones.

    Frequencies are among the trees that resolve a quartet, or, if the number of ``trees`` is given, among all of them,
    those that do not resolve it counting a third for each topology.  A quartet that no tree resolves has a stability of a
    third, 0 and 0 in the second case, and none in the first.  ``by``: columns of groups told apart in the first case.
    """
    members = [c for c in "abcd" if c in counts.columns]
    n = counts.groupBy(*by, *members).agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x)
    if trees is None:
        q = n.withColumn("ps", F.transform("ns", lambda x: x / total))
    else:
        three = F.concat("ns", F.array_repeat(F.lit(0).cast("long"), 3 - F.size("ns")))
        q = n.withColumn("ps", F.transform(three, lambda x: (x + (F.lit(trees) - total) / 3) / F.lit(trees)))
    ent = F.aggregate("ps", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    q = q.withColumns({"mx": F.get("ps", F.lit(0)), "df": F.get("ps", F.lit(0)) - F.coalesce(F.get("ps", F.lit(1)), F.lit(0.0)), "en": 1 - ent / F.log(F.lit(3.0))})
    each = q.withColumn("tax", F.explode(F.array(*members)))
    found = each.groupBy(*by, "tax").agg(F.sum("mx").alias("mx"), F.sum("df").alias("df"), F.sum("en").alias("en"), F.count("*").alias("k"))
    if trees is None:
        return found.select(*by, "tax", (F.col("mx") / F.col("k")).alias("ls_max"), (F.col("df") / F.col("k")).alias("ls_diff"), (F.col("en") / F.col("k")).alias("ls_ent"))
    # Every leaf is in as many quartets; those that no tree resolves are not among the counts.
    every = n.agg(F.max(F.greatest(*members)).alias("top"), F.min(F.least(*members)).alias("low"))
    taxa = F.col("top") - F.col("low") + 1
    many = (taxa - 1) * (taxa - 2) / 2 if len(members) == 3 else (taxa - 1) * (taxa - 2) * (taxa - 3) / 6
    whole = found.crossJoin(F.broadcast(every)).withColumn("many", many)
    return whole.select("tax", ((F.col("mx") + (F.col("many") - F.col("k")) / 3) / F.col("many")).alias("ls_max"), (F.col("df") / F.col("many")).alias("ls_diff"), (F.col("en") / F.col("many")).alias("ls_ent"))


def sampled_stability(splits: DataFrame, n_tax: int, fraction: float) -> DataFrame:
    """(tax, n, ls_max, ls_diff, and the error of each): leaf stability by a sample of ``fraction`` of the quartets.

    n: the leaf's quartets in the sample.  An error is the standard error of a mean over a part of all quartets drawn
    without replacement, and 0 where the sample is all of them; null with a single quartet.
    """
    counts = quartet_counts(splits, n_tax, None, fraction)
    n = counts.groupBy(*"abcd").agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x)
    q = n.select(*"abcd", (F.get("ns", F.lit(0)) / total).alias("mx"), ((F.get("ns", F.lit(0)) - F.coalesce(F.get("ns", F.lit(1)), F.lit(0))) / total).alias("df"))
    each = q.withColumn("tax", F.explode(F.array(*"abcd")))
    error = lambda c: F.stddev_samp(c) * F.sqrt((1 - F.lit(float(fraction))) / F.count("*"))
    return each.groupBy("tax").agg(F.count("*").alias("n"), F.avg("mx").alias("ls_max"), F.avg("df").alias("ls_diff"), error("mx").alias("ls_max_error"), error("df").alias("ls_diff_error"))


def group_stability(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``leaf_stability`` within each group of ``groups`` (name, tax), by the quartets that lie in it: (name, tax, ls_...)."""
    inside = counts
    # A quartet's four taxa look up their groups one after another.
    for k, c in enumerate("abcd"):
        names = groups.select(F.col("tax").alias(c), "name").distinct()
        inside = inside.join(names, [c] if k == 0 else [c, "name"])
    return leaf_stability(inside, by=("name",))


def support_csv(stability: DataFrame) -> DataFrame:
    """(value): the table as lines of comma-separated values, to be written as text."""
    return stability.select(F.to_csv(F.struct(*stability.columns)).alias("value"))


def leaf_ranks(stability: DataFrame) -> DataFrame:
    """The table with dense ranks of the three measures, best first."""
    return stability.select("*", *[F.dense_rank().over(Window.orderBy(F.desc(F.round(c, 12)))).alias(f"{c}_rank") for c in ("ls_max", "ls_diff", "ls_ent")])


def spa_counts(splits: DataFrame, tree_masks: DataFrame, supertree: DataFrame) -> DataFrame:
    """(tree_id, hits, misses, st, every): of each input tree the splits that the supertree cut to its taxa has and has not,
    how many that has, and how many there could be."""
    own = cut_to_taxa(splits.join(tree_masks, "tree_id"))
    pruned = cut_to_taxa(tree_masks.crossJoin(F.broadcast(supertree.select("split_key"))))
    hit = own.join(pruned.withColumn("hit", F.lit(1)), ["tree_id", "key"], "left").groupBy("tree_id").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    have = pruned.groupBy("tree_id").agg(F.count("*").alias("st"))
    n = in_column(tree_masks, "mask").size(F.col("mask"))
    every = tree_masks.join(hit, "tree_id", "left").join(have, "tree_id", "left").na.fill(0, ["hits", "misses", "st"])
    return every.select("tree_id", "hits", "misses", "st", (F.pow(F.lit(2.0), n - 1) - (n + 1)).alias("every"))


def spa_log_like(splits: DataFrame, tree_masks: DataFrame, supertree: DataFrame, q: float) -> DataFrame:
    """(tree_id, log_like): probability q, shared, for the splits of the cut supertree, 1 - q, shared, for all others that there could be."""
    c = spa_counts(splits, tree_masks, supertree)
    miss = F.when(F.col("st") == 0, 1 / F.col("every")).otherwise((1 - q) / (F.col("every") - F.col("st")))
    return c.select("tree_id", (F.col("hits") * F.log(F.lit(q) / F.greatest("st", F.lit(1))) + F.col("misses") * F.log(miss)).alias("log_like"))


def spa_best(splits: DataFrame, tree_masks: DataFrame, supertree: DataFrame) -> DataFrame:
    """(q, log_like): the q of the greatest likelihood over all input trees, which is the share of hits, and that likelihood."""
    c = spa_counts(splits, tree_masks, supertree).where("st > 0")
    t = c.agg(F.sum("hits").alias("h"), F.sum("misses").alias("m"), F.sum(F.col("hits") * F.log("st") + F.col("misses") * F.log(F.col("every") - F.col("st"))).alias("shared"))
    q = F.col("h") / (F.col("h") + F.col("m"))
    term = lambda n, p: F.when(n > 0, n * F.log(p)).otherwise(0.0)
    return t.select(q.alias("q"), (term(F.col("h"), q) + term(F.col("m"), 1 - q) - F.col("shared")).alias("log_like"))


def rf_log_like(distances: DataFrame, beta: float) -> DataFrame:
    """(log_like): exponential model on the input trees' distances to the supertree, without its normalising constant."""
    return distances.agg((-beta * F.sum("sd")).alias("log_like"))


def common_intersections(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """(inside, outside): what two sets of splits (inside, outside) of different trees share, each side at least ``least``
    and no statement within another: the profile of a reduced strict consensus."""
    sets = in_column(a, "inside")
    x, y = a.select(F.col("inside").alias("ai"), F.col("outside").alias("ao")), b.select(F.col("inside").alias("bi"), F.col("outside").alias("bo"))
    inside, outside = sets.both(F.col("ai"), F.col("bi")), sets.both(F.col("ao"), F.col("bo"))
    met = x.join(y, (sets.size(inside) >= least) & (sets.size(outside) >= least))
    found = met.select(inside.alias("inside"), outside.alias("outside")).distinct()
    wider = found.select(F.col("inside").alias("wi"), F.col("outside").alias("wo"))
    none = lambda a, b: ~sets.some(sets.without(F.col(a), F.col(b)))
    within = none("inside", "wi") & none("outside", "wo") & ((F.col("inside") != F.col("wi")) | (F.col("outside") != F.col("wo")))
    return found.join(wider, within, "left_anti")
