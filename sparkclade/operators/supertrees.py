"""Supertrees and summaries of trees of different taxa.

Taxa are bits of a long.  ``splits`` (tree_id, split_key) and ``masks`` (tree_id, mask), the taxa of each tree; a split cut
to a tree's taxa is named by the part without the lowest of them.  What many trees say of four taxa is one table of
quartets, (four, side, n): their mask, the lowest taxon and its mate, and how many trees resolve them so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut as checkpointed
from .splits import resolved


def bits(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def cut(key: Column, mask: Column) -> Column:
    """A split cut to the taxa of ``mask``: the part without the lowest of them."""
    part = key.bitwiseAND(mask)
    return F.when(part.bitwiseAND(mask).bitwiseAND(mask.bitwiseAND(-mask)) != 0, part.bitwiseXOR(mask)).otherwise(part)


def cut_trees(splits: DataFrame, masks: DataFrame) -> DataFrame:
    """(mask, keys, n): the different trees, by taxa and internal splits in order, and how many there are of each."""
    key = splits.join(masks, "tree_id").select("tree_id", "mask", cut(F.col("split_key"), F.col("mask")).alias("key"))
    inner = key.where((F.bit_count("key") > 1) & (F.bit_count("key") < F.bit_count("mask") - 1))
    each = inner.groupBy("tree_id", "mask").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return each.groupBy("mask", "keys").agg(F.count("*").alias("n"))


# -- quartets


def quartet_table(splits: DataFrame, masks: DataFrame) -> DataFrame:
    """(four, side, n): in how many trees four taxa are resolved so.  Equal trees are expanded once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for mask, keys, n in zip(f["mask"].tolist(), f["keys"], f["n"].tolist()):
                taxa = np.array(bits(mask), np.int64)
                side, bit = (np.array(keys, np.int64)[:, None] >> taxa) & 1, np.int64(1) << taxa
                for first in range(len(taxa) - 3):
                    rest, mate = resolved(side, first)
                    pair = bit[first] | bit[rest[np.arange(len(rest)), mate - 1]]
                    yield pd.DataFrame({"four": bit[first] | bit[rest].sum(1), "side": pair, "n": n})

    # Few rows with much work each: dealt out anew.
    trees = cut_trees(splits, masks).repartition("mask", "keys")
    return trees.mapInPandas(run, "four long, side long, n long").groupBy("four", "side").agg(F.sum("n").alias("n"))


class Growing:
    """A binary tree that grows by leaves: at each node three masks of the leaves behind its three ports.

    A port keeps its number whatever is added behind it, and three leaves part at one node for ever.
    """

    def __init__(self, four: int, side: int):
        (a, b), (c, d) = ([1 << i for i in bits(m)] for m in (side, four ^ side))
        self.placed, self.nodes = four, [[a, b, c | d], [a | b, c, d]]

    def edges(self) -> list[int]:
        """Each edge once, as the part of the leaves without the lowest, in order."""
        low = self.placed & -self.placed
        return sorted({m ^ self.placed if m & low else m for ports in self.nodes for m in ports})

    def port_of(self, ports: list[int], edge: int) -> int:
        """The port that an edge lies behind, or leaves the node by."""
        return next(k for k, m in enumerate(ports) if not edge & ~m or not (self.placed ^ edge) & ~m)

    def add(self, tax: int, edge: int) -> None:
        bit = 1 << tax
        for ports in self.nodes:
            ports[self.port_of(ports, edge)] |= bit
        self.nodes.append([edge, self.placed ^ edge, bit])
        self.placed |= bit

    def triples(self, new: int) -> list[tuple[int, int, int, int]]:
        """(three, mate, node, port) of every three leaves, of which one at least is in ``new``, and each of them."""
        out = []
        for k, ports in enumerate(self.nodes):
            leaves = [[1 << i for i in bits(m)] for m in ports]
            if new.bit_count() == 1:
                leaves = [[new] if m & new else x for m, x in zip(ports, leaves)]
            for three in product(*leaves):
                if sum(three) & new:
                    out += [(sum(three), x, k, port) for port, x in enumerate(three)]
        return out

    def open_edges(self, votes: dict[tuple[int, int], int]) -> list[int]:
        """Edges that ``votes`` (node, port) of a taxon leave open, from the most central node on: the ports of most votes stay."""
        edges = self.edges()
        behind = [[0, 0, 0] for _ in self.nodes]
        for i, e in enumerate(edges):
            for k, ports in enumerate(self.nodes):
                behind[k][self.port_of(ports, e)] |= 1 << i
        left = (1 << len(edges)) - 1
        for k in sorted(range(len(self.nodes)), key=lambda k: (-math.prod(m.bit_count() for m in self.nodes[k]), k)):
            n = [votes.get((k, p), 0) if left & behind[k][p] else -1 for p in range(3)]
            if max(n) > 0:
                left &= sum(behind[k][p] for p in range(3) if n[p] == max(n))
        return [e for i, e in enumerate(edges) if left >> i & 1]


@dataclass
class Joined:
    """A supertree: its internal splits, the taxa it has, and for each that it lacks the edges where it could go."""

    splits: list[int]
    placed: int
    unplaced: dict[int, list[int]]


def quartet_joining(quartets: DataFrame, break_ties: bool = True) -> Joined:
    """The supertree of a quartet table, by stepwise addition of the taxon that its quartets place best.

    It begins with the quartet of most trees.  A quartet of three placed taxa and another one votes at the node where the
    three part, for the port of the other's mate.  Both outlast later additions, so votes are only ever added: each
    addition is one aggregation over the quartets that have the new taxon, three placed ones and one that is not, and
    brings a row for each taxon, node and port.  Of the taxa whose votes leave one edge, that of most votes goes next,
    ties by number.  If there is none, that of the fewest edges goes to the first of them, or, unless ``break_ties``,
    the tree stays without.
    """
    spark = quartets.sparkSession
    table = checkpointed(quartets.select("four", "side", "n"))
    start = table.orderBy(F.desc("n"), "four", "side").limit(1).collect()
    if not start:
        return Joined([], 0, {})
    taxa = table.agg(F.bit_or("four").alias("taxa")).first().taxa
    tree, new = Growing(start[0].four, start[0].side), start[0].four
    votes: dict[int, dict[tuple[int, int], int]] = {i: {} for i in bits(taxa & ~tree.placed)}
    while votes:
        for r in votes_of(spark, table, tree, new).collect():
            mine = votes[r.other.bit_length() - 1]
            mine[r.node, r.port] = mine.get((r.node, r.port), 0) + r.n
        found = {x: tree.open_edges(v) for x, v in votes.items()}
        fewest = min(len(e) for e in found.values())
        if fewest > 1 and not break_ties:
            return Joined(internal(tree), tree.placed, found)
        x = min((x for x, e in found.items() if len(e) == fewest), key=lambda x: (-sum(votes[x].values()), x))
        tree.add(x, found[x][0])
        new = 1 << x
        del votes[x]
    return Joined(internal(tree), tree.placed, {})


def votes_of(spark: SparkSession, table: DataFrame, tree: Growing, new: int) -> DataFrame:
    """(other, node, port, n): votes of the quartets of three placed taxa, ``new`` among them, and another one."""
    placed = F.lit(tree.placed)
    # Three rows for each two leaves: its size is that of the taxa squared, whatever the number of trees.
    cells = [pa.array(x, pa.int64()) for x in zip(*tree.triples(new))]
    parts = spark.createDataFrame(pa.table(cells, ["three", "mate", "node", "port"]))
    other = F.col("four").bitwiseAND(F.bitwise_not(placed))
    some = table.where((F.bit_count(F.col("four").bitwiseAND(placed)) == 3) & (F.col("four").bitwiseAND(F.lit(new)) != 0)).withColumns({"other": other, "three": F.col("four").bitwiseAND(placed)})
    pair = F.when(F.col("side").bitwiseAND(F.col("other")) != 0, F.col("side")).otherwise(F.col("four").bitwiseXOR(F.col("side")))
    return some.withColumn("mate", pair.bitwiseXOR(F.col("other"))).join(F.broadcast(parts), ["three", "mate"]).groupBy("other", "node", "port").agg(F.sum("n").alias("n"))


def internal(tree: Growing) -> list[int]:
    return [e for e in tree.edges() if 1 < e.bit_count() < tree.placed.bit_count() - 1]


# -- quartet likelihood


def quartet_hits(quartets: DataFrame, supertree: DataFrame, n_tax: int) -> DataFrame:
    """(hits, misses, st, every): input quartets that the supertree (split_key) has and has not, each as often as there are
    trees, the supertree's own quartets, and all that there could be.

    Both sides are keyed by four taxa and their resolution, so only quartets that are equal meet.
    """
    spark = quartets.sparkSession
    one = supertree.select(F.lit(0).alias("tree_id"), "split_key")
    own = quartet_table(one, spark.createDataFrame([(0, (1 << n_tax) - 1)], "tree_id int, mask long")).select("four", "side", F.lit(1).alias("hit"))
    met = quartets.join(own, ["four", "side"], "full")
    n = F.coalesce("n", F.lit(0))
    found = met.agg(F.sum(F.when(F.col("hit").isNotNull(), n)).alias("hits"), F.sum(F.when(F.col("hit").isNull(), n)).alias("misses"), F.count("hit").alias("st"))
    return found.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "misses")], "st", F.lit(3 * math.comb(n_tax, 4)).alias("every"))


def qpa_log_like(hits: DataFrame, q: float) -> DataFrame:
    """(log_like) of ``quartet_hits``: probability q, shared, for the supertree's quartets, and 1 - q, shared, for the others."""
    miss = F.when(F.col("st") == 0, 1 / F.col("every")).otherwise((1 - q) / (F.col("every") - F.col("st")))
    return hits.select((F.col("hits") * F.log(F.lit(q) / F.greatest("st", F.lit(1))) + F.col("misses") * F.log(miss)).alias("log_like"))


def qpa_best(hits: DataFrame) -> DataFrame:
    """(q, log_like): the q of the greatest likelihood, which is the share of hits, and that likelihood."""
    q = F.col("hits") / (F.col("hits") + F.col("misses"))
    term = lambda n, p, share: F.when(n > 0, n * F.log(p / share)).otherwise(0.0)
    return hits.select(q.alias("q"), (term(F.col("hits"), q, F.col("st")) + term(F.col("misses"), 1 - q, F.col("every") - F.col("st"))).alias("log_like"))


# -- trees by their distance to one


def double_factorial(n: int) -> int:
    return math.prod(range(n, 0, -2))


def trees_by_shared(mask: int, keys: list[int]) -> list[int]:
    """How many binary trees on the taxa of ``mask`` share just s = 0, 1, ... of the compatible internal splits ``keys``.

    A set of s kept edges cuts the tree into parts; a part of k ends can be resolved in (2k - 5)!! ways, and the product
    over parts counts the trees that hold the set.  A pass from the leaves sums it over all sets, by their size and the
    ends of the part still open; inclusion and exclusion turn holding into holding no other.
    """
    ways = lambda ends: double_factorial(2 * ends - 5)
    low = mask & -mask
    full = mask ^ low
    sets = sorted({*keys, full}, key=int.bit_count)
    parent = {k: next(m for m in sets[i + 1 :] if not k & ~m) for i, k in enumerate(sets) if k != full}
    # (kept edges, ends of the open part) with weights, of what hangs from each clade.
    below: dict[int, dict[tuple[int, int], int]] = {}
    for k in sets:
        inner = [c for c in parent if parent[c] == k]
        alone = (k & ~sum(inner)).bit_count()
        here = {(0, alone): 1}
        for c in inner:
            grown: dict[tuple[int, int], int] = {}
            for ((s, e), x), ((t, f), y) in product(here.items(), below[c].items()):
                for at, z in (((s + t, e + f), x * y), ((s + t + 1, e + 1), x * y * ways(f + 1))):
                    grown[at] = grown.get(at, 0) + z
            here = grown
        below[k] = here
    held = [0] * (len(sets))
    for (s, e), x in below[full].items():
        held[s] += x * ways(e + 1)
    return [sum((-1) ** (j - s) * math.comb(j, s) * held[j] for j in range(s, len(held))) for s in range(len(held))]


def log_normaliser(mask: int, keys: list[int], beta: float) -> float:
    """Log of the sum over all binary trees on ``mask`` of exp(-beta x symmetric difference to the tree of ``keys``)."""
    n = mask.bit_count()
    if n < 4:
        return 0.0
    terms = [math.log(x) - beta * (n - 3 + len(keys) - 2 * s) for s, x in enumerate(trees_by_shared(mask, keys)) if x]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def log_normalisers(masks: DataFrame, supertree: DataFrame, beta: float) -> DataFrame:
    """(mask, log_z) of the supertree (split_key) cut to each different mask: worked out once a mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"mask": f["mask"], "log_z": [log_normaliser(m, [int(x) for x in k], beta) for m, k in zip(f["mask"].tolist(), f["keys"])]})

    # The supertree has fewer splits than there are taxa.
    pairs = masks.select("mask").distinct().crossJoin(F.broadcast(supertree.select("split_key")))
    key = cut(F.col("split_key"), F.col("mask"))
    some = (F.bit_count("key") > 1) & (F.bit_count("key") < F.bit_count("mask") - 1)
    keyed = pairs.withColumn("key", key).groupBy("mask").agg(F.array_compact(F.collect_set(F.when(some, F.col("key")))).alias("keys"))
    return keyed.repartition("mask").mapInPandas(run, "mask long, log_z double")


def rf_log_likes(distances: DataFrame, masks: DataFrame, supertree: DataFrame, beta: float) -> DataFrame:
    """(tree_id, log_like): exponential model on each input tree's distance (tree_id, sd) to the cut supertree, normalised."""
    z = log_normalisers(masks, supertree, beta)
    return distances.join(masks, "tree_id").join(z, "mask").select("tree_id", (-beta * F.col("sd") - F.col("log_z")).alias("log_like"))


# -- reduced consensus


def statements(splits: DataFrame, masks: DataFrame) -> DataFrame:
    """(tree, inside, outside, weight): the internal splits of the different trees (grp, tree_id, ...), as the taxa on either side."""
    key = splits.join(masks, "tree_id").withColumn("key", cut(F.col("split_key"), F.col("mask")))
    inner = key.where((F.bit_count("key") > 1) & (F.bit_count("key") < F.bit_count("mask") - 1))
    each = inner.groupBy("grp", "tree_id", "mask").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    kinds = each.groupBy("grp", "mask", "keys").agg(F.count("*").alias("weight"), F.min("tree_id").alias("tree"))
    return kinds.select("grp", "tree", F.explode("keys").alias("inside"), "mask", "weight").select("grp", "tree", "inside", F.col("mask").bitwiseAND(F.bitwise_not("inside")).alias("outside"), "weight")


def lowest_two(mask: Column) -> Column:
    """The two lowest bits of a mask."""
    rest = mask.bitwiseAND(mask - 1)
    return (mask.bitwiseXOR(rest)).bitwiseOR(rest.bitwiseAND(-rest))


def pairs_of(mask: Column) -> Column:
    """All masks of two bits of ``mask``."""
    each = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(62)]), lambda b: mask.bitwiseAND(b) != 0)
    return F.flatten(F.transform(each, lambda a: F.transform(F.filter(each, lambda b: b > a), lambda b: a.bitwiseOR(b))))


def both_ways(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` with each statement told from either side."""
    return rows.select(*keep, "inside", "outside").union(rows.select(*keep, F.col("outside").alias("inside"), F.col("inside").alias("outside")))


def canonical(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` with the side that has the lowest taxon as the outside."""
    swap = F.col("inside").bitwiseAND(-F.col("inside")) < F.col("outside").bitwiseAND(-F.col("outside"))
    return rows.select(*keep, F.when(swap, F.col("outside")).otherwise(F.col("inside")).alias("inside"), F.when(swap, F.col("inside")).otherwise(F.col("outside")).alias("outside"))


def widest(rows: DataFrame) -> DataFrame:
    """(grp, tree, inside, outside, n) without the statements that lie within another one of the group of as many trees.

    A wider statement holds the two lowest taxa of a narrower one's inside, on one side or the other: an index of
    statements by pairs of taxa, so that no statement meets those it shares nothing with.
    """
    best = rows.groupBy("grp", "tree", "inside", "outside").agg(F.max("n").alias("n"))
    index = both_ways(best, "grp", "tree", "n").select("grp", "tree", F.explode(pairs_of(F.col("inside"))).alias("pair"), F.col("inside").alias("wi"), F.col("outside").alias("wo"), F.col("n").alias("wn"))
    wider = (F.col("inside").bitwiseAND(F.bitwise_not("wi")) == 0) & (F.col("outside").bitwiseAND(F.bitwise_not("wo")) == 0) & (F.col("wn") >= F.col("n")) & (F.bit_count("wi") + F.bit_count("wo") > F.bit_count("inside") + F.bit_count("outside"))
    keyed = best.withColumn("pair", lowest_two(F.col("inside")))
    within = keyed.join(index, ["grp", "tree", "pair"]).where(wider).select("grp", "tree", "inside", "outside").distinct()
    return best.join(within, ["grp", "tree", "inside", "outside"], "left_anti")


def reduced_profile(splits: DataFrame, masks: DataFrame, share: float | None = None, groups: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(grp, inside, outside, excluded, n, proportion): the reduced consensus of the trees of each group (tree_id, grp).

    A statement parts ``least`` taxa or more from as many; a tree has it if one of its splits parts them.  Those that all
    trees have (``share`` None: strict), or more than ``share`` of them (0.5: majority), and that no wider one of as many
    trees covers, are the profile; ``excluded`` are the group's taxa that a statement leaves out.

    Statements of trees are intersections of their splits.  Groups of trees merge two by two, in as many rounds as the
    logarithm of the different trees: what two hold together, and, if not all trees need agree, what either holds
    alone, as far as enough trees remain.  Statements that lie within others go after each round.  Intersections are
    found by an equi join on the two lowest taxa that they share on one side.
    """
    rows = splits.select("tree_id", "split_key").join(groups, "tree_id") if groups is not None else splits.select("tree_id", "split_key", F.lit(0).alias("grp"))
    told = statements(rows, masks)
    if groups is None:
        counted = masks.select("tree_id", "mask", F.lit(0).alias("grp"))
    else:
        counted = masks.join(groups, "tree_id").select("tree_id", "mask", "grp")
    total = counted.groupBy("grp").agg(F.count("*").alias("trees"), F.bit_or("mask").alias("every"))
    need = F.col("trees") if share is None else F.floor(F.col("trees") * share) + 1
    total = total.withColumn("need", need)
    # Trees without internal splits have no statement, but count among all.
    numbered = told.select("grp", "tree", "weight").distinct()
    order = checkpointed(numbered.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("tree")) - 1))
    total = checkpointed(total)
    state = told.join(order.select("grp", "tree", "k"), ["grp", "tree"]).select("grp", F.col("k").cast("long").alias("tree"), "inside", "outside", F.col("weight").alias("n"))
    size = order.select("grp", F.col("k").cast("long").alias("tree"), "weight")
    left = order.agg((F.max("k") + 1).alias("k")).first().k or 0
    state = checkpointed(canonical(state, "grp", "tree", "n"))
    while left > 1:
        half = lambda k: F.floor(F.col("tree") / 2) if k is None else F.col("tree") % 2 == k
        a, b = state.where(half(0)), state.where(half(1))
        left_side = both_ways(a, "grp", "tree", "n").withColumn("tree", half(None)).select("grp", "tree", F.explode(pairs_of(F.col("inside"))).alias("pair"), "inside", "outside", "n")
        right_side = b.withColumn("tree", half(None)).select("grp", "tree", F.explode(pairs_of(F.col("inside"))).alias("pair"), F.col("inside").alias("bi"), F.col("outside").alias("bo"), F.col("n").alias("bn"))
        inside, outside = F.col("inside").bitwiseAND(F.col("bi")), F.col("outside").bitwiseAND(F.col("bo"))
        met = left_side.join(right_side, ["grp", "tree", "pair"]).where((lowest_two(inside) == F.col("pair")) & (F.bit_count(inside) >= least) & (F.bit_count(outside) >= least))
        met = met.select("grp", "tree", inside.alias("inside"), outside.alias("outside"), (F.col("n") + F.col("bn")).alias("n"))
        found = canonical(met, "grp", "tree", "n")
        merged = size.withColumn("tree", half(None)).groupBy("grp", "tree").agg(F.sum("weight").alias("weight"))
        alone = state.withColumn("tree", half(None)).select("grp", "tree", "n", "inside", "outside")
        found = found.unionByName(alone)
        # What lacks too many trees already cannot reach the share.
        enough = found.join(F.broadcast(merged), ["grp", "tree"]).join(F.broadcast(total.select("grp", "trees", "need")), "grp").where(F.col("n") + F.col("trees") - F.col("weight") >= F.col("need"))
        # Every round begins with a short plan: the tables are read twice or more in each.
        state = checkpointed(widest(checkpointed(enough.select("grp", "tree", "inside", "outside", "n"))))
        size, left = merged, (left + 1) // 2
    every = checkpointed(state.join(F.broadcast(total), "grp").where(F.col("n") >= F.col("need")))
    best = widest(every.select("grp", F.lit(0).cast("long").alias("tree"), "inside", "outside", "n"))
    out = F.col("every").bitwiseAND(F.bitwise_not(F.col("inside").bitwiseOR(F.col("outside"))))
    return best.join(F.broadcast(total), "grp").select("grp", "inside", "outside", out.alias("excluded"), "n", (F.col("n") / F.col("trees")).alias("proportion"))
