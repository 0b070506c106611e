"""Operators on trees.  Those that only look are joins and aggregates on the node table; those that change a tree are
pure functions of its node list, run a task a tree by ``map_trees``."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkclade.sources.newick import Node, children, numbered, parse_newick, rebuilt, split_keys, write_newick

# -- on the node table (tree_id, num, parent, rank, name, length, is_leaf, last)


def descendants(nodes: DataFrame) -> DataFrame:
    """(tree_id, num, below): every node with each node of its subtree, by the nested ranges of the pre-order."""
    a = nodes.select("tree_id", "num", "last")
    b = nodes.select("tree_id", F.col("num").alias("below"))
    return a.join(b, "tree_id").where((F.col("below") >= F.col("num")) & (F.col("below") <= F.col("last"))).select("tree_id", "num", "below")


def leaf_names(nodes: DataFrame) -> DataFrame:
    """(tree_id, num, names): leaves above each node."""
    leaf = nodes.where("is_leaf").select("tree_id", F.col("num").alias("below"), "name")
    return descendants(nodes).join(leaf, ["tree_id", "below"]).groupBy("tree_id", "num").agg(F.sort_array(F.collect_list("name")).alias("names"))


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent >= 0").groupBy("tree_id", F.col("parent").alias("num")).agg(F.count("*").alias("n_children"))


def tree_length(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent >= 0").groupBy("tree_id").agg(F.sum("length").alias("length"))


def shapes(nodes: DataFrame) -> DataFrame:
    """(tree_id, bifurcating, bi_root, tri_root): all nodes but a trifurcating root have two children."""
    c = child_counts(nodes)
    root = F.max(F.when(F.col("num") == 0, F.col("n_children")))
    others = F.coalesce(F.max(F.when(F.col("num") > 0, (F.col("n_children") != 2).cast("int"))), F.lit(0)) == 0
    return c.groupBy("tree_id").agg((others & root.isin(2, 3)).alias("bifurcating"), (root == 2).alias("bi_root"), (root == 3).alias("tri_root"))


def path_lengths(nodes: DataFrame) -> DataFrame:
    """(tree_id, num, depth): length from the root."""
    up = descendants(nodes).where("num > 0").join(nodes.select("tree_id", "num", "length"), ["tree_id", "num"])
    return up.groupBy("tree_id", F.col("below").alias("num")).agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("depth"))


def patristic_distances(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, d) of each two leaves: the branches that are above one of them only."""
    leaf = nodes.where("is_leaf").select("tree_id", F.col("num").alias("below"), "name")
    above = descendants(nodes).where("num > 0").join(leaf, ["tree_id", "below"]).join(nodes.select("tree_id", "num", "length"), ["tree_id", "num"])
    depth = above.groupBy("tree_id", "name").agg(F.sum("length").alias("depth"))
    one = above.select("tree_id", "num", "length", F.col("name").alias("a"))
    two = above.select("tree_id", "num", F.col("name").alias("b"))
    shared = one.join(two, ["tree_id", "num"]).where("a < b").groupBy("tree_id", "a", "b").agg(F.sum("length").alias("shared"))
    x = depth.select("tree_id", F.col("name").alias("a"), F.col("depth").alias("da"))
    y = depth.select("tree_id", F.col("name").alias("b"), F.col("depth").alias("db"))
    every = x.join(y, "tree_id").where("a < b").join(shared, ["tree_id", "a", "b"], "left")
    return every.select("tree_id", "a", "b", (F.col("da") + F.col("db") - 2 * F.coalesce("shared", F.lit(0.0))).alias("d"))


def triplets(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, outside): rooted triplets ab|outside, a < b, by the deepest node above two leaves."""
    leaf = nodes.where("is_leaf").select("tree_id", F.col("num").alias("below"), "name")
    above = descendants(nodes).join(leaf, ["tree_id", "below"]).select("tree_id", "num", "name")
    pair = above.withColumnRenamed("name", "a").join(above.withColumnRenamed("name", "b"), ["tree_id", "num"]).where("a < b").groupBy("tree_id", "a", "b").agg(F.max("num").alias("num"))
    others = leaf.select("tree_id", F.col("name").alias("outside"))
    inside = above.select("tree_id", "num", F.col("name").alias("outside"))
    return pair.join(others, "tree_id").join(inside, ["tree_id", "num", "outside"], "left_anti").select("tree_id", "a", "b", "outside")


def same_taxa(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """(tree_id, same): whether a tree's leaves are just ``taxa`` (name)."""
    n = taxa.agg(F.count_distinct("name").alias("n"))
    leaf = nodes.where("is_leaf").join(taxa.select("name").distinct().withColumn("known", F.lit(1)), "name", "left")
    return leaf.groupBy("tree_id").agg(F.count_distinct("name").alias("k"), F.count("known").alias("m"), F.count("*").alias("all")).crossJoin(F.broadcast(n)).select("tree_id", ((F.col("k") == F.col("n")) & (F.col("m") == F.col("all"))).alias("same"))


def ladder_order(nodes: DataFrame) -> DataFrame:
    """(tree_id, num, rank): children by the size of their clade, then by number."""
    size = F.col("last") - F.col("num")
    return nodes.where("parent >= 0").select("tree_id", "num", (F.row_number().over(Window.partitionBy("tree_id", "parent").orderBy(size, "num")) - 1).alias("rank"))


# -- a task a tree


def map_trees(trees: DataFrame, f: Callable[[list[Node], random.Random], list[Node]], seed: int = 0, lengths: bool = True) -> DataFrame:
    """``f`` on each tree of (tree_id, newick); its random numbers depend on seed and tree only."""

    from sparkclade.sources.formats import few_trees

    def run(frames):
        for frame in few_trees(frames):
            yield frame.assign(newick=[write_newick(f(parse_newick(x), random.Random(f"{seed}:{t}")), lengths) for t, x in zip(frame["tree_id"], frame["newick"])])

    kind = trees.schema["tree_id"].dataType.simpleString()
    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {kind}, newick string")


def input_trees(trees: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Trees as a supertree's input: each without a random ``share`` of its leaves, three at least staying."""

    def cut(nodes: list[Node], rng: random.Random) -> list[Node]:
        names = sorted(n.name for n in nodes if n.is_leaf)
        return remove_leaves(nodes, set(rng.sample(names, min(int(share * len(names)), max(0, len(names) - 3)))))

    return map_trees(trees, cut, seed)


def find(nodes: list[Node], name: str) -> int:
    return next(n.num for n in nodes if n.name == name)


def suppressed(nodes: list[Node], below: list[list[int]], root: int) -> list[Node]:
    """Nodes with a single child joined with it, lengths added."""
    changed = [replace(n) for n in nodes]
    parent = {c: p for p, cs in enumerate(below) for c in cs}
    for i in range(len(below) - 1, -1, -1):
        if len(below[i]) == 1 and i != root and i in parent:
            c = below[i][0]
            if changed[c].length is not None or changed[i].length is not None:
                changed[c].length = (changed[c].length or 0.0) + (changed[i].length or 0.0)
            at = below[parent[i]].index(i)
            below[parent[i]][at], parent[c], below[i] = c, parent[i], []
    while len(below[root]) == 1 and below[below[root][0]]:
        root = below[root][0]
        changed[root].length = None
    return rebuilt(changed, root, below)


def reroot(nodes: list[Node], at: int) -> list[Node]:
    """The root moved to node ``at``, an internal one; lengths and names of branches go with them."""
    below, changed = children(nodes), [replace(n) for n in nodes]
    path = [at]
    while nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    for child, parent in zip(path[-2::-1], path[:0:-1]):
        below[parent].remove(child)
        below[child].append(parent)
    for k in range(len(path) - 1, 0, -1):
        changed[path[k]].length = nodes[path[k - 1]].length
    changed[at].length = None
    return suppressed(changed, below, at)


def add_between(nodes: list[Node], at: int, share: float = 0.5) -> tuple[list[Node], int]:
    """A new node on the branch of ``at``; returns the tree and the new node's place."""
    below, changed = children(nodes), [replace(n) for n in nodes]
    new, parent, length = len(nodes), nodes[at].parent, nodes[at].length
    changed.append(Node(new, parent, nodes[at].rank, is_leaf=False, length=None if length is None else length * share))
    if length is not None:
        changed[at].length = length * (1 - share)
    below[parent][below[parent].index(at)] = new
    below.append([at])
    out = rebuilt(changed, 0, below)
    return out, next(n.num for n in out if not n.is_leaf and len(children(out)[n.num]) == 1 and n.parent >= 0)


def root_on_branch(nodes: list[Node], at: int, share: float = 0.5) -> list[Node]:
    """A bifurcating root on the branch of ``at``."""
    out, new = add_between(nodes, at, share)
    below, changed = children(out), [replace(n) for n in out]
    path = [new]
    while out[path[-1]].parent >= 0:
        path.append(out[path[-1]].parent)
    for child, parent in zip(path[-2::-1], path[:0:-1]):
        below[parent].remove(child)
        below[child].append(parent)
    for k in range(len(path) - 1, 0, -1):
        changed[path[k]].length = out[path[k - 1]].length
    changed[new].length = None
    return suppressed(changed, below, new)


def remove_root(nodes: list[Node]) -> list[Node]:
    """A bifurcating root made trifurcating, if one of its children is internal."""
    below = children(nodes)
    if len(below[0]) != 2:
        return nodes
    inner = next((c for c in below[0] if below[c]), None)
    return nodes if inner is None else reroot(nodes, inner)


def remove_leaves(nodes: list[Node], names: set[str]) -> list[Node]:
    """The tree without the leaves of these names, and without the nodes that this leaves empty or single."""
    below = children(nodes)
    for n in reversed(nodes):
        if n.parent >= 0 and ((n.is_leaf and n.name in names) or (not n.is_leaf and not below[n.num])):
            below[n.parent].remove(n.num)
    return suppressed(nodes, below, 0)


def keep_leaves(nodes: list[Node], names: set[str]) -> list[Node]:
    return remove_leaves(nodes, {n.name for n in nodes if n.is_leaf and n.name not in names})


def remove_clade(nodes: list[Node], at: int) -> list[Node]:
    below = children(nodes)
    below[nodes[at].parent].remove(at)
    return suppressed(nodes, below, 0)


def collapse(nodes: list[Node], at: int) -> list[Node]:
    """An internal node made one with its parent."""
    below = children(nodes)
    parent = nodes[at].parent
    k = below[parent].index(at)
    below[parent][k : k + 1] = below[at]
    return rebuilt(nodes, 0, below)


def add_leaf(nodes: list[Node], at: int, name: str, length: float | None = None) -> list[Node]:
    """A leaf on the branch of ``at``."""
    out, new = add_between(nodes, at)
    return add_child(out, new, name, length)


def add_child(nodes: list[Node], at: int, name: str, length: float | None = None) -> list[Node]:
    below, changed = children(nodes), [replace(n) for n in nodes]
    changed.append(Node(len(nodes), at, len(below[at]), name, length))
    below.append([])
    below[at].append(len(nodes))
    return rebuilt(changed, 0, below)


def add_subtree(nodes: list[Node], at: int, other: list[Node]) -> list[Node]:
    """Another tree as a child of ``at``."""
    below, changed, n = children(nodes), [replace(x) for x in nodes], len(nodes)
    changed += [replace(x) for x in other]
    below += [[c + n for c in cs] for cs in children(other)]
    below[at].append(n)
    return rebuilt(changed, 0, below)


def subtree(nodes: list[Node], at: int) -> list[Node]:
    out = rebuilt(nodes, at, children(nodes))
    out[0].length = None
    return out


def spr(nodes: list[Node], prune: int, graft: int) -> list[Node]:
    """The subtree at ``prune`` moved onto the branch of ``graft``, which lies outside of it."""
    if nodes[prune].num <= graft <= nodes[prune].last or graft == 0:
        raise ValueError("the branch to graft on is in the subtree, or is none")
    below, changed = children(nodes), [replace(n) for n in nodes]
    below[nodes[prune].parent].remove(prune)
    new, parent = len(nodes), nodes[graft].parent
    half = None if nodes[graft].length is None else nodes[graft].length / 2
    changed.append(Node(new, parent, 0, is_leaf=False, length=half))
    changed[graft].length = half
    below[parent][below[parent].index(graft)] = new
    below.append([graft, prune])
    return suppressed(changed, below, 0)


def random_spr(nodes: list[Node], rng: random.Random) -> list[Node]:
    ways = [(p.num, g.num) for p in nodes[1:] for g in nodes[1:] if not p.num <= g.num <= p.last and g.num != p.parent and g.parent != p.parent]
    return spr(nodes, *rng.choice(ways)) if ways else nodes


def nni(nodes: list[Node], rng: random.Random) -> list[Node]:
    """A child of an internal node exchanged with that node's sister."""
    below = children(nodes)
    inner = [n.num for n in nodes[1:] if not n.is_leaf]
    if not inner:
        return nodes
    at = rng.choice(inner)
    sister = rng.choice([c for c in below[nodes[at].parent] if c != at])
    child = rng.choice(below[at])
    p = nodes[at].parent
    i, j = below[p].index(sister), below[at].index(child)
    below[p][i], below[at][j] = child, sister
    return rebuilt(nodes, 0, below)


def resolve(nodes: list[Node], rng: random.Random, length: float | None = None) -> list[Node]:
    """Polytomies resolved at random; a root of three stays."""
    below, changed = children(nodes), [replace(n) for n in nodes]
    i = 0
    while i < len(below):
        while len(below[i]) > (3 if i == 0 else 2):
            a, b = rng.sample(below[i], 2)
            below[i] = [c for c in below[i] if c not in (a, b)] + [len(below)]
            below.append([a, b])
            changed.append(Node(len(changed), i, 0, is_leaf=False, length=length))
        i += 1
    return rebuilt(changed, 0, below)


def random_tree(taxa: list[str], rng: random.Random, bi_root: bool = False, clades: tuple[frozenset, ...] = ()) -> list[Node]:
    """A bifurcating tree with random lengths; ``clades``, compatible sets of taxa, are in it."""
    sets = sorted({frozenset(c) for c in clades} | {frozenset(taxa)}, key=len)
    text = {frozenset([t]): f"{quote_name(t)}:{rng.uniform(0.02, 0.5):.6f}" for t in taxa}
    for s in sets:
        inner = [k for k in text if k < s and not any(k < m < s for m in text)]
        least = (2 if bi_root else 3) if len(s) == len(taxa) else 1
        pool = [(k, text[k]) for k in inner]
        while len(pool) > max(least, 1) and len(pool) > 1:
            (a, x), (b, y) = (pool.pop(rng.randrange(len(pool))) for _ in range(2))
            pool.append((a | b, f"({x},{y}):{rng.uniform(0.02, 0.05):.6f}"))
        for k in inner:
            text.pop(k, None)
        text[s] = f"({','.join(t for _, t in pool)})" if least > 1 else pool[0][1]
    return parse_newick(text[frozenset(taxa)] + ";")


def quote_name(name: str) -> str:
    from sparkclade.sources.nexus_tokens import quote

    return quote(name)


def randomize_topology(nodes: list[Node], rng: random.Random) -> list[Node]:
    return random_tree([n.name for n in nodes if n.is_leaf], rng, bi_root=len(children(nodes)[0]) == 2)


def all_bi_rooted(nodes: list[Node]) -> list[list[Node]]:
    base = remove_root(nodes)
    return [root_on_branch(base, n.num) for n in base[1:]]


def ladderize(nodes: list[Node], small_first: bool = True) -> list[Node]:
    below = children(nodes)
    for c in below:
        c.sort(key=lambda i: (nodes[i].last - nodes[i].num, i), reverse=not small_first)
    return rebuilt(nodes, 0, below)


def rotate(nodes: list[Node], at: int) -> list[Node]:
    below = children(nodes)
    below[at].reverse()
    return rebuilt(nodes, 0, below)


def line_up_leaves(nodes: list[Node], root_to_leaf: float = 1.0) -> list[Node]:
    """Lengths such that all leaves are equally far: inner levels evenly spaced, by their height above the leaves."""
    below, out = children(nodes), [replace(n) for n in nodes]
    height = [0] * len(nodes)
    for n in reversed(nodes):
        height[n.num] = 1 + max(height[c] for c in below[n.num]) if below[n.num] else 0
    for n in out[1:]:
        n.length = (height[n.parent] - height[n.num]) * root_to_leaf / height[0]
    return out


def rename_leaves(nodes: list[Node], names: dict[str, str]) -> list[Node]:
    return [replace(n, name=names.get(n.name, n.name)) if n.is_leaf else n for n in nodes]


def restore_duplicates(nodes: list[Node], duplicates: dict[str, list[str]]) -> list[Node]:
    """Each kept leaf with duplicates becomes a polytomy of all of them at no distance."""
    out = numbered([replace(n) for n in nodes])
    for name, others in duplicates.items():
        at = find(out, name)
        out[at].name, out[at].is_leaf = None, False
        for n in [name, *others]:
            out = add_child(out, at, n, 0.0)
    return out


def remove_omnipresent_cherries(trees: list[list[Node]]) -> tuple[list[list[Node]], dict[str, str]]:
    """Cherries found in every tree cut down to their first leaf; returns the trees and what went with what."""
    def cherries(nodes: list[Node]) -> set[tuple[str, str]]:
        below = children(nodes)
        return {tuple(sorted(nodes[c].name for c in cs)) for cs in below if len(cs) == 2 and all(nodes[c].is_leaf for c in cs)}

    gone: dict[str, str] = {}
    while common := set.intersection(*map(cherries, trees)):
        a, b = min(common)
        gone[b] = a
        trees = [remove_leaves(t, {b}) for t in trees]
    return trees, gone


def aho_build(triplets_: set[tuple[str, str, str]], leaves: set[str]) -> str | None:
    """Newick of the tree that shows all rooted triplets ab|c, None if there is none."""
    if len(leaves) <= 2:
        return f"({','.join(sorted(leaves))})" if len(leaves) == 2 else next(iter(leaves))
    up = {x: x for x in leaves}

    def top(x: str) -> str:
        while up[x] != x:
            x = up[x]
        return x

    for a, b, c in triplets_:
        if {a, b, c} <= leaves:
            up[top(a)] = top(b)
    parts: dict[str, set[str]] = {}
    for x in leaves:
        parts.setdefault(top(x), set()).add(x)
    if len(parts) == 1:
        return None
    kids = [aho_build(triplets_, p) for p in sorted(parts.values(), key=min)]
    return None if None in kids else f"({','.join(kids)})"


def quartet_closure(quartets_: set[tuple[frozenset, frozenset]], rounds: int = 100) -> set[tuple[frozenset, frozenset]]:
    """Dyadic closure: ab|cd and ab|ce give ab|de; ab|cd and ac|de give ab|ce, ab|de and bc|de."""
    norm = lambda x, y: tuple(sorted((frozenset(x), frozenset(y)), key=sorted))
    now = {norm(x, y) for x, y in quartets_}
    for _ in range(rounds):
        new = set()
        both = [s for q in now for s in (q, q[::-1])]
        for x, y in both:
            for u, v in both:
                if x == u and len(y & v) == 1:
                    new.add(norm(x, (y | v) - (y & v)))
                if len(x & u) == 1 and len(y & v) == 1 and len(y & u) == 1 and len(x & v) == 0:
                    a, c, d, e, b = x & u, y & u, y & v, v - y, x - u
                    if len(e) == 1 and len(b) == 1 and a != c:
                        new |= {norm(a | b, c | e), norm(a | b, d | e), norm(b | c, d | e)}
        new = {q for q in new if len(q[0]) == len(q[1]) == 2 and not q[0] & q[1]} - now
        if not new:
            break
        now |= new
    return now


def text_drawing(nodes: list[Node], width: int = 60) -> list[str]:
    """Lines of a drawing: a line a leaf, branches by depth."""
    below, depth = children(nodes), [0] * len(nodes)
    for n in nodes[1:]:
        depth[n.num] = depth[n.parent] + 1
    step = max(2, (width - 12) // max(1, max(depth)))
    rows: list[str] = []

    def draw(i: int, prefix: str, last: bool, root: bool) -> None:
        mark = "" if root else ("`" if last else "|") + "-" * (step - 1)
        rows.append(prefix + mark + (nodes[i].name or "+"))
        inner = prefix + ("" if root else (" " if last else "|") + " " * (step - 1))
        for k, c in enumerate(below[i]):
            draw(c, inner, k == len(below[i]) - 1, False)

    draw(0, "", True, True)
    return rows


def root_on_reference(nodes: list[Node], reference: list[Node], taxa: dict[str, int]) -> int | None:
    """The node of ``reference`` whose branch is the split at this tree's bifurcating root, if there is one."""
    first = next(k for n, _, k, _ in split_keys(nodes, taxa) if nodes[n].parent == 0)
    return next((n for n, _, k, _ in split_keys(reference, taxa) if k == first), None)
