"""Trees: Newick and NEXUS tree text to flat node records and back.

A tree in memory is a list of nodes in pre-order, each a ``Node`` with its parent's place; that is also the node table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .nexus_tokens import quote, unquote

TOKEN = re.compile(r"\s*(\[(?:[^\[\]]|\[[^\]]*\])*\]|'(?:[^']|'')*'|[(),:;]|[^\s()\[\],:;']+)")


@dataclass
class Node:
    num: int
    parent: int
    rank: int
    name: str | None = None
    length: float | None = None
    comment: str | None = None
    is_leaf: bool = True
    #: Place of the last node of the subtree; a node's subtree is the range from its own place to this.
    last: int = 0


def parse_newick(text: str, translation: dict[str, str] | None = None) -> list[Node]:
    """Nodes in pre-order.  Raises ValueError for text that is no single tree."""
    nodes: list[Node] = []
    open_: list[int] = []
    counts: dict[int, int] = {}
    at, now, want_length, done = 0, -1, False, False

    def add() -> int:
        parent = open_[-1] if open_ else -1
        counts[parent] = counts.get(parent, -1) + 1
        nodes.append(Node(len(nodes), parent, counts[parent]))
        if parent >= 0:
            nodes[parent].is_leaf = False
        return len(nodes) - 1

    def named(n: int, name: str) -> None:
        if nodes[n].name is not None:
            raise ValueError(f"two names, {nodes[n].name!r} and {name!r}, at one node")
        nodes[n].name = name

    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:at + 20]!r}")
        at, t = m.end(), m[1]
        if t.startswith("["):
            if now >= 0:
                nodes[now].comment = (nodes[now].comment or "") + t[1:-1]
        elif done:
            raise ValueError(f"{t!r} after the tree's end")
        elif t == "(":
            if now >= 0:
                raise ValueError("a parenthesis opens after a node")
            open_.append(add())
        elif t in ",)":
            if not open_:
                raise ValueError(f"{t!r} outside of parentheses")
            if now < 0:
                add()
            now = -1
            want_length = False
            if t == ")":
                now = open_.pop()
        elif t == ":":
            if now < 0:
                now = add()
            want_length = True
        elif t == ";":
            done = True
        elif want_length:
            nodes[now].length, want_length = float(t), False
        else:
            name = unquote(t)
            if now < 0:
                now = add()
                named(now, (translation or {}).get(name, name))
            else:
                named(now, name)
    if open_ or not nodes or sum(n.parent < 0 for n in nodes) != 1:
        raise ValueError("parentheses don't match, or there is no single root")
    return numbered(nodes)


def numbered(nodes: list[Node]) -> list[Node]:
    """``last`` set from the pre-order."""
    for n in nodes:
        n.last = n.num
    for n in reversed(nodes):
        if n.parent >= 0:
            nodes[n.parent].last = max(nodes[n.parent].last, n.last)
    return nodes


def children(nodes: list[Node]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for n in nodes:
        if n.parent >= 0:
            out[n.parent].append(n.num)
    return [sorted(c, key=lambda i: nodes[i].rank) for c in out]


def rebuilt(nodes: list[Node], root: int, below: list[list[int]]) -> list[Node]:
    """A tree from child lists, renumbered in pre-order from ``root``; nodes that are not reached go."""
    out: list[Node] = []
    stack = [(root, -1, 0)]
    while stack:
        i, parent, rank = stack.pop()
        out.append(replace(nodes[i], num=len(out), parent=parent, rank=rank, is_leaf=not below[i], length=nodes[i].length))
        stack += [(c, out[-1].num, k) for k, c in reversed(list(enumerate(below[i])))]
    return numbered(out)


def write_newick(nodes: list[Node], lengths: bool = True, names: dict[str, str] | None = None, comments: bool = False) -> str:
    below, done = children(nodes), {}
    for n in reversed(nodes):
        text = f"({','.join(done[c] for c in below[n.num])})" if below[n.num] else ""
        if n.name is not None:
            text += quote((names or {}).get(n.name, n.name))
        if comments and n.comment:
            text += f"[{n.comment}]"
        if lengths and n.length is not None and n.parent >= 0:
            text += f":{n.length:.10g}"
        done[n.num] = text
    return done[0] + ";"


def split_keys(nodes: list[Node], taxa: dict[str, int]) -> list[tuple[int, int, int, float | None]]:
    """(node, raw key, canonical key, length) of every branch: a raw key has the bits of the leaves above the branch."""
    raw = [0] * len(nodes)
    full = (1 << len(taxa)) - 1
    for n in reversed(nodes):
        if n.is_leaf:
            raw[n.num] = 1 << taxa[n.name]
        if n.parent >= 0:
            raw[n.parent] |= raw[n.num]
    return [(n.num, raw[n.num], raw[n.num] ^ full if raw[n.num] & 1 else raw[n.num], n.length) for n in nodes if n.parent >= 0]


def split_text(key: int, n_tax: int) -> str:
    return "".join("*" if key >> i & 1 else "." for i in range(n_tax))
