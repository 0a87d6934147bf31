"""Set similarity links inside one block, by a prefix tree over globally ordered sets.

Every component found so far keeps a compressed trie of its sets. A set is tested against the tries of the
components with which it shares a prefix element: the walk carries the overlap along shared paths, leaves a
subtree when the longest possible overlap with any length below it is too small, and stops at its first link,
as one link joins the component. Components are what the caller needs, so sets already together are not compared.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class Node:
    __slots__ = ("children", "edge", "ends", "high", "low")

    def __init__(self, edge: np.ndarray, length: int, ends: bool):
        self.edge, self.children, self.low, self.high, self.ends = edge, {}, length, length, ends


class Trie:
    def __init__(self):
        self.children: dict[int, Node] = {}

    def insert(self, x: np.ndarray) -> None:
        at, children, n = 0, self.children, len(x)
        while True:
            node = children.get(int(x[at]))
            if node is None:
                children[int(x[at])] = Node(x[at:], n, True)
                return
            k = min(len(node.edge), n - at)
            differ = np.flatnonzero(node.edge[:k] != x[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(node.edge):  # split the edge
                top = Node(node.edge[:same], node.low, False)
                top.high, top.children[int(node.edge[same])] = node.high, node
                node.edge = node.edge[same:]
                children[int(x[at])] = node = top
            node.low, node.high = min(node.low, n), max(node.high, n)
            at += same
            if at == n:
                node.ends = True
                return
            children = node.children

    def links(self, x: np.ndarray, member: np.ndarray, num: int, den: int) -> bool:
        """Has a stored set y with den * |x & y| >= num * |x | y|? member: x as flags over all elements."""
        n, both = len(x), num + den
        stack = [(c, 0, 0) for c in self.children.values()]
        while stack:
            node, depth, overlap = stack.pop()
            overlap += int(np.count_nonzero(member[node.edge]))
            depth += len(node.edge)
            rest = n - int(np.searchsorted(x, node.edge[-1], "right"))
            if node.ends and both * overlap >= num * (n + depth):
                return True
            if node.children:
                y = min(max(rest + depth, node.low), node.high)
                if both * (overlap + min(rest, y - depth)) >= num * (n + y):
                    stack.extend((c, depth, overlap) for c in node.children.values())
        return False


def prefix_size(n: int, num: int, den: int) -> int:
    """Two linked sets share one of their first prefix_size elements in any common order."""
    return n - -(-num * n // den) + 1


def components(sets: list[np.ndarray], num: int, den: int, labels: list | None = None) -> list[int]:
    """For each sorted set, the index of a representative of its component. Sets of equal label start together."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if labels is not None:
        first: dict = {}
        for i, c in enumerate(labels):
            parent[i] = first.setdefault(c, i)
    elements = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    ranks = [np.searchsorted(elements, s) for s in sets]
    member = np.zeros(len(elements), bool)
    tries: dict[int, Trie] = defaultdict(Trie)
    inside: dict[int, list[int]] = defaultdict(list)
    index: dict[int, set[int]] = defaultdict(set)
    for i in sorted(range(len(sets)), key=lambda i: (len(ranks[i]), i)):
        x = ranks[i]
        if not len(x):
            continue
        own = root(i)
        prefix = x[: prefix_size(len(x), num, den)].tolist()
        near = set()
        for e in prefix:
            if e in index:
                index[e] = {root(c) for c in index[e]}
                near |= index[e]
        member[x] = True
        for c in sorted(near):
            a, b = root(c), root(i)
            if a != b and tries[a].links(x, member, num, den):
                if len(inside[a]) < len(inside[b]):
                    a, b = b, a
                parent[b] = a
                for k in inside.pop(b, []):
                    tries[a].insert(ranks[k])
                    inside[a].append(k)
                tries.pop(b, None)
        member[x] = False
        own = root(i)
        tries[own].insert(x)
        inside[own].append(i)
        for e in prefix:
            index[e].add(own)
    return [root(i) for i in range(len(sets))]
