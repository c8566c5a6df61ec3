"""A trie of ordered sets for similarity joins inside one block of sets."""

from __future__ import annotations

import numpy as np


class _Node:
    __slots__ = ("ends", "high", "kids", "low", "seg")

    def __init__(self, seg, size):
        self.seg, self.kids, self.ends, self.low, self.high = seg, {}, [], size, size


class PrefixTree:
    """Sets of numbers, ascending in the global order, that share their common
    starts. ``percent``: Jaccard similarity from which two sets link."""

    def __init__(self, percent: int = 75):
        self.percent, self.root = percent, _Node(np.zeros(0, np.uint64), 0)

    def need(self, a: int, b: int) -> int:
        """Smallest overlap of linked sets of a and b elements."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def add(self, items: np.ndarray, name) -> None:
        node, at, size = self.root, 0, len(items)
        while at < size:
            kid = node.kids.get(items[at])
            if kid is None:
                kid = node.kids[items[at]] = _Node(items[at:], size)
                kid.ends.append(name)
                return
            seg, rest = kid.seg, items[at:]
            n = min(len(seg), len(rest))
            differ = np.flatnonzero(seg[:n] != rest[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(seg):  # the common start becomes a node of its own
                top = _Node(seg[:same], size)
                top.low, top.high = kid.low, kid.high
                kid.seg = seg[same:]
                top.kids[kid.seg[0]] = kid
                node.kids[items[at]] = kid = top
            kid.low, kid.high = min(kid.low, size), max(kid.high, size)
            node, at = kid, at + same
        node.ends.append(name)

    def links(self, items: np.ndarray, skip=lambda name: False):
        """Yields the names of stored sets that link with ``items``.

        A subtree is left as soon as the overlap so far and what remains on
        either side can't reach the least overlap any of its sets would need.
        """
        size = len(items)
        stack = [(kid, 0, 0) for kid in self.root.kids.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if 100 * node.high < self.percent * size or 100 * size < self.percent * node.low:
                continue
            if not node.kids and all(map(skip, node.ends)):
                continue
            # At best all that is left on the shorter side is common.
            seg = node.seg
            first = int(np.searchsorted(items, seg[0]))
            least = self.need(size, node.low)
            if overlap + min(size - first, node.high - depth) < least:
                continue
            at = np.searchsorted(items, seg)
            at[at == size] = size - 1
            overlap += int(np.count_nonzero(items[at] == seg))
            depth += len(seg)
            past = int(np.searchsorted(items, seg[-1], "right"))
            for name in node.ends:
                if 100 * overlap >= self.percent * (size + depth - overlap) and not skip(name):
                    yield name
            if overlap + min(size - past, node.high - depth) >= least:
                stack.extend((kid, overlap, depth) for kid in node.kids.values())


def spanning_links(names, sets, percent: int = 75):
    """Links that connect all sets of a block which chains of links connect, one
    for each set joined to a component: pairs inside a component are not made."""
    tree, top = PrefixTree(percent), {}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i in sorted(range(len(names)), key=lambda i: len(sets[i])):
        name = names[i]
        top[name] = name
        for other in tree.links(sets[i], lambda o: find(o) == find(name)):  # noqa: B023
            a, b = find(name), find(other)
            if a != b:
                top[a] = b
                yield name, other
        tree.add(sets[i], name)
