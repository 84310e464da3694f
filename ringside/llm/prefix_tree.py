"""A compressed prefix tree over ordered sets, and the overlap search in it."""

from __future__ import annotations

import numpy as np


class Node:
    """A run of tokens that all sets below share, and bounds over those sets."""

    __slots__ = ("below", "children", "first", "last", "least", "most", "run", "same", "sets")

    def __init__(self, run: np.ndarray) -> None:
        self.run = run
        self.children: list[Node] = []
        self.sets: list[int] = []  # sets that end here
        self.below = 0  # most tokens of a set after this run
        self.least = self.most = 0  # sizes (of whole sets) below
        self.first = self.last = 0  # places of sets below
        self.same = -2  # their label, -1 if there are several


class PrefixTree:
    """Sets are increasing arrays of local token numbers in the global order; sizes may count further tokens that no
    other set has."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], labels: list[int]) -> None:
        self.sizes, self.labels = sizes, labels
        self.width = 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.root = self._build(sets, order, 0)

    def _build(self, sets: list[np.ndarray], order: list[int], at: int) -> Node:
        """Iterative build: a stack of (node, sets in order, depth)."""
        root = Node(np.zeros(0, dtype=np.int64))
        stack, made = [(root, order, at)], [root]
        while stack:
            node, members, depth = stack.pop()
            groups: dict[int, list[int]] = {}
            for k in members:
                if len(sets[k]) == depth:
                    node.sets.append(k)
                else:
                    groups.setdefault(int(sets[k][depth]), []).append(k)
            for some in groups.values():
                a, b = sets[some[0]], sets[some[-1]]  # in order, so the two ends share least
                m = min(len(a), len(b))
                if len(some) == 1:
                    end = len(a)
                else:
                    differ = np.flatnonzero(a[depth:m] != b[depth:m])
                    end = depth + int(differ[0]) if len(differ) else m
                child = Node(a[depth:end])
                node.children.append(child)
                made.append(child)
                stack.append((child, some, end))
        for node in reversed(made):  # children were made after their parents
            kids = node.children
            node.below = max((len(c.run) + c.below for c in kids), default=0)
            own = [self.sizes[k] for k in node.sets]
            node.least = min(own + [c.least for c in kids], default=0)
            node.most = max(own + [c.most for c in kids], default=0)
            node.first = min(node.sets + [c.first for c in kids], default=0)
            node.last = max(node.sets + [c.last for c in kids], default=-1)
            marks = {self.labels[k] for k in node.sets} | {c.same for c in kids}
            node.same = marks.pop() if len(marks) == 1 else -1
        return root

    def linked(self, probe: np.ndarray, size: int, label: int, num: int, den: int, after: int = -1) -> list[int]:
        """Places of sets with den * overlap >= num * union, of another label than ``label`` (-1 and below: any) and
        a place greater than ``after``."""
        member = np.zeros(self.width + 1, dtype=np.int64)
        member[probe[probe <= self.width]] = 1
        upto = np.concatenate([[0], np.cumsum(member)])  # tokens of the probe before a number
        total = int(upto[-1])
        found, stack = [], [(c, 0) for c in self.root.children]
        both = num + den
        while stack:
            node, overlap = stack.pop()
            if node.last <= after or (label >= 0 and node.same == label) or den * node.most < num * size or num * node.least > den * size:
                continue
            overlap += int(member[node.run].sum())
            rest = min(total - int(upto[int(node.run[-1]) + 1]), node.below)
            if both * (overlap + rest) < num * (size + node.least):
                continue
            for k in node.sets:
                if k > after and (label < 0 or self.labels[k] != label) and both * overlap >= num * (size + self.sizes[k]):
                    found.append(k)
            stack += [(c, overlap) for c in node.children]
        return found


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int) -> None:
        self.up, self.parts = list(range(n)), n

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.parts -= 1
        return True
