"""Exact trees of a stated depth over a table of any size: a search over cuts whose steps are Spark jobs.

The least cost of a subtree never grows when rows are taken away. So between two cuts of a feature that have been
tried, no cut costs less than the left side of the lower one and the right side of the upper one together, and the
cuts between need not be tried where that is no less than the best cost known. Open intervals are halved in rounds; all
boxes that the trees of a round ask about, at all nodes of a level, are scanned in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from timberline.operators.scan import CRITERIA, Box, Facts, Layout, anywhere, halves
from timberline.operators.tree import Tree, rightmost

#: Cuts of a box and feature that the first round tries at most, and cuts of an open interval in a later one.
FIRST, LATER = 64, 7
EPS = 1e-9


@dataclass
class Found:
    """The best subtree of a box, with nodes numbered as below node 1: its cost, what no tree goes below, its splits, for
    each leaf the sums of its rows; and the least and greatest values of the box's rows."""

    cost: float
    bound: float
    split: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, np.ndarray] = field(default_factory=dict)
    low: tuple = ()
    high: tuple = ()


@dataclass
class Cut:
    """A cut that has been tried: bounds of its sides, and the values next to it."""

    at: float
    left: float
    right: float
    below: float
    above: float


class Optimal:
    """Least ``criterion / share + alpha * splits`` over all trees of a depth.

    ``least``: the weight that both sides of every split must have. ``shape`` (if not 0) fixes which nodes split by
    its bits, the root's first. Subproblems are known again by the tight box around their rows.
    """

    def __init__(self, layout: Layout, depth: int, share: float, alpha: float, criterion: str = "errors", least: float = 0.0, shape: int = 0) -> None:
        self.layout, self.depth, self.share, self.alpha, self.criterion, self.least, self.shape = layout, depth, share, alpha, criterion, least, shape
        self.known: dict[tuple, Found] = {}
        self.tight: dict[tuple, Found] = {}
        self.jobs = self.scanned = 0

    def _may(self, t: int) -> tuple[bool, bool]:
        """Whether node ``t`` may stop, and split."""
        if not self.shape:
            return True, True
        on = bool(self.shape >> (2**self.depth - 1 - t) & 1)
        return not on, on

    def _cost(self, sums: np.ndarray) -> float:
        return float(CRITERIA[self.criterion](sums)) / self.share

    def _facts(self, boxes: list[Box], split: bool, least: float) -> list[Facts]:
        self.jobs += 1
        self.scanned += len(boxes)
        return self.layout.facts(boxes, self.criterion, split, least)

    def fit(self) -> Found:
        return self.solve([(anywhere(len(self.layout.features)), 1)])[0]

    def solve(self, asked: list[tuple[Box, int]]) -> list[Found]:
        """The best subtree of each box at its node; all nodes are of one level."""
        if not asked:
            return []
        height = self.depth - asked[0][1].bit_length() + 1
        key = lambda b, t: (b, t if self.shape else height)
        new = list({key(b, t): (b, t) for b, t in asked if key(b, t) not in self.known}.values())
        if new:
            for (b, t), found in zip(new, self._solved(new, height), strict=True):
                self.known[key(b, t)] = found
        return [self.known[key(b, t)] for b, t in asked]

    def _stopped(self, fact: Facts, t: int, height: int) -> Found:
        cost = self._cost(fact.sums)
        may = self._may(t)[0]
        return Found(cost if may else np.inf, cost if may else cost + self.alpha, {}, {rightmost(1, height): fact.sums} if may else {}, tuple(fact.low), tuple(fact.high))

    def _solved(self, asked: list[tuple[Box, int]], height: int) -> list[Found]:
        facts = self._facts([b for b, _ in asked], height == 1, self.least)
        out = [self._stopped(f, t, height) for f, (_, t) in zip(facts, asked, strict=True)]
        if height == 0:
            return out
        if height == 1:
            # What no split goes below, also where too few rows lie on a side.
            free = self._facts([b for b, _ in asked], True, 0.0) if self.least else facts
            for i, (fact, open_, (_, t)) in enumerate(zip(facts, free, asked, strict=True)):
                if not self._may(t)[1]:
                    continue
                if fact.feature and (cost := fact.value / self.share + self.alpha) < out[i].cost - EPS:
                    out[i] = replace(out[i], cost=cost, split={1: (fact.feature, fact.threshold)}, leaves={2: fact.left, 3: fact.sums - fact.left})
                elif not np.isfinite(out[i].cost) and not self.least:  # a split that parts nothing
                    out[i] = replace(out[i], cost=self._cost(fact.sums) + self.alpha, split={1: (1, -1.0)}, leaves={3: fact.sums})
                out[i].bound = min(out[i].bound, open_.value / self.share + self.alpha)
            return out
        return self._searched(asked, height, facts, out)

    def _searched(self, asked: list[tuple[Box, int]], height: int, facts: list[Facts], out: list[Found]) -> list[Found]:
        """Rounds of cuts at the top of each subtree, until no interval between cuts can hold a better one."""
        same: dict[tuple, list[int]] = {}
        for i, (fact, (_, t)) in enumerate(zip(facts, asked, strict=True)):
            same.setdefault((tuple(fact.low), tuple(fact.high), height, t if self.shape else 0), []).append(i)
        lead = [each[0] for k, each in same.items() if k not in self.tight and self._may(asked[each[0]][1])[1]]
        lines = {(i, f): [Cut(-np.inf, 0.0, 0.0, -np.inf, facts[i].low[f - 1]), Cut(np.inf, 0.0, 0.0, facts[i].high[f - 1], np.inf)] for i in lead for f in range(1, len(self.layout.features) + 1)}
        most = FIRST
        while True:
            tried = []
            for (i, f), line in lines.items():
                for a, b in zip(line, line[1:], strict=False):
                    if a.above < b.below and a.left + b.right + self.alpha < out[i].cost - EPS:
                        tried += [(i, f, c) for c in self._points(f, a.above, b.below, most)]
            if not tried:
                break
            most = LATER
            found = iter(self.solve([(side, 2 * asked[i][1] + k) for i, f, c in tried for k, side in enumerate(halves(asked[i][0], f, c))]))
            for i, f, c in tried:
                left, right = next(found), next(found)
                cut = Cut(c, left.bound, right.bound, left.high[f - 1], right.low[f - 1])
                lines[i, f].append(cut)
                if (cost := left.cost + right.cost + self.alpha) < out[i].cost - EPS:
                    split, leaves = {1: (f, cut.above)}, {}
                    for child, sub in ((2, left), (3, right)):
                        split |= {_moved(s, child): v for s, v in sub.split.items()}
                        leaves |= {_moved(s, child): v for s, v in sub.leaves.items()}
                    out[i] = replace(out[i], cost=cost, split=split, leaves=leaves)
            for line in lines.values():
                line.sort(key=lambda c: c.at)
        for (i, _), line in lines.items():
            between = [a.left + b.right + self.alpha for a, b in zip(line, line[1:], strict=False) if a.above < b.below]
            out[i].bound = min([out[i].bound, *between, *[c.left + c.right + self.alpha for c in line[1:-1]]])
        for k, each in same.items():
            self.tight.setdefault(k, out[each[0]])
            for i in each:
                out[i] = self.tight[k]
        return out

    def _points(self, f: int, low: float, high: float, most: int) -> list[float]:
        """Cuts above ``low`` and up to ``high``, by quantiles in the first round and by value later; one at least."""
        grid = self.layout.grid[f - 1] if most == FIRST else np.linspace(low, high, most + 2)[1:-1]
        some = [float(c) for c in grid if low < c <= high]
        return some or [high if not low < (low + high) / 2 < high else (low + high) / 2]


def _moved(s: int, t: int) -> int:
    """Node ``s`` of a tree that is put at node ``t`` of another."""
    level = s.bit_length() - 1
    return (t << level) + s - (1 << level)


def classified(found: Found, depth: int) -> Tree:
    """The tree of a search by errors, its leaves labelled by their most frequent class, the first of equals."""
    return Tree(depth, dict(found.split), {t: int(np.argmax(v)) + 1 for t, v in found.leaves.items() if v.sum()})


def means(found: Found) -> dict[int, float]:
    """The mean target of each leaf of a search by squares."""
    return {t: float(v[1] / v[0]) for t, v in found.leaves.items() if v[0]}
