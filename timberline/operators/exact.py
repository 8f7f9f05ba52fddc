"""Exact trees by dynamic programming over nodes and sets of rows, inside a box.

Once the rows of a node are fixed its two subtrees do not depend on each other, so the least cost is a recursion
over (node, rows). Rows are distinct cells with a weight; the number of cells, not of rows, sets the effort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np

from timberline.operators.box import Box, free
from timberline.operators.tree import Tree, rightmost

#: Numbers that one batch of cuts may take at once, and a batch of small groups, which fits into a processor's cache.
BATCH, SMALL = 4_000_000, 250_000
#: Equal pieces of [0, 1] that multipliers tell thresholds apart by: a power of two, so that their borders are exact.
PIECES = 8


def piece(b: np.ndarray) -> np.ndarray:
    """The piece of each threshold."""
    return np.minimum((np.clip(b, 0.0, 1.0) * PIECES).astype(int), PIECES - 1)


@dataclass(frozen=True)
class Pull:
    """What each group pays (or gains, below 0) for choices of its tree, in costs: ``split`` by group, node, feature
    and piece of the threshold, ``label`` by group, leaf and class; all numbered from 0."""

    split: np.ndarray
    label: np.ndarray

    @staticmethod
    def size(depth: int, n_features: int, n_classes: int) -> int:
        return (2**depth - 1) * n_features * PIECES + 2**depth * n_classes

    @staticmethod
    def of(flat: np.ndarray, depth: int, n_features: int, n_classes: int) -> Pull:
        """From one line of numbers for each group: splits, then labels."""
        at = (2**depth - 1) * n_features * PIECES
        return Pull(flat[:, :at].reshape(-1, 2**depth - 1, n_features, PIECES), flat[:, at:].reshape(-1, 2**depth, n_classes))

    @staticmethod
    def chosen(tree: Tree, n_features: int, n_classes: int) -> list[int]:
        """Places in such a line of what a tree chooses."""
        at = (2**tree.depth - 1) * n_features * PIECES
        splits = [((t - 1) * n_features + f - 1) * PIECES + int(piece(b)) for t, (f, b) in tree.split.items()]
        return splits + [at + (leaf - 2**tree.depth) * n_classes + k - 1 for leaf, k in tree.label.items() if k]

    def __getitem__(self, groups: np.ndarray) -> Pull:
        return Pull(self.split[groups], self.label[groups])


class Solver:
    """``x`` (cells by features, within [0, 1]), labels ``y`` from 1, weights ``w``.

    Cost is ``errors / share + alpha * splits``. A split sends rows below the threshold left, at least ``eps`` of
    the feature below it; ``least`` is the weight that both sides of a split must have.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, box: Box, share: float, alpha: float, eps: np.ndarray, least: float = 0) -> None:
        self.x, self.w, self.box, self.share, self.alpha, self.eps, self.least = x, w, box, share, alpha, eps, least
        self.k = max([1, *y.tolist(), *[k for lab in box.labels.values() for k in lab]])
        self.hot = np.zeros((len(y), self.k))
        self.hot[np.arange(len(y)), y - 1] = w
        self.known: dict[tuple[int, bytes], tuple[float, Tree]] = {}

    def _leaf(self, t: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Errors and label of leaf ``t`` for rows of class counts (any number of them at once); 0 is no label."""
        allowed = sorted(self.box.labels[t])
        total = counts.sum(-1)
        if not allowed:
            return total, np.zeros(total.shape, int)
        some = counts[..., [k - 1 for k in allowed]]
        at = some.argmax(-1)
        errors = total - np.take_along_axis(some, at[..., None], -1)[..., 0]
        return errors, np.array(allowed)[at]

    def _cuts(self, t: int, f: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in order of the feature, and feasible cuts: how many rows go left, and the threshold."""
        order = rows[np.argsort(self.x[rows, f - 1], kind="stable")]
        v = self.x[order, f - 1]
        n = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]])) if len(v) else np.array([0])
        below = np.where(n > 0, v[np.maximum(n - 1, 0)] if len(v) else 0.0, -np.inf)
        above = np.where(n < len(v), v[np.minimum(n, len(v) - 1)] if len(v) else 0.0, np.inf)
        lo, hi = self.box.threshold[t]
        lowest, highest = np.maximum(max(lo, 0.0), below + self.eps[f - 1]), np.minimum(min(hi, 1.0), above)
        fits = lowest <= highest
        if self.least:
            left = np.concatenate([[0.0], np.cumsum(self.w[order])])[n]
            fits &= (left >= self.least) & (left[-1] - left >= self.least)
        middle = (np.maximum(below, 0.0) + np.minimum(above, 1.0)) / 2
        return order, n[fits], np.clip(middle, lowest, highest)[fits]

    def _last(self, t: int, rows: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Least costs at ``t``, whose children are leaves, for many subsets of ``rows`` at once: one line of ``inside`` each."""
        at, place = np.nonzero(inside)
        return Groups(self.x[rows[place]], self.hot[rows[place]].argmax(1) + 1, self.w[rows[place]], at, len(inside), self.box, self.share, np.full(len(inside), self.alpha), self.eps, self.k, self.least).solve(t)[0]

    def _below(self, t: int, f: int, rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Costs of the cuts at ``t`` whose children are the last to split; ``cuts``: how many of ``rows`` go left."""
        some = Groups(self.x[rows], self.hot[rows].argmax(1) + 1, self.w[rows], np.zeros(len(rows), int), 1, self.box, self.share, np.array([self.alpha]), self.eps, self.k, self.least)
        ends = np.cumsum(np.bincount(some.rank[f], minlength=some.values[f].shape[1]))
        return some.below(t, f)[0][np.searchsorted(np.concatenate([[0], ends]), cuts)]

    def solve(self, t: int = 1, rows: np.ndarray | None = None, bound: float = np.inf) -> tuple[float, Tree]:
        """Least cost of the subtree at ``t`` over ``rows``; infinite if the box has none. ``bound``: only less is of use."""
        rows = np.arange(len(self.x)) if rows is None else rows
        depth = self.box.depth
        if t >= 2**depth:
            errors, label = self._leaf(t, self.hot[rows].sum(0))
            return float(errors) / self.share, Tree(depth, {}, {t: int(label)} if label else {})
        key = (t, np.packbits(np.bincount(rows, minlength=len(self.x)).astype(bool)).tobytes())
        if key in self.known:
            return self.known[key]
        best, tree = np.inf, Tree(depth)
        if self.box.may_stop(t):
            end = rightmost(t, depth)
            errors, label = self._leaf(end, self.hot[rows].sum(0))
            best, tree = float(errors) / self.share, Tree(depth, {}, {end: int(label)} if label else {})
        if self.box.splits[t][1] and min(best, bound) > self.alpha:
            for f in sorted(self.box.features[t]):
                order, cuts, thresholds = self._cuts(t, f, rows)
                if not len(cuts):
                    continue
                if 2 * t >= 2**depth:
                    left = np.concatenate([np.zeros((1, self.k)), np.cumsum(self.hot[order], 0)])
                    (a, ka), (b, kb) = self._leaf(2 * t, left[cuts]), self._leaf(2 * t + 1, left[-1] - left[cuts])
                    cost = (a + b) / self.share + self.alpha
                    i = int(cost.argmin())
                    if cost[i] < best - 1e-12:
                        best = float(cost[i])
                        tree = Tree(depth, {t: (f, float(thresholds[i]))}, {leaf: int(k) for leaf, k in ((2 * t, ka[i]), (2 * t + 1, kb[i])) if k})
                    continue
                if 4 * t >= 2**depth and len(order):
                    cost = self._below(t, f, order, cuts)
                    i = int((cost <= cost.min() + 1e-12).argmax())
                    if cost[i] >= best - 1e-12:
                        continue
                    cuts, thresholds = cuts[i : i + 1], thresholds[i : i + 1]
                for n, b in zip(cuts.tolist(), thresholds.tolist(), strict=True):
                    some = self.alpha
                    parts = []
                    for child, part in ((2 * t, order[:n]), (2 * t + 1, order[n:])):
                        value, found = self.solve(child, np.sort(part))
                        some += value
                        parts.append(found)
                        if some >= best - 1e-12:
                            break
                    else:
                        best = some
                        tree = Tree(depth, {t: (f, b)} | parts[0].split | parts[1].split, parts[0].label | parts[1].label)
        if bound == np.inf:
            self.known[key] = best, tree
        return best, tree


class Groups:
    """Many groups of rows at once, each for itself: its best tree whose splits are at a node and its children at most.

    ``x`` (rows by features), ``y`` from 1, ``w``; ``at``: the group of a row, from 0; ``alpha``: of each group. Cuts
    lie before, between and after the distinct values of a group, numbered from 0; shorter groups are filled up by
    values that no cut fits. Class counts have the class in front.

    Right rows are additive, and a leaf takes the class with most of them. So where a node and its child split on one
    feature, the child's best cut for all cuts of the node is a running maximum; where they split on two, counts for
    all pairs of cuts are summed up, in parts of ``BATCH`` numbers. With ``pull`` a tree also pays for what it chooses;
    a cut pays for the cheapest piece that its thresholds reach.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, n: int, box: Box, share: float, alpha: np.ndarray, eps: np.ndarray, k: int, least: float = 0, pull: Pull | None = None) -> None:
        self.x, self.y, self.w, self.at, self.n, self.box, self.share, self.alpha, self.eps, self.k, self.least = x, y, w, at, n, box, share, alpha, eps, k, least
        self.pull, self.cheapest = pull, {}
        self.rank, self.values, self.counts = {}, {}, {}
        for f in range(1, x.shape[1] + 1):
            order = np.lexsort((x[:, f - 1], at))
            v, g = x[order, f - 1], at[order]
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (g[1:] != g[:-1])])[: len(v)]
            place = np.cumsum(new) - 1
            first = np.concatenate([[0], np.cumsum(np.bincount(g[new], minlength=n))])[g]
            self.rank[f] = np.empty(len(v), int)
            self.rank[f][order] = place - first
            self.values[f] = np.full((n, int((place - first).max(initial=-1)) + 1), np.inf)
            self.values[f][g[new], (place - first)[new]] = v[new]
            size = self.values[f].shape[1] + 1
            found = np.bincount(((y - 1) * n + at) * size + self.rank[f] + 1, w, k * n * size).reshape(k, n, size)
            self.counts[f] = np.cumsum(found, 2)

    def _charge(self, leaf: int, k: int, axes: int, who: np.ndarray | None = None) -> np.ndarray | float:
        """What groups (``who``, or all) pay for a leaf's label, in rows, with so many axes."""
        if self.pull is None:
            return 0.0
        paid = self.pull.label[:, leaf - 2**self.box.depth, k - 1] * self.share
        return (paid if who is None else paid[who]).reshape(-1, *[1] * (axes - 1))

    def _fee(self, t: int, f: int, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray | float:
        """What groups (the first axis) pay at least for a split with a threshold in this range, in costs."""
        if self.pull is None:
            return 0.0
        if (t, f) not in self.cheapest:
            paid = self.pull.split[:, t - 1, f - 1]
            table = np.empty((self.n, PIECES, PIECES))
            for i in range(PIECES):
                table[:, i, i:] = np.minimum.accumulate(paid[:, i:], 1)
            self.cheapest[t, f] = table
        low = piece(lowest)
        group = np.arange(self.n).reshape(-1, *[1] * (low.ndim - 1))
        return self.cheapest[t, f][group, low, np.maximum(low, piece(highest))]

    def _right(self, leaf: int, counts: np.ndarray) -> np.ndarray:
        """Right rows of a leaf that takes the best of its labels, less what it pays for the label."""
        allowed = sorted(self.box.labels[leaf])
        if not allowed:
            return np.zeros(counts.shape[1:])
        return reduce(np.maximum, [counts[k - 1] - self._charge(leaf, k, counts.ndim - 1) for k in allowed])

    def _label(self, leaf: int, counts: np.ndarray, who: np.ndarray | None = None) -> np.ndarray:
        """The smallest of the best labels, 0 where the leaf has none."""
        allowed = sorted(self.box.labels[leaf])
        worth = [counts[k - 1] - self._charge(leaf, k, counts.ndim - 1, who) for k in allowed]
        return np.array(allowed)[np.argmax(worth, 0)] if allowed else np.zeros(counts.shape[1:], int)

    def _fits(self, t: int, f: int, below: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest threshold of cuts with these values next to them; a cut fits if they are in order."""
        lo, hi = self.box.threshold[t]
        return np.maximum(max(lo, 0.0), below + self.eps[f - 1]), np.minimum(min(hi, 1.0), above)

    def _around(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The values below and above each cut."""
        v, ends = self.values[f], np.full((self.n, 1), np.inf)
        return np.hstack([-ends, v]), np.hstack([v, ends])

    def _cuts(self, t: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Which cuts fit, and their thresholds."""
        below, above = self._around(f)
        lowest, highest = self._fits(t, f, below, above)
        fits, left = lowest <= highest, self.counts[f].sum(0)
        if self.least:
            fits &= (left >= self.least) & (left[:, -1:] - left >= self.least)
        middle = (np.maximum(below, 0.0) + np.minimum(above, 1.0)) / 2
        middle = np.clip(middle, lowest, np.maximum(lowest, highest))
        if self.pull is None:
            return fits, middle
        # A threshold in the piece that the cut pays for: the middle one if it is as cheap as any, else the first that is.
        paid, least = self.pull.split[:, t - 1, f - 1], self._fee(t, f, lowest, highest)
        some = np.arange(PIECES)
        reached = (some >= piece(lowest)[..., None]) & (some <= piece(highest)[..., None])
        cheap = (reached & (paid[:, None, :] <= least[..., None])).argmax(-1)
        other = (np.maximum(lowest, cheap / PIECES) + np.minimum(highest, (cheap + 1) / PIECES)) / 2
        return fits, np.where(fits & (np.take_along_axis(paid, piece(middle), 1) > least), other, middle)

    def _stop(self, t: int, counts: np.ndarray) -> np.ndarray:
        """Costs without a split at ``t``, infinite where the box wants one."""
        if not self.box.may_stop(t):
            return np.full(counts.shape[1:], np.inf)
        return (counts.sum(0) - self._right(rightmost(t, self.box.depth), counts)) / self.share

    def _alike(self, s: int, f: int, left: bool) -> np.ndarray:
        """Costs of the best split at ``s`` on ``f``, for the rows to the left or right of each cut of ``f``."""
        c, total = self.counts[f], self.counts[f][:, :, -1:]
        below, above = self._around(f)
        lowest, highest = self._fits(s, f, below, above)
        weight, none = c.sum(0), np.full(c.shape[1:], -np.inf)
        some, whole = (c, self._right(2 * s, c)) if left else (total - c, self._right(2 * s + 1, total - c))
        other = 2 * s + 1 if left else 2 * s
        # With all rows of the part on one side; the other side of the cut is open then.
        alone = lowest <= min(self.box.threshold[s][1], 1.0) if left else max(self.box.threshold[s][0], 0.0) <= highest
        ends = (lowest, np.full_like(highest, min(self.box.threshold[s][1], 1.0))) if left else (np.full_like(lowest, max(self.box.threshold[s][0], 0.0)), highest)
        empty = self._right(other, np.zeros((self.k, self.n, 1)))
        best = np.where(alone, whole + empty - self._fee(s, f, *ends) * self.share, -np.inf) if not self.least else none
        gain = np.where(lowest <= highest, whole - self._fee(s, f, lowest, highest) * self.share, -np.inf)
        size = weight if left else weight[:, -1:] - weight
        if self.least:
            gain = np.where(size >= self.least, gain, -np.inf)
        if not left:
            gain, some, size = gain[:, ::-1], some[:, :, ::-1], size[:, ::-1]
        last = np.broadcast_to(np.arange(size.shape[1]) - 1, size.shape)
        if self.least:
            last = np.minimum(last, np.stack([np.searchsorted(z, z - self.least, "right") - 1 for z in size]))
        found = none
        for k in sorted(self.box.labels[other]) or [0]:
            mine = some[k - 1] if k else 0.0
            most = np.maximum.accumulate(gain - mine, 1)
            found = np.maximum(found, mine + np.where(last >= 0, np.take_along_axis(most, np.maximum(last, 0), 1), -np.inf) - (self._charge(other, k, 2) if k else 0.0))
        found = found if left else found[:, ::-1]
        total = weight if left else weight[:, -1:] - weight
        return (total - np.maximum(best, found)) / self.share + self.alpha[:, None]

    def _across(self, s: int, g: int, counts: np.ndarray) -> np.ndarray:
        """Costs of the best split at ``s`` on ``g``, for class counts of the values of ``g``: class, group, part, value."""
        there, v = counts.sum(0) > 0, self.values[g][:, None, :]
        ends = np.full((*there.shape[:2], 1), np.inf)
        below = np.concatenate([-ends, np.maximum.accumulate(np.where(there, v, -np.inf), 2)], 2)
        above = np.concatenate([np.minimum.accumulate(np.where(there, v, np.inf)[:, :, ::-1], 2)[:, :, ::-1], ends], 2)
        lowest, highest = self._fits(s, g, below, above)
        left = np.concatenate([np.zeros((*counts.shape[:3], 1)), np.cumsum(counts, 3)], 3)
        right, fits = left[..., -1:] - left, lowest <= highest
        if self.least:
            fits &= (left.sum(0) >= self.least) & (right.sum(0) >= self.least)
        most = np.where(fits, self._right(2 * s, left) + self._right(2 * s + 1, right) - self._fee(s, g, lowest, highest) * self.share, -np.inf).max(2)
        return (left[..., -1].sum(0) - most) / self.share + self.alpha[:, None]

    def below(self, t: int, f: int) -> np.ndarray:
        """Costs of all cuts of ``f`` at ``t`` whose children are the last to split, whether the cuts fit or not."""
        c = self.counts[f]
        costs = []
        for s, left in ((2 * t, True), (2 * t + 1, False)):
            best = self._stop(s, c if left else c[:, :, -1:] - c)
            if self.box.splits[s][1] and f in self.box.features[s]:
                best = np.minimum(best, self._alike(s, f, left))
            costs.append(best)
        others = {g: [(i, s) for i, s in enumerate((2 * t, 2 * t + 1)) if self.box.splits[s][1] and g in self.box.features[s]] for g in self.values if g != f}
        for g, nodes in others.items():
            if not nodes or not len(self.y):
                for i, s in nodes:
                    costs[i] = np.minimum(costs[i], self._across(s, g, np.zeros((self.k, self.n, c.shape[2], self.values[g].shape[1]))))
                continue
            width, size = self.values[g].shape[1], c.shape[2]
            whole = np.bincount(((self.y - 1) * self.n + self.at) * width + self.rank[g], self.w, self.k * self.n * width).reshape(self.k, self.n, 1, width)
            step, carry = max(1, BATCH // (self.k * self.n * width)), 0.0
            order = np.argsort(self.rank[f], kind="stable")
            starts = np.searchsorted(self.rank[f][order], np.arange(-1, size + step))  # rows of the value before a cut
            for low in range(0, size, step):
                high = min(size, low + step)
                r = order[starts[low] : starts[high]]
                index = (((self.y[r] - 1) * self.n + self.at[r]) * (high - low) + self.rank[f][r] + 1 - low) * width + self.rank[g][r]
                some = np.bincount(index, self.w[r], self.k * self.n * (high - low) * width).reshape(self.k, self.n, high - low, width)
                some = np.cumsum(some, 2) + carry
                carry = some[:, :, -1:]
                for i, s in nodes:
                    costs[i][:, low:high] = np.minimum(costs[i][:, low:high], self._across(s, g, some if i == 0 else whole - some))
        return costs[0] + costs[1] + self.alpha[:, None]

    def solve(self, t: int = 1) -> tuple[np.ndarray, list[Tree]]:
        """Cost and best tree of each group at ``t``, whose children or grandchildren are leaves; infinite if the box has none."""
        depth = self.box.depth
        total = self.counts[1][:, :, -1]
        best, end = self._stop(t, total), rightmost(t, depth)
        trees = [Tree(depth, {}, {end: k} if k else {}) if cost < np.inf else Tree(depth) for k, cost in zip(self._label(end, total).tolist(), best, strict=True)]
        if not self.box.splits[t][1]:
            return best, trees
        group, last = np.arange(self.n), 2 * t >= 2**depth
        chosen, at, threshold = np.zeros(self.n, int), np.zeros(self.n, int), np.zeros(self.n)
        for f in sorted(self.box.features[t]):
            fits, thresholds = self._cuts(t, f)
            fee = self._fee(t, f, *self._fits(t, f, *self._around(f)))
            if last:
                c = self.counts[f]
                errors = c[:, :, -1:].sum(0) - self._right(2 * t, c) - self._right(2 * t + 1, c[:, :, -1:] - c)
                cost = np.where(fits, errors / self.share + self.alpha[:, None] + fee, np.inf)
                i = cost.argmin(1)
            else:
                cost = np.where(fits, self.below(t, f) + fee, np.inf)
                i = (cost <= cost.min(1, keepdims=True) + 1e-12).argmax(1)
            less = cost[group, i] < best - 1e-12
            best = np.where(less, cost[group, i], best)
            chosen, at, threshold = np.where(less, f, chosen), np.where(less, i, at), np.where(less, thresholds[group, i], threshold)
        ways = np.flatnonzero(chosen)
        if last:
            for f in set(chosen[ways].tolist()):
                some = ways[chosen[ways] == f]
                left = self.counts[f][:, some, at[some]]
                for g, b, ka, kb in zip(some.tolist(), threshold[some].tolist(), self._label(2 * t, left, some).tolist(), self._label(2 * t + 1, total[:, some] - left, some).tolist(), strict=True):
                    trees[g] = Tree(depth, {t: (f, b)}, {leaf: k for leaf, k in ((2 * t, ka), (2 * t + 1, kb)) if k})
            return best, trees
        if not len(ways):
            return best, trees
        place = np.full(self.n, -1)
        place[ways] = np.arange(len(ways))
        ranks = np.stack([self.rank[f] for f in self.rank], 1)
        own = place[self.at] >= 0
        left = own & (ranks[np.arange(len(self.at)), np.maximum(chosen[self.at], 1) - 1] < at[self.at])
        parts = [Groups(self.x[r], self.y[r], self.w[r], place[self.at[r]], len(ways), self.box, self.share, self.alpha[ways], self.eps, self.k, self.least, self.pull and self.pull[ways]).solve(s) for s, r in ((2 * t, left), (2 * t + 1, own & ~left))]
        for i, g in enumerate(ways.tolist()):
            a, b = parts[0][1][i], parts[1][1][i]
            trees[g] = Tree(depth, {t: (int(chosen[g]), float(threshold[g]))} | a.split | b.split, a.label | b.label)
        return best, trees


def solve_groups(x: np.ndarray, y: np.ndarray, at: np.ndarray, box: Box, share: float, alpha: float, eps: np.ndarray, pull: Pull | None = None) -> tuple[np.ndarray, list[Tree]]:
    """Least cost and best tree of each group ``at`` (from 0, none empty); ``alpha`` is a split's penalty for one row.

    ``pull``: what each group pays for choices, for depths 1 and 2.

    Groups of like size are solved at once, as many as their pairs of cuts are ``BATCH`` numbers.
    """
    if pull is not None and not 1 <= box.depth <= 2:
        raise ValueError("multipliers are for trees of depth 1 or 2")
    sizes = np.bincount(at)
    k = max([1, int(y.max(initial=1)), *[k for lab in box.labels.values() for k in lab]])
    order = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    by_size = np.argsort(-sizes, kind="stable")
    values, trees, low = np.empty(len(sizes)), [None] * len(sizes), 0
    while low < len(sizes):
        some = by_size[low : low + max(1, SMALL // (int(sizes[by_size[low]]) ** 2 * k))]
        low += len(some)
        rows = np.concatenate([order[starts[g] : starts[g + 1]] for g in some])
        if 1 <= box.depth <= 2:
            found = Groups(x[rows], y[rows], np.ones(len(rows)), np.repeat(np.arange(len(some)), sizes[some]), len(some), box, share, alpha * sizes[some], eps, k, pull=pull and pull[some]).solve()
        else:
            ends = np.concatenate([[0], np.cumsum(sizes[some])])
            each = [_solved(x[r], y[r], box, share, alpha * len(r), eps) for r in (rows[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
            found = [v for v, _ in each], [t for _, t in each]
        values[some] = found[0]
        for g, tree in zip(some.tolist(), found[1], strict=True):
            trees[g] = tree
    return values, trees


def _solved(x: np.ndarray, y: np.ndarray, box: Box, share: float, alpha: float, eps: np.ndarray) -> tuple[float, Tree]:
    """One group by its distinct rows."""
    cells, n = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    return Solver(cells[:, :-1], cells[:, -1].astype(int), n.astype(float), box, share, alpha, eps).solve()


def gaps(x: np.ndarray) -> np.ndarray:
    """The smallest gap between distinct values of each feature."""
    out = []
    for column in x.T:
        step = np.diff(np.unique(column))
        out.append(step.min() if len(step) else 1e-10)
    return np.array(out)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, depth: int = 2, share: float | None = None, alpha: float = 0.05, least: float = 0, shape: int = 0) -> tuple[float, Tree]:
    """The best tree of a depth over all rows. ``share``: the majority class's part of the rows, unless given."""
    w = np.ones(len(y)) if w is None else w
    share = share or np.bincount(y, w).max() / w.sum()
    box = free(depth, x.shape[1], int(y.max()), shape)
    return Solver(x, y, w, box, share, alpha, gaps(x), least).solve()
