"""Boxes: sets of trees given by the features, thresholds, splits and labels that each node may still have."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.tree import Tree, ancestors, subtree


@dataclass(frozen=True)
class Box:
    """For branch nodes: allowed features, threshold range, split range (0 or 1); for leaves: allowed labels.

    A leaf is fixed to a label where only one is left; a feature is fixed likewise. ``ok`` is false once some
    node has no choice left.
    """

    depth: int
    features: dict[int, frozenset[int]]
    threshold: dict[int, tuple[float, float]]
    splits: dict[int, tuple[int, int]]
    labels: dict[int, frozenset[int]]

    @property
    def ok(self) -> bool:
        return all(lo <= hi for lo, hi in (*self.splits.values(), *self.threshold.values())) and all(self.features[t] for t, (lo, _) in self.splits.items() if lo)

    @property
    def least_splits(self) -> int:
        return sum(lo for lo, _ in self.splits.values())

    def fixed(self, leaf: int) -> bool:
        return len(self.labels[leaf]) == 1

    def may_stop(self, t: int) -> bool:
        """Whether node ``t`` can be without split: nothing below must split, and no threshold is bound to be positive."""
        return all(self.splits[s][0] == 0 and self.threshold[s][0] <= 0 for s in subtree(t, self.depth)[0])

    def undetermined(self) -> dict[str, list]:
        """What is still open, in order of nodes."""
        return {
            "d": [t for t, (lo, hi) in self.splits.items() if lo != hi],
            "a": [(j, t) for t, f in self.features.items() if len(f) > 1 and self.splits[t][1] for j in sorted(f)],
            "c": [(k, t) for t, lab in self.labels.items() if len(lab) > 1 for k in sorted(lab)],
            "b": [t for t, (lo, hi) in self.threshold.items() if lo < hi and self.splits[t][1]],
        }

    def holds(self, tree: Tree, tolerance: float = 1e-9) -> bool:
        """Whether the tree lies in the box; leaves without label do in any."""
        for t, (lo, hi) in self.splits.items():
            if not lo <= (t in tree.split) <= hi:
                return False
            if t in tree.split:
                f, b = tree.split[t]
                if f not in self.features[t] or not self.threshold[t][0] - tolerance <= b <= self.threshold[t][1] + tolerance:
                    return False
        return all(k in self.labels[t] for t, k in tree.label.items() if k)


def free(depth: int, n_features: int, n_classes: int, shape: int = 0) -> Box:
    """All trees of a depth; ``shape`` (if not 0) fixes which nodes split by its bits, the root's first."""
    branches, leaves = range(1, 2**depth), range(2**depth, 2 ** (depth + 1))
    splits = {t: ((b := shape >> (len(branches) - t) & 1), b) if shape else (0, 1) for t in branches}
    box = Box(depth, {t: frozenset(range(1, n_features + 1)) for t in branches}, {t: (0.0, 1.0) for t in branches}, splits, {t: frozenset(range(1, n_classes + 1)) for t in leaves})
    return propagated(box)


def propagated(box: Box) -> Box:
    """No split below a node without one, and a split above every node with one."""
    for t, (lo, hi) in sorted(box.splits.items()):
        if hi == 0:
            box = _without(box, t)
        elif lo == 1:
            box = _with(box, t)
    return box


def _without(box: Box, t: int) -> Box:
    nodes, leaves = subtree(t, box.depth)
    splits = box.splits | {s: (box.splits[s][0], 0) for s in nodes}
    return Box(box.depth, box.features | {s: frozenset() for s in nodes}, box.threshold | {s: (max(0.0, box.threshold[s][0]), 0.0) for s in nodes}, splits, box.labels | {s: frozenset() for s in leaves[:-1]})


def _with(box: Box, t: int) -> Box:
    above = {t, *ancestors(t)[0], *ancestors(t)[1]}
    return Box(box.depth, box.features, box.threshold, box.splits | {s: (1, box.splits[s][1]) for s in above}, box.labels)


def branch(box: Box, kind: str, at) -> tuple[Box, Box]:
    """The two halves of a box by one variable: a split d[t], a feature a[j, t], a label c[k, t] or a threshold b[t]."""
    if kind == "d":
        return _without(box, at), _with(box, at)
    if kind == "b":
        lo, hi = box.threshold[at]
        middle = (lo + hi) / 2
        return tuple(Box(box.depth, box.features, box.threshold | {at: part}, box.splits, box.labels) for part in ((lo, middle), (middle, hi)))
    which, t = at
    if kind == "a":
        return tuple(Box(box.depth, box.features | {t: part}, box.threshold, box.splits, box.labels) for part in (box.features[t] - {which}, frozenset({which})))
    return tuple(Box(box.depth, box.features, box.threshold, box.splits, box.labels | {t: part}) for part in (box.labels[t] - {which}, frozenset({which})))


def widest_threshold(box: Box) -> int | None:
    """The open threshold that is widest, weighted by how near to the root it is; the first of equals."""
    open_ = box.undetermined()["b"]
    weight = lambda t: (box.threshold[t][1] - box.threshold[t][0]) * (box.depth - t.bit_length() + 2)
    return max(open_, key=lambda t: (weight(t), -t)) if open_ else None


def feasible(box: Box, values: dict[int, list[float]]) -> bool:
    """Whether each node that must split has an allowed feature with a data value in its threshold range."""
    if not box.ok:
        return False

    def some(f: int, lo: float, hi: float) -> bool:
        at = bisect_left(values[f], lo)
        return at < len(values[f]) and values[f][at] <= hi

    return all(any(some(f, *box.threshold[t]) for f in box.features[t]) for t, (lo, _) in box.splits.items() if lo)


def feasible_in(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same test in the cluster, for feature values too many for the driver.

    ``points``: ``f, v``; ``ranges``: ``box_id, t, f, lo, hi`` for each allowed feature of a node that must split.
    Returns ``box_id, feasible``. Only each feature's values inside its ranges count, and are combined at once.
    """
    hit = points.join(ranges, (points["f"] == ranges["f"]) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("box_id", "t").agg(F.count(F.lit(1)).alias("n"))
    nodes = ranges.select("box_id", "t").distinct().join(hit, ["box_id", "t"], "left")
    return nodes.groupBy("box_id").agg(F.min(F.coalesce("n", F.lit(0)) > 0).alias("feasible"))
