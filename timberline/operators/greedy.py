"""A greedy tree as a first incumbent: all nodes of a level are split at once, by a scan of all their thresholds."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.prep import cells
from timberline.operators.scan import Layout, anywhere, class_stats, halves
from timberline.operators.tree import Tree, rightmost


def cart(df: DataFrame, features: list[str], depth: int, min_share: float = 0.05, weight: str | None = None) -> Tree:
    """A tree of entropy splits with at least ``min_share`` of all rows in a leaf; a leaf above the last level falls to the right-most one.

    Thresholds are data values, all of them tried; of equal splits the one of the first feature and least threshold
    is taken. Leaves of one split that have one label become one. ``df``: features and ``y``, and a ``weight``.
    """
    rows = cells(df, features) if weight is None else df.select(*features, "y", F.col(weight).alias("n"))
    n, k = rows.agg(F.sum("n"), F.max("y")).first()
    split: dict[int, tuple[int, float]] = {}
    if not n:
        return Tree(depth)
    layout = Layout(*_args(rows, features, int(k)), int(n))
    nodes, sums = {1: anywhere(len(features))}, {}
    for _ in range(depth):
        if not nodes:
            break
        found = layout.facts(list(nodes.values()), "entropy", least=max(1, ceil(min_share * n)))
        below = {}
        for (t, box), fact in zip(nodes.items(), found, strict=True):
            sums[t] = fact.sums
            if fact.feature and np.count_nonzero(fact.sums) > 1:
                split[t] = (fact.feature, fact.threshold)
                below[2 * t], below[2 * t + 1] = halves(box, fact.feature, fact.threshold)
                sums[2 * t], sums[2 * t + 1] = fact.left, fact.sums - fact.left
        nodes = below
    label = {t: int(np.argmax(s)) + 1 for t, s in sums.items()}
    for t in sorted(split, reverse=True):
        if not {2 * t, 2 * t + 1} & split.keys() and label[2 * t] == label[2 * t + 1]:
            label[t] = label[2 * t]
            del split[t]
    ends = [t for t in label if t not in split and (t == 1 or t // 2 in split)]
    return Tree(depth, split, {rightmost(t, depth): label[t] for t in ends})


def _args(rows: DataFrame, features: list[str], k: int) -> tuple[DataFrame, list[str], list[str]]:
    found, names = class_stats(rows, k)
    return found, features, names
