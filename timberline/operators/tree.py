"""Trees of fixed depth: routing, scoring and editing.

Nodes are numbered as in a heap, the root 1, children ``2t`` and ``2t + 1``; with depth D the leaves are
``2**D .. 2**(D+1) - 1``. A row goes right at a split where its feature is not below the threshold, up to a
slack; a node without split sends all rows right.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLACK = 1e-12


@dataclass(frozen=True)
class Tree:
    """``split[t]`` is (feature from 1, threshold) of each branch node that splits, ``label[leaf]`` a class from 1."""

    depth: int
    split: dict[int, tuple[int, float]] = field(default_factory=dict)
    label: dict[int, int] = field(default_factory=dict)

    @property
    def branches(self) -> range:
        return range(1, 2**self.depth)

    @property
    def leaves(self) -> range:
        return range(2**self.depth, 2 ** (self.depth + 1))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(t, "branch", *(self.split.get(t) or (None, None)), t in self.split, None) for t in self.branches]
        rows += [(t, "leaf", None, None, None, self.label.get(t, 0)) for t in self.leaves]
        return spark.createDataFrame(rows, "t int, kind string, feature int, threshold double, has_split boolean, label int")


def ancestors(t: int) -> tuple[list[int], list[int]]:
    """Ancestors from the parent up at which the way to ``t`` turns left, and right."""
    left, right = [], []
    while t > 1:
        (right if t % 2 else left).append(t // 2)
        t //= 2
    return left, right


def subtree(t: int, depth: int) -> tuple[list[int], list[int]]:
    """Branch nodes and leaves from ``t`` down, the right-most leaf last."""
    if t >= 2**depth:
        return [], [t]
    found = [subtree(c, depth) for c in (2 * t, 2 * t + 1)]
    return [t, *found[0][0], *found[1][0]], [*found[0][1], *found[1][1]]


def rightmost(t: int, depth: int) -> int:
    return subtree(t, depth)[1][-1]


def same(a: Tree, b: Tree, tolerance: float = 1e-6) -> bool:
    """Equal features and labels, and thresholds that differ by the tolerance in sum at most."""
    if (a.depth, a.label, a.split.keys()) != (b.depth, b.label, b.split.keys()) or any(a.split[t][0] != b.split[t][0] for t in a.split):
        return False
    return sum(abs(a.split[t][1] - b.split[t][1]) for t in a.split) <= tolerance


def leaf(tree: Tree, features: list[str], t: int = 1) -> Column:
    """The leaf of a row: nested conditions on its features, one for each split."""
    if t in tree.leaves:
        return F.lit(t)
    if t not in tree.split:
        return leaf(tree, features, 2 * t + 1)
    f, threshold = tree.split[t]
    right = F.col(features[f - 1]) + F.lit(SLACK) >= F.lit(float(threshold))
    return F.when(right, leaf(tree, features, 2 * t + 1)).otherwise(leaf(tree, features, 2 * t))


def label_at(tree: Tree, at: Column) -> Column:
    """The label of a leaf, 0 where it has none."""
    out = F.lit(0)
    for t, k in tree.label.items():
        out = F.when(at == t, k).otherwise(out)
    return out


def predict(df: DataFrame, tree: Tree, features: list[str]) -> DataFrame:
    """``df`` with ``leaf`` and ``pred``."""
    return df.withColumn("leaf", leaf(tree, features)).withColumn("pred", label_at(tree, F.col("leaf")))


def score(df: DataFrame, trees: list[Tree], features: list[str], share: float, alpha: float, weight: Column | None = None) -> DataFrame:
    """``tree_id, errors, splits, cost, accuracy`` of every tree, in one pass over ``df``.

    ``cost = errors / share + alpha * splits``; rows in a leaf without label are errors. Each tree is one
    conditional sum, combined before the shuffle: no row is repeated for a tree.
    """
    n = F.lit(1) if weight is None else weight
    wrong = [F.coalesce(F.sum(F.when(label_at(t, leaf(t, features)) == F.col("y"), F.lit(0)).otherwise(n)), F.lit(0)).cast("long").alias(f"_{i}") for i, t in enumerate(trees)]
    sums = df.agg(F.sum(n).alias("_n"), *wrong)
    each = F.array(*[F.struct(F.lit(i).alias("tree_id"), F.col(f"_{i}").alias("errors"), F.lit(len(t.split)).alias("splits")) for i, t in enumerate(trees)])
    rows = sums.select("_n", F.explode(each).alias("r")).select("_n", "r.*")
    cost = F.round(F.col("errors") / F.lit(share) + F.lit(alpha) * F.col("splits"), 6)
    return rows.select("tree_id", "errors", "splits", cost.alias("cost"), F.round(1 - F.col("errors") / F.col("_n"), 6).alias("accuracy"))


def labels_on(tree: Tree, x: list[np.ndarray]) -> np.ndarray:
    """The label that a tree gives to each row of arrays of its features, 0 for none; a missing feature goes left."""
    at = np.ones(len(x[0]), int)
    for t in tree.branches:
        right = x[tree.split[t][0] - 1] + SLACK >= tree.split[t][1] if t in tree.split else True
        at = np.where(at == t, 2 * t + right, at)
    return np.array([tree.label.get(t, 0) for t in range(2 ** (tree.depth + 1))])[at]


def dominated(u: np.ndarray, v: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of ``a`` and ``b`` the weight of points with ``u < a`` and ``v < b``: ranks of ``u`` in order of ``v``,
    parted bit by bit (a wavelet matrix), so effort is that of sorting points and pairs, not of their product."""
    lines, order = np.sort(u), np.argsort(v, kind="stable")
    rank, weight = np.searchsorted(lines, u)[order], w[order]
    to = np.searchsorted(lines, a)
    low, high = np.zeros(len(a), int), np.searchsorted(v[order], b)
    out = np.zeros(len(a), weight.dtype)
    for bit in reversed(range(len(u).bit_length())):
        zero = rank >> bit & 1 == 0
        zeros, weights = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(np.where(zero, weight, 0))])
        one = to >> bit & 1 == 1
        out += np.where(one, weights[high] - weights[low], 0)
        low, high = [np.where(one, zeros[-1] + i - zeros[i], zeros[i]) for i in (low, high)]
        place = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, weight = rank[place], weight[place]
    return out


def as_arrays(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (from 0), thresholds and labels of trees of depth 2, a line a tree: 44 bytes, where a tree takes a thousand."""
    feature, below, label = np.zeros((len(trees), 3), np.int32), np.full((len(trees), 3), -np.inf), np.zeros((len(trees), 4), np.int32)
    for i, t in enumerate(trees):
        for s, (f, b) in t.split.items():
            feature[i, s - 1], below[i, s - 1] = f - 1, b
        for s, k in t.label.items():
            label[i, s - 4] = k
    return feature, below, label


def right_weights(trees: list[Tree] | tuple, x: list[np.ndarray], y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weight of the rows that each tree labels rightly, as by ``labels_on``, for trees of depth 2 (or their ``as_arrays``).

    A leaf's rows lie on one side of two thresholds, so they follow from what lies below one of them and below both.
    """
    x = [np.where(np.isnan(v), -np.inf, v + SLACK) for v in x]
    feature, below, label = trees if isinstance(trees, tuple) else as_arrays(trees)
    out = np.zeros(len(label), np.int64)
    for k in sorted(set(np.unique(label).tolist()) - {0}):
        here = y == k
        some, w = [v[here] for v in x], n[here].astype(np.int64)
        lines = [np.sort(v) for v in some]
        sums = [np.concatenate([[0], np.cumsum(w[np.argsort(v, kind="stable")])]) for v in some]

        def under(which: np.ndarray, s: int) -> np.ndarray:
            found = np.zeros(len(which), np.int64)
            for f in np.unique(feature[which, s]).tolist():
                mine = feature[which, s] == f
                found[mine] = sums[f][np.searchsorted(lines[f], below[which[mine], s])]
            return found

        def both(which: np.ndarray, s: int) -> np.ndarray:
            found = np.zeros(len(which), np.int64)
            pairs = feature[which, 0] * len(some) + feature[which, s]
            for f, g in [divmod(p, len(some)) for p in np.unique(pairs).tolist()]:
                mine = (feature[which, 0] == f) & (feature[which, s] == g)
                a, b = below[which[mine], 0], below[which[mine], s]
                found[mine] = sums[f][np.searchsorted(lines[f], np.minimum(a, b))] if f == g else dominated(some[f], some[g], w, a, b)
            return found

        for s, leaf in ((1, 0), (2, 2)):
            left, right = np.flatnonzero(label[:, leaf] == k), np.flatnonzero(label[:, leaf + 1] == k)
            each = np.union1d(left, right)
            found = both(each, s)
            pair = [found[np.searchsorted(each, which)] for which in (left, right)]
            if s == 1:
                out[left] += pair[0]
                out[right] += under(right, 0) - pair[1]
            else:
                out[left] += under(left, s) - pair[0]
                out[right] += w.sum() - under(right, 0) - under(right, s) + pair[1]
    return out


#: Rows that a task holds at once, and trees from which on they are scored by what lies below their thresholds.
HELD, MANY = 1 << 17, 64


def costs(df: DataFrame, trees: list[Tree], features: list[str], share: float, alpha: float, weight: str) -> list[float]:
    """Costs as in ``score``, for trees too many to be columns of a plan: tasks take them as data, and sum before the shuffle.

    Many trees of depth 2 are not tried on each row, but counted by ``right_weights``, which gives the same.
    """
    counted = len(trees) >= MANY and all(t.depth == 2 for t in trees)
    some, many = as_arrays(trees) if counted else trees, len(trees)  # what is sent to the tasks

    def work(batches):
        wrong = np.zeros(many, np.int64)

        def add(rows):
            x, y, n = [rows[f].to_numpy(float) for f in features], rows["y"].to_numpy(), rows[weight].to_numpy()
            if counted:
                np.add(wrong, n.sum() - right_weights(some, x, y, n), out=wrong)
                return
            for i, tree in enumerate(some):
                wrong[i] += n[labels_on(tree, x) != y].sum()

        held = []
        for rows in batches:
            held.append(rows)
            if sum(map(len, held)) >= (HELD if counted else 1):
                add(pd.concat(held))
                held = []
        if held:
            add(pd.concat(held))
        yield pd.DataFrame({"tree_id": np.arange(many), "errors": wrong})

    sums = df.select(*features, "y", weight).mapInPandas(work, "tree_id long, errors long").groupBy("tree_id").agg(F.sum("errors").alias("errors"))
    errors = {r.tree_id: r.errors for r in sums.collect()}
    return [round(errors.get(i, 0) / share + alpha * len(t.split), 6) for i, t in enumerate(trees)]


def best(scored: DataFrame) -> DataFrame:
    """The row of least cost, the first of equals."""
    return scored.agg(F.min(F.struct("cost", "tree_id", "errors", "splits")).alias("r")).select("r.*")


def leaf_counts(df: DataFrame, tree: Tree, features: list[str], weight: Column | None = None) -> DataFrame:
    """``leaf, y, n`` of the non-empty leaves."""
    return df.groupBy(leaf(tree, features).alias("leaf"), "y").agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))


def majority_labels(counts: DataFrame) -> DataFrame:
    """``leaf, label``: the most frequent class of each leaf, the smaller one of equals."""
    return counts.groupBy("leaf").agg(F.min(F.struct((-F.col("n")).alias("n"), "y"))["y"].alias("label"))


def relabelled(tree: Tree, counts: DataFrame) -> Tree:
    """``tree`` with majority labels; there are as many rows as leaves."""
    return replace(tree, label={r.leaf: r.label for r in majority_labels(counts).collect()})


def pruned(tree: Tree, shape: int) -> Tree:
    """``tree`` forced to the shape whose bits (the root's first) say which nodes split; 0 leaves it as it is.

    A subtree without split falls to its right-most leaf; a node that must split and does not gets feature 1 at
    0.5; leaves without label get class 1.
    """
    if not shape:
        return tree
    top = len(tree.branches)
    wanted = {t for t in tree.branches if shape >> (top - t) & 1}
    for t in tree.branches:
        if t not in wanted:
            wanted -= set(subtree(t, tree.depth)[0])
    split = {t: tree.split.get(t, (1, 0.5)) for t in sorted(wanted)}
    return replace(tree, split=split, label={t: tree.label.get(t, 1) for t in tree.leaves})


def merged(trees: list[Tree]) -> Tree:
    """The majority of an ensemble: a node splits if half of the trees do, on the feature most of them use (the first
    of equals), at the mean of the thresholds they use with it. Leaves are left without label."""
    depth, split = trees[0].depth, {}
    for t in trees[0].branches:
        there = [tree.split[t] for tree in trees if t in tree.split]
        if 2 * len(there) < len(trees) or any(p not in split for p in [t // 2] if p):
            continue
        votes = [f for f, _ in there]
        f = min(set(votes), key=lambda x: (-votes.count(x), x))
        used = [b for g, b in there if g == f]
        split[t] = (f, sum(used) / len(used))
    return Tree(depth, split)


def render(tree: Tree, features: list[str], t: int = 1, indent: int = 0) -> str:
    """The tree as text, one line a node; below a node without split only its right-most leaf."""
    pad = "  " * indent
    if t in tree.leaves:
        return f"{pad}[{t}] class {tree.label.get(t, 0)}\n"
    if t not in tree.split:
        return render(tree, features, rightmost(t, tree.depth), indent)
    f, b = tree.split[t]
    return f"{pad}[{t}] {features[f - 1]} >= {b:.4g}\n" + "".join(render(tree, features, c, indent + 1) for c in (2 * t, 2 * t + 1))


def dot(tree: Tree, features: list[str]) -> str:
    """The tree in the DOT language: ellipses for splits, boxes for leaves."""
    lines, todo = ["digraph tree {"], [1]
    while todo:
        t = todo.pop()
        if t in tree.leaves:
            lines.append(f'  n{t} [shape=box, label="class {tree.label.get(t, 0)}"];')
        elif t not in tree.split:
            end = rightmost(t, tree.depth)
            lines.append(f"  n{t} [shape=point]; n{t} -> n{end};")
            todo.append(end)
        else:
            f, b = tree.split[t]
            lines.append(f'  n{t} [shape=ellipse, label="{features[f - 1]}\\n{b:.4g}"]; n{t} -> n{2 * t}; n{t} -> n{2 * t + 1};')
            todo += [2 * t, 2 * t + 1]
    return "\n".join([*lines, "}"])


def shapes(depth: int) -> int:
    """How many sets of splits, each below its parent's, a tree of this depth can have."""
    return 1 if depth == 0 else 1 + prod([shapes(depth - 1)] * 2)
