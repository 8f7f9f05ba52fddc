"""Lower bounds of all trees in a box: by reachable leaves, by labels of leaves, and by groups of rows."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.box import Box
from timberline.operators.exact import Pull, solve_groups
from timberline.operators.tree import Tree, rightmost


def _every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def reach(box: Box, features: list[str]) -> Column:
    """The leaves that some tree in the box sends a row to, as a sorted array: one condition on the row for each node."""
    ways: dict[int, Column] = {}

    def walk(t: int, come: Column) -> None:
        if t >= 2**box.depth:
            ways[t] = ways[t] | come if t in ways else come
            return
        if box.splits[t][1] == 0:
            walk(rightmost(t, box.depth), come)
            return
        lo, hi = box.threshold[t]
        x = [F.col(features[f - 1]) for f in sorted(box.features[t])]
        walk(2 * t, come & ~_every([c >= F.lit(hi) for c in x]))
        walk(2 * t + 1, come & ~_every([c < F.lit(lo) for c in x]))

    walk(1, F.lit(True))
    return F.array_compact(F.array(*[F.when(ways[t], F.lit(t)) for t in sorted(ways)]))


def unreachable(leaves: Column, depth: int) -> Column:
    """The leaves of a depth that are not in the array ``leaves``."""
    return F.array_except(F.sequence(F.lit(2**depth), F.lit(2 ** (depth + 1) - 1)), leaves)


def leaf_costs(box: Box, leaves: Column, y: Column) -> tuple[Column, Column]:
    """A row's ``cost`` (0 or 1 where all trees agree, else -1) and its least cost ``lb`` over the reachable leaves."""
    known = {t: (F.lit(1) if not lab else F.when(~y.isin(sorted(lab)), 1).otherwise(0 if len(lab) == 1 else -1)) for t, lab in box.labels.items()}

    def value(t: Column) -> Column:
        out = F.lit(1)
        for leaf, cost in known.items():
            out = F.when(t == leaf, cost).otherwise(out)
        return out

    values = F.transform(leaves, value)
    low, high = F.array_min(values), F.array_max(values)
    cost = F.when((low == high) & (low >= 0), low).otherwise(-1)
    return cost, F.when(low == 1, 1).otherwise(0)


def reachability(df: DataFrame, box: Box, features: list[str]) -> DataFrame:
    """``df`` (with ``y``) with ``reach``, ``cost`` and ``lb``."""
    cost, lb = leaf_costs(box, F.col("reach"), F.col("y"))
    return df.withColumn("reach", reach(box, features)).withColumn("cost", cost).withColumn("lb", lb)


def closed_form(df: DataFrame, box: Box, features: list[str], share: float, alpha: float, weight: Column | None = None) -> DataFrame:
    """One row: ``undetermined``, ``determined_errors``, ``bound``."""
    n = F.lit(1) if weight is None else weight
    sums = reachability(df, box, features).agg(F.coalesce(F.sum(F.when(F.col("cost") == -1, n).otherwise(0)), F.lit(0)).cast("long").alias("undetermined"), F.coalesce(F.sum(F.col("lb") * n), F.lit(0)).cast("long").alias("determined_errors"))
    return sums.withColumn("bound", F.round(F.col("determined_errors") / F.lit(share) + F.lit(alpha * box.least_splits), 6))


def closed_forms(df: DataFrame, boxes: list[Box], features: list[str], share: float, alpha: float, weight: Column | None = None) -> list[float]:
    """The closed-form bounds of several boxes in one pass."""
    if not boxes:
        return []
    n = F.lit(1) if weight is None else weight
    for i, box in enumerate(boxes):
        df = df.withColumn(f"_lb{i}", leaf_costs(box, reach(box, features), F.col("y"))[1])
    row = df.agg(*[F.coalesce(F.sum(F.col(f"_lb{i}") * n), F.lit(0)).alias(f"b{i}") for i in range(len(boxes))]).first()
    return [float(row[i]) / share + alpha * box.least_splits for i, box in enumerate(boxes)]


def closed_and_feasible(df: DataFrame, boxes: list[Box], features: list[str], share: float, alpha: float, weight: Column | None = None) -> list[float]:
    """The closed-form bounds of many boxes in one pass over the data, infinite for a box that has no tree.

    A box has one if each node that must split has an allowed feature with a data value in its threshold range; that is
    looked up in the same pass, so no values come to the driver.
    """
    if not boxes:
        return []
    n = F.lit(1) if weight is None else weight
    sums, hits = [], {}
    for i, box in enumerate(boxes):
        sums.append(F.coalesce(F.sum(leaf_costs(box, reach(box, features), F.col("y"))[1] * n), F.lit(0)).alias(f"b{i}"))
        for t, (lo, _) in box.splits.items():
            if lo:
                hits.setdefault((tuple(sorted(box.features[t])), box.threshold[t]), []).append(i)
    some = [F.max(reduce(lambda a, b: a | b, [F.col(features[f - 1]).between(*between) for f in fs], F.lit(False)).cast("int")).alias(f"h{j}") for j, (fs, between) in enumerate(hits)]
    row = df.agg(*sums, *some).first()
    out = [float(row[f"b{i}"]) / share + alpha * box.least_splits if box.ok else float("inf") for i, box in enumerate(boxes)]
    for j, those in enumerate(hits.values()):
        for i in those:
            out[i] = out[i] if row[f"h{j}"] else float("inf")
    return out


def cover_counts_of(df: DataFrame, boxes: dict[int, Box], features: list[str], weight: Column) -> dict[int, list[dict]]:
    """``cover_counts`` of many boxes by one job; there are at most classes times sets of leaves for each."""
    if not boxes:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("box"), reach(b, features).alias("reach")) for i, b in boxes.items()]))
    rows = df.select("y", weight.alias("_n"), each.alias("r")).groupBy("r.box", "y", "r.reach").agg(F.sum("_n").cast("long").alias("n")).collect()
    out: dict[int, list[dict]] = {i: [] for i in boxes}
    for r in rows:
        out[r.box].append({"y": r.y, "reach": r.reach, "n": r.n})
    return out


def cover_counts(df: DataFrame, box: Box, features: list[str], weight: Column | None = None) -> DataFrame:
    """``y, reach, n``: rows by class and reachable leaves; at most classes times sets of leaves."""
    return df.groupBy("y", reach(box, features).alias("reach")).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))


def label_cover(counts: list, box: Box, share: float, alpha: float) -> float:
    """The least cost if a row is right as soon as any leaf it can reach carries its label, over all labellings.

    Leaves are labelled one by one, best label first; a partial labelling is left when the best gains of the other
    leaves, each taken for itself, cannot bring it above the best one found.
    """
    leaves = sorted(box.labels)
    total, most = sum(c["n"] for c in counts), 0

    def gains(rows: list, t: int) -> dict[int, int]:
        found = dict.fromkeys(sorted(box.labels[t]), 0)
        for y, reach, n in rows:
            if t in reach and y in found:
                found[y] += n
        return found

    def extend(rows: list, left: list[int], right: int) -> None:
        nonlocal most
        most = max(most, right)
        each = {t: gains(rows, t) for t in left}
        if not left or right + sum(max(g.values(), default=0) for g in each.values()) <= most:
            return
        t = max(left, key=lambda t: max(each[t].values(), default=0))
        rest = [o for o in left if o != t]
        for k, n in sorted(each[t].items(), key=lambda g: -g[1]):
            extend([r for r in rows if not (t in r[1] and r[0] == k)], rest, right + n)

    extend([(c["y"], frozenset(c["reach"]), c["n"]) for c in counts], leaves, 0)
    return (total - most) / share + alpha * box.least_splits


#: Digits to which bounds of groups are cut before they are summed.
DIGITS = 9


def cut(bound: Column) -> Column:
    """Bounds cut down to decimals, whose sums do not depend on an order."""
    return (F.floor(bound * 10**DIGITS) / 10**DIGITS).cast(f"decimal(38,{DIGITS})")


#: Rows of groups that one task solves, about, where there are many.
TASK = 16_384
GROUP = "group_id long, bound double, splits string, labels string"


def group_bounds(df: DataFrame, box: Box, features: list[str], share: float, alpha: float, total: int, eps: np.ndarray, whole: bool = False, known: frozenset = frozenset()) -> DataFrame:
    """``group_id, bound`` and the best tree of each group of rows (``group_id``, features, ``y``) within the box.

    Each group is solved exactly within one task, with others of its size; the split penalty is dealt by group size, so
    that the bounds add up to one for all rows. Groups are small by construction. ``whole``: groups lie whole in parts
    already. ``known``: groups that are left out.
    """

    def work(batches):
        rows = pd.concat([b[~b["group_id"].isin(known)] if known else b for b in batches] or [pd.DataFrame()])
        if not len(rows):
            return
        names, at = np.unique(rows["group_id"].to_numpy(), return_inverse=True)
        values, trees = solve_groups(rows[features].to_numpy(float), rows["y"].to_numpy(int), at, box, share, alpha / total, eps)
        splits, labels = zip(*map(text_of, trees), strict=True)
        yield pd.DataFrame({"group_id": names, "bound": values, "splits": splits, "labels": labels})

    rows = df.select("group_id", *features, "y")
    # The number of parts is stated: the rows are few bytes and much work, which Spark would put into one task.
    rows = rows if whole else rows.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, total // TASK), "group_id")
    return rows.mapInPandas(work, GROUP)


def text_of(tree: Tree) -> tuple[str, str]:
    """Splits and labels of a tree as columns."""
    return json.dumps(tree.split), json.dumps(tree.label)


def tree_of(row, depth: int) -> Tree:
    """The tree of a row of ``group_bounds``."""
    split, label = json.loads(row["splits"]), json.loads(row["labels"])
    return Tree(depth, {int(t): (f, b) for t, (f, b) in split.items()}, {int(t): k for t, k in label.items()})


#: Trees as columns: a node without split has feature 0, a leaf without label has label 0.
SOLVED = "box int, group_id long, bound double, feature array<int>, threshold array<double>, label array<int>"
BOXES = "box int, parent int, least array<int>, most array<int>, low array<double>, high array<double>, features array<array<int>>, labels array<array<int>>"


def encoded(tree: Tree) -> tuple[list[int], list[float], list[int]]:
    return [tree.split.get(t, (0, 0.0))[0] for t in tree.branches], [float(tree.split.get(t, (0, 0.0))[1]) for t in tree.branches], [tree.label.get(t, 0) for t in tree.leaves]


def decoded(row, depth: int) -> Tree:
    """The tree of a row of ``feature, threshold, label``."""
    split = {t: (f, b) for t, (f, b) in enumerate(zip(row["feature"], row["threshold"], strict=True), 1) if f}
    return Tree(depth, split, {2**depth + i: k for i, k in enumerate(row["label"]) if k})


def box_rows(boxes: dict[int, tuple[int, Box]]) -> list[tuple]:
    """Boxes (by number, each with its parent's) as rows of ``BOXES``."""
    out = []
    for i, (parent, b) in boxes.items():
        nodes = sorted(b.splits)
        out.append((i, parent, [b.splits[t][0] for t in nodes], [b.splits[t][1] for t in nodes], [float(b.threshold[t][0]) for t in nodes], [float(b.threshold[t][1]) for t in nodes], [sorted(b.features[t]) for t in nodes], [sorted(b.labels[t]) for t in sorted(b.labels)]))
    return out


def holds(tolerance: float = 1e-9) -> Column:
    """Whether the tree of a row lies in the box of the row, as ``Box.holds`` has it."""
    col, at = F.col, F.get

    def node(f: Column, i: Column) -> Column:
        there = (f > 0).cast("int")
        inside = F.array_contains(at(col("features"), i), f) & at(col("threshold"), i).between(at(col("low"), i) - tolerance, at(col("high"), i) + tolerance)
        return there.between(at(col("least"), i), at(col("most"), i)) & ((f == 0) | inside)

    def leaf(k: Column, i: Column) -> Column:
        return (k == 0) | F.array_contains(at(col("labels"), i), k)

    every = lambda c: F.forall(c, lambda x: x)
    return every(F.transform("feature", node)) & every(F.transform("label", leaf))


def groups_in_boxes(groups: DataFrame, asked: DataFrame, boxes: dict[int, Box], features: list[str], share: float, alpha: float, total: int, eps: np.ndarray, classes: int = 0) -> DataFrame:
    """``SOLVED``: the bound and best tree of each group within the boxes that ``asked`` (``group_id, boxes``) names for it.

    ``groups`` lie whole in parts. A box that has no tree for a group gives an infinite bound and a tree without splits.
    Where ``asked`` has ``pull``, a group pays for its choices among ``classes`` by these numbers (``pull.tuned``).
    """

    def work(batches):
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame()])
        if not len(rows):
            return
        names, at = np.unique(rows["group_id"].to_numpy(), return_inverse=True)
        x, y = rows[features].to_numpy(float), rows["y"].to_numpy(int)
        first = rows.drop_duplicates("group_id").sort_values("group_id")
        wanted = first["boxes"].tolist()
        pull = np.stack(first["pull"].to_numpy()) if "pull" in rows else None
        for i, box in boxes.items():
            mine = np.array([i in w for w in wanted])
            some = mine[at]
            if not some.any():
                continue
            place = np.cumsum(mine) - 1
            paid = None if pull is None else Pull.of(pull[mine], box.depth, len(features), classes)
            values, trees = solve_groups(x[some], y[some], place[at[some]], box, share, alpha / total, eps, paid)
            feature, threshold, label = zip(*map(encoded, trees), strict=True)
            yield pd.DataFrame({"box": i, "group_id": names[mine], "bound": values, "feature": feature, "threshold": threshold, "label": label})

    rows = groups.select("group_id", *features, "y").join(asked, "group_id")
    return rows.mapInPandas(work, SOLVED)
