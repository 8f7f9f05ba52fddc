import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_trees import OPTIMUM, X, Y, toy  # noqa: F401
from timberline.operators import bounds, box, exact, groups
from timberline.operators.exact import PIECES, Pull, piece
from timberline.operators.pull import tuned
from timberline.operators.search import Search
from timberline.operators.tree import Tree

FEATURES = ["f1", "f2"]


def paid(t, x, y, share, alpha, pull):
    """Cost of a tree for one group, with what it pays, row by row; None if a row lies between the sides of a split."""
    eps, where = exact.gaps(x), []
    for row in x:
        n = 1
        while n < 2**t.depth:
            f, b = t.split.get(n, (0, 0))
            if f and b - eps[f - 1] + 1e-9 < row[f - 1] < b - 1e-9:
                return None
            n = 2 * n + (not f or row[f - 1] >= b - 1e-9)
        where.append(n)
    wrong = sum(t.label[n] != k for n, k in zip(where, y, strict=True))
    cost = wrong / share + alpha * len(t.split) + sum(pull.split[0, n - 1, f - 1, piece(b)] for n, (f, b) in t.split.items())
    return cost + sum(pull.label[0, leaf - 2**t.depth, k - 1] for leaf, k in t.label.items())


def leaves_of(split, depth, n=1):
    if n >= 2**depth:
        return [n]
    if n not in split:
        return leaves_of(split, depth, 2 * n + 1)
    return leaves_of(split, depth, 2 * n) + leaves_of(split, depth, 2 * n + 1)


def every(x, y, b, share, alpha, pull, depth):
    """Least cost with payments over all trees in the box: thresholds next to values, at borders of the box and of pieces."""
    eps, nodes = exact.gaps(x), range(1, 2**depth)
    cuts = {}
    for t in nodes:
        cuts[t] = [None] if not b.splits[t][0] else []
        if b.splits[t][1]:
            for f in b.features[t]:
                at = np.unique(np.concatenate([x[:, f - 1], x[:, f - 1] + eps[f - 1], list(b.threshold[t]), np.arange(PIECES) / PIECES]))
                cuts[t] += [(f, float(v)) for v in at if max(0, b.threshold[t][0]) <= v <= min(1, b.threshold[t][1])]
    best = np.inf
    for chosen in itertools.product(*cuts.values()):
        split = {t: c for t, c in zip(nodes, chosen, strict=True) if c}
        if any(t > 1 and t // 2 not in split for t in split):
            continue
        if any(t not in split and not b.may_stop(t) for t in nodes):
            continue
        leaves = leaves_of(split, depth)
        if any(not b.labels[leaf] for leaf in leaves):
            continue
        for labels in itertools.product(*[sorted(b.labels[leaf]) for leaf in leaves]):
            cost = paid(Tree(depth, split, dict(zip(leaves, labels, strict=True))), x, y, share, alpha, pull)
            best = best if cost is None else min(best, cost)
    return best


@pytest.mark.parametrize("depth", [1, 2])
def test_payments_against_enumeration(depth):
    r, tried = random.Random(3 + depth), 0
    numbers = np.random.default_rng(5)
    for _ in range(40 if depth == 1 else 14):
        n = 5
        p = 2 if depth == 1 else r.randint(1, 2)
        x = np.array([[r.randrange(3) / 2 if depth == 2 else r.randrange(5) / 4 for _ in range(p)] for _ in range(n)])
        y = np.array([r.randint(1, 2) for _ in range(n)])
        b = box.free(depth, p, 2)
        for _ in range(r.randrange(4)):
            kind = r.choice("dab")
            if open_ := b.undetermined()[kind]:
                b = r.choice(box.branch(b, kind, r.choice(open_)))
        if not b.ok or any(not b.labels[leaf] for leaf in b.labels):
            continue
        tried += 1
        pull = Pull.of(numbers.normal(0, 1.5, (1, Pull.size(depth, p, 2))), depth, p, 2)
        values, trees = exact.solve_groups(x, y, np.zeros(n, int), b, 0.5, 0.05 / n, exact.gaps(x), pull)
        assert values[0] == pytest.approx(every(x, y, b, 0.5, 0.05, pull, depth))
        if values[0] < np.inf:
            assert b.holds(trees[0]) and paid(trees[0], x, y, 0.5, 0.05, pull) == pytest.approx(values[0])
            line = np.concatenate([pull.split.ravel(), pull.label.ravel()])
            free_of_charge = Pull.of(np.zeros((1, len(line))), depth, p, 2)
            assert line[Pull.chosen(trees[0], p, 2)].sum() == pytest.approx(values[0] - paid(trees[0], x, y, 0.5, 0.05, free_of_charge))
    assert tried >= 8


def test_without_payments_nothing_changes():
    numbers = np.random.default_rng(1)
    x, y, at = numbers.integers(0, 9, (60, 2)) / 8, numbers.integers(1, 4, 60), np.sort(numbers.integers(0, 6, 60))
    for depth in (1, 2):
        b = box.free(depth, 2, 3)
        none = Pull.of(np.zeros((at.max() + 1, Pull.size(depth, 2, 3))), depth, 2, 3)
        values, trees = exact.solve_groups(x, y, at, b, 0.4, 0.001, exact.gaps(x))
        same, others = exact.solve_groups(x, y, at, b, 0.4, 0.001, exact.gaps(x), none)
        assert same == pytest.approx(values) and others == trees
    with pytest.raises(ValueError):
        exact.solve_groups(x, y, at, box.free(3, 2, 3), 0.4, 0.001, exact.gaps(x), none)


@pytest.mark.parametrize("depth", [1, 2])
def test_bounds_rise_and_stay_below_the_optimum(toy, depth):  # noqa: F811
    share, b = 5 / 13, box.free(depth, 2, 3)
    dealt = groups.deal(toy, "y", F.col("row_id"), n_groups=3, carry=True)
    plain = sum(r.bound for r in bounds.group_bounds(dealt, b, FEATURES, share, 0.05, 13, exact.gaps(X)).collect())
    pulls, values = tuned(dealt, b, FEATURES, share, 0.05, 13, exact.gaps(X), 3, OPTIMUM[depth][2], 20, 2)
    assert values[0] == pytest.approx(plain, abs=1e-6) and max(values) > plain + 0.5
    assert max(values) <= OPTIMUM[depth][2] + 1e-9
    lines = np.array([r.pull for r in pulls.collect()])
    assert len(lines) == 3 and np.abs(lines.sum(0)).max() < 1e-9


def test_no_rows(spark):
    empty = spark.createDataFrame([], "group_id long, f1 double, f2 double, y int")
    pulls, values = tuned(empty, box.free(1, 2, 3), FEATURES, 0.5, 0.05, 1, np.array([0.1, 0.1]), 3, 1.0, 3, 1)
    assert values[0] == 0 and pulls.count() == 0


def test_search_with_multipliers(toy):  # noqa: F811
    search = Search(toy, FEATURES, 2, share=5 / 13, rounds=15)
    search.n_groups = 3
    search.groups = search.kept(groups.deal(toy, "y", F.col("row_id"), n_groups=3, carry=True))
    _, cost, bound = search.run(max_nodes=30, batch=4)
    assert cost == pytest.approx(OPTIMUM[2][2], abs=1e-6) and bound <= cost + 1e-9
    with pytest.raises(ValueError):
        Search(toy, FEATURES, 3, rounds=2)
