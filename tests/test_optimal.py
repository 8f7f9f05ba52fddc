"""Scans and exact searches against plain versions on arrays."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions import prep
from timberline.operators import exact, optimal, scan
from timberline.operators.greedy import cart
from timberline.operators.tree import score


def made(spark, n=400, p=3, values=6, classes=3, seed=1):
    random = np.random.default_rng(seed)
    x = random.integers(0, values, (n, p)) / values
    y = 1 + (x.sum(1) * classes / p + random.normal(0, 0.4, n)).clip(0, classes - 1).astype(int)
    names = [f"f{j + 1}" for j in range(p)]
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in names) + ", y int")
    return df, names, x, y


def layout(df, names, classes, **limits):
    found, stats = scan.class_stats(prep.cells(df, names), classes)
    return scan.Layout(found, names, stats)


@pytest.fixture
def small(monkeypatch):
    """Blocks of a few rows, so that values and boxes reach over many."""
    monkeypatch.setattr(scan, "BLOCK", 7)
    monkeypatch.setattr(scan, "TOGETHER", 3)


def plain(x, y, classes, box, least=0):
    inside = np.all([(x[:, j] >= lo) & (x[:, j] < hi) for j, (lo, hi) in enumerate(box)], 0)
    x, y = x[inside], y[inside]
    count = lambda some: np.bincount(some, minlength=classes + 1)[1:]
    best = (np.inf, 0, 0.0)
    for f, v in [(f, v) for f in range(x.shape[1]) for v in np.unique(x[:, f])]:
        left, right = count(y[x[:, f] < v]), count(y[x[:, f] >= v])
        if min(left.sum(), right.sum()) >= max(1, least):
            best = min(best, (left.sum() - left.max() + right.sum() - right.max(), f + 1, v))
    return count(y), best


def test_facts_of_boxes(spark, small):
    df, names, x, y = made(spark)
    inf = float("inf")
    boxes = [scan.anywhere(3), ((0.2, 0.7), (-inf, inf), (-inf, inf)), ((-inf, 0.5), (0.3, inf), (-inf, 0.9)), ((5.0, 6.0),) * 3, ((0.5, 0.6), (-inf, inf), (0.1, 0.4))]
    rows = layout(df, names, 3)
    assert rows.n_blocks > 50
    for least in (0, 40):
        for box, fact in zip(boxes, rows.facts(boxes, least=least), strict=True):
            sums, best = plain(x, y, 3, box, least)
            assert fact.sums.tolist() == sums.tolist()
            assert (fact.value, fact.feature) == best[:2] and (not fact.feature or fact.threshold == pytest.approx(best[2]))


def enumerated(x, y, depth, share, alpha, least=0):
    """The least cost over all trees, by trying every cut at every node."""
    wrong = len(y) - np.bincount(y).max() if len(y) else 0
    best = wrong / share
    if depth:
        for f, v in [(f, v) for f in range(x.shape[1]) for v in np.unique(x[:, f])[1:]]:
            left = x[:, f] < v
            if min(left.sum(), (~left).sum()) >= max(1, least):
                best = min(best, alpha + enumerated(x[left], y[left], depth - 1, share, alpha, least) + enumerated(x[~left], y[~left], depth - 1, share, alpha, least))
    return best


@pytest.mark.parametrize(("depth", "least", "n", "values"), [(1, 0, 300, 9), (2, 0, 300, 9), (2, 45, 300, 9), (3, 0, 90, 4)])
def test_exact_trees_against_enumeration(spark, monkeypatch, depth, least, n, values):
    monkeypatch.setattr(optimal, "FIRST", 3)
    monkeypatch.setattr(optimal, "LATER", 2)
    df, names, x, y = made(spark, n, 2 if depth < 3 else 3, values, seed=depth + least)
    rows = layout(df, names, 3)
    monkeypatch.setattr(rows, "grid", [g[::3] for g in rows.grid])
    search = optimal.Optimal(rows, depth, 0.4, 0.7, least=least)
    found = search.fit()
    assert found.cost == pytest.approx(enumerated(x, y, depth, 0.4, 0.7, least))
    tree = optimal.classified(found, depth)
    assert score(df, [tree], names, 0.4, 0.7).first().cost == pytest.approx(found.cost, abs=1e-5)
    assert found.bound <= found.cost + 1e-9 and (least or found.bound == pytest.approx(found.cost))


def test_continuous_features_try_few_cuts(spark):
    random = np.random.default_rng(3)
    x = random.random((3000, 2))
    y = 1 + ((x[:, 0] > 0.37) ^ (x[:, 1] > 0.61)).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y, strict=True)], "f1 double, f2 double, y int")
    search = optimal.Optimal(layout(df, ["f1", "f2"], 2), 2, 0.5, 0.05)
    found = search.fit()
    assert found.cost == pytest.approx(3 * 0.05) and len(found.split) == 3
    assert search.scanned < 1500  # of 12,000 sides of cuts


@pytest.mark.parametrize("shape", [0b100, 0b101, 0b111])
def test_shapes(spark, shape):
    df, names, x, y = made(spark, 200, 2, 7, seed=shape)
    found = optimal.Optimal(layout(df, names, 3), 2, 0.4, 0.05, shape=shape).fit()
    cells = prep.cells(df, names).toPandas()
    want, _ = exact.fit(cells[names].to_numpy(), cells["y"].to_numpy(), cells["n"].to_numpy(float), 2, 0.4, 0.05, shape=shape)
    assert found.cost == pytest.approx(want)
    assert set(found.split) == {t for t in (1, 2, 3) if shape >> (3 - t) & 1}


def test_regression_tree(spark):
    random = np.random.default_rng(5)
    x = random.integers(0, 8, (250, 2)) / 8
    y = np.where(x[:, 0] < 0.5, 3 * x[:, 1], 10 - (x[:, 1] >= 0.25) * 4) + random.normal(0, 0.3, 250)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y, strict=True)], "f1 double, f2 double, v double")
    found, stats = scan.square_stats(df, "v")
    best = optimal.Optimal(scan.Layout(found, ["f1", "f2"], stats), 2, 1.0, 0.05, criterion="squares").fit()

    def tried(x, y, depth):
        least = ((y - y.mean()) ** 2).sum()
        if depth:
            for f, v in [(f, v) for f in range(2) for v in np.unique(x[:, f])[1:]]:
                left = x[:, f] < v
                least = min(least, 0.05 + tried(x[left], y[left], depth - 1) + tried(x[~left], y[~left], depth - 1))
        return least

    assert best.cost == pytest.approx(tried(x, y, 2))
    assert all(np.isfinite(m) for m in optimal.means(best).values()) and len(optimal.means(best)) == len(best.split) + 1


def test_nulls_one_value_and_empty(spark):
    df = spark.createDataFrame([(None, 0.5, 1), (None, 0.5, 1), (0.3, 0.5, 2), (0.7, 0.5, 1)], "f1 double, f2 double, y int")
    found = optimal.Optimal(layout(df, ["f1", "f2"], 2), 2, 0.75, 0.05).fit()
    assert found.cost == pytest.approx(0.1) and found.split[1][0] == 1
    none = optimal.Optimal(layout(df.where("y > 5"), ["f1", "f2"], 2), 2, 0.75, 0.05).fit()
    assert none.cost == 0 and not none.split
    assert cart(df.where("y > 5"), ["f1", "f2"], 2).split == {}


def test_greedy_tree_on_many_values(spark):
    random = np.random.default_rng(8)
    x = random.random(2000)
    y = 1 + (x > 0.123456).astype(int)
    df = spark.createDataFrame([(float(a), int(k)) for a, k in zip(x, y, strict=True)], "f1 double, y int")
    tree = cart(df, ["f1"], 2)
    assert tree.split == {1: (1, pytest.approx(x[x > 0.123456].min()))}
    assert tree.label == {5: 1, 7: 2}
    assert score(df, [tree], ["f1"], 0.9, 0.05).first().errors == 0
    weighted = cart(df.withColumn("w", F.lit(3)), ["f1"], 2, weight="w")
    assert weighted == tree
