import itertools
import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from timberline.functions import prep
from timberline.operators import bounds, box, exact, groups, tree
from timberline.operators.search import Node, Search
from timberline.operators.tree import Tree
from timberline.plans import catalog
from timberline.sources import tables
from timberline.streaming import scoring

# The golden table, coordinates in thirds, and its optimum by depth (errors, splits, cost).
TOY = [(0, 2, 1), (0, 1, 1), (0, 0, 1), (1, 0, 1), (2, 0, 1), (1, 2, 2), (2, 2, 2), (1, 1, 2), (2, 1, 2), (3, 1, 3), (3, 2, 3), (3, 3, 3), (2, 3, 3)]
OPTIMUM = {0: (8, 0, 20.80), 1: (5, 1, 13.05), 2: (3, 2, 7.90), 3: (1, 3, 2.75)}
X, Y = np.array([r[:2] for r in TOY]) / 3, np.array([r[2] for r in TOY])


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(i, a / 3, b / 3, y) for i, (a, b, y) in enumerate(TOY)], "row_id long, f1 double, f2 double, y int").cache()


def errors(t, x, y):
    def pred(row):
        n = 1
        while n < 2**t.depth:
            n = 2 * n + (n not in t.split or row[t.split[n][0] - 1] + 1e-12 >= t.split[n][1])
        return t.label.get(n, 0)

    return sum(pred(r) != k for r, k in zip(x, y, strict=True))


@pytest.mark.parametrize("depth", OPTIMUM)
def test_golden_optimum(spark, toy, depth):
    cost, found = exact.fit(X, Y, depth=depth, share=5 / 13)
    assert (errors(found, X, Y), len(found.split), round(cost, 2)) == OPTIMUM[depth]
    row = tree.score(toy, [found], ["f1", "f2"], 5 / 13, 0.05).first()
    assert (row.errors, row.splits, round(row.cost, 2)) == OPTIMUM[depth]


def every_tree(x, y, b, eps, share, alpha):
    """Least cost of a tree of depth 2 in the box, by trying all splits and labels."""
    cuts = {t: [None] if b.may_stop(t) else [] for t in (1, 2, 3)}
    for t in (1, 2, 3):
        if b.splits[t][1]:
            cuts[t] += [(f, v) for f in b.features[t] for v in np.unique(np.concatenate([x[:, f - 1], x[:, f - 1] + eps[f - 1], list(b.threshold[t])])) if max(0, b.threshold[t][0]) <= v <= min(1, b.threshold[t][1])]
    best = np.inf
    for c1, c2, c3 in itertools.product(cuts[1], cuts[2], cuts[3]):
        if c1 is None and (c2 or c3):
            continue
        where, fine = [], True
        for row in x:
            n = 1
            while n < 4:
                c = (c1, c2, c3)[n - 1]
                if c and c[1] - eps[c[0] - 1] + 1e-9 < row[c[0] - 1] < c[1] - 1e-9:
                    fine = False  # neither left nor right of the threshold
                n = 2 * n + (not c or row[c[0] - 1] >= c[1] - 1e-9)
            where.append(n)
        if not fine:
            continue
        wrong = 0
        for leaf in (4, 5, 6, 7):
            at = [k for n, k in zip(where, y, strict=True) if n == leaf]
            lab = b.labels[leaf]
            wrong += len(at) if not lab else min(sum(k != m for k in at) for m in lab)
        best = min(best, wrong / share + alpha * sum(c is not None for c in (c1, c2, c3)))
    return best


def test_boxed_optimum_against_enumeration():
    r = random.Random(7)
    tried = 0
    for _ in range(120):
        x, y = np.array([[r.randrange(4) / 3 for _ in range(2)] for _ in range(5)]), np.array([r.randint(1, 2) for _ in range(5)])
        b = box.free(2, 2, 2)
        for _ in range(r.randrange(5)):
            kind = r.choice("dacb")
            open_ = b.undetermined()[kind]
            if open_:
                b = r.choice(box.branch(b, kind, r.choice(open_)))
        if not b.ok:
            continue
        tried += 1
        eps = exact.gaps(x)
        value, found = exact.Solver(x, y, np.ones(5), b, 0.5, 0.05, eps).solve()
        assert value == pytest.approx(every_tree(x, y, b, eps, 0.5, 0.05))
        if value < np.inf:
            assert b.holds(found)
    assert tried > 60


def test_bounds_are_below_the_optimum(spark, toy):
    features, share = ["f1", "f2"], 5 / 13
    b = box.branch(box.branch(box.free(2, 2, 3), "d", 1)[1], "b", 1)[0]
    best, _ = exact.Solver(X, Y, np.ones(13), b, share, 0.05, exact.gaps(X)).solve()
    cf = bounds.closed_forms(toy, [b], features, share, 0.05)[0]
    assert cf == pytest.approx(bounds.closed_form(toy, b, features, share, 0.05).first().bound, abs=1e-6)
    cover = bounds.label_cover([r.asDict() for r in bounds.cover_counts(toy, b, features).collect()], b, share, 0.05)
    dealt = groups.deal(toy, "y", F.col("row_id"), n_groups=2, carry=True)
    parts = bounds.group_bounds(dealt, b, features, share, 0.05, 13, exact.gaps(X)).collect()
    assert cf <= cover + 1e-9 and max(cover, sum(p.bound for p in parts)) <= best + 1e-9


def test_label_cover_is_the_best_labelling():
    r = random.Random(4)
    for depth, k in ((1, 3), (2, 3), (2, 4)):
        leaves = range(2**depth, 2 ** (depth + 1))
        for _ in range(12):
            b = box.free(depth, 2, k)
            b = replace(b, labels={t: frozenset(r.sample(range(1, k + 1), r.randrange(k + 1))) for t in leaves})
            counts = [{"y": r.randrange(1, k + 1), "reach": r.sample(list(leaves), r.randrange(1, len(leaves) + 1)), "n": r.randrange(1, 9)} for _ in range(25)]
            most = max(sum(c["n"] for c in counts if any(labels[t - 2**depth] == c["y"] for t in c["reach"])) for labels in itertools.product(*[sorted(b.labels[t]) or [0] for t in leaves]))
            assert bounds.label_cover(counts, b, 0.5, 0.05) == pytest.approx((sum(c["n"] for c in counts) - most) / 0.5)
    many = [{"y": r.randrange(1, 11), "reach": [t for t in range(8, 16) if r.random() < 0.3] or [8], "n": r.randrange(1, 1000)} for _ in range(800)]
    assert bounds.label_cover(many, box.free(3, 2, 10), 0.5, 0.05) >= 0


def test_limits_of_an_exact_tree(toy):
    """Against all stumps: the least weight of a side; against all trees of the shape: which nodes split."""
    cuts = [(f, v) for f in (0, 1) for v in np.unique(X[:, f])]
    for least in (1, 4, 6):
        want = min([(13 - np.bincount(Y).max()) / 0.4] + [sum(s.size - np.bincount(Y[s]).max() for s in (np.flatnonzero(X[:, f] < v), np.flatnonzero(X[:, f] >= v))) / 0.4 + 0.05 for f, v in cuts if least <= (X[:, f] < v).sum() <= 13 - least])
        cost, found = exact.fit(X, Y, depth=1, share=0.4, least=least)
        assert cost == pytest.approx(want)
        assert all(min((X[:, f - 1] + 1e-12 < b).sum(), (X[:, f - 1] + 1e-12 >= b).sum()) >= least for f, b in found.split.values())
    for shape, nodes in ((0b100, {1}), (0b110, {1, 2}), (0b101, {1, 3}), (0b111, {1, 2, 3})):
        cost, found = exact.fit(X, Y, depth=2, share=0.4, shape=shape)
        assert set(found.split) == nodes
        assert cost == pytest.approx(every_tree(X, Y, box.free(2, 2, 3, shape), exact.gaps(X), 0.4, 0.05))


def test_groups_by_leaf(spark, toy):
    t = Tree(2, {1: (1, 0.5), 2: (2, 0.5)}, {4: 1, 5: 1, 7: 3})
    rows = [(i, (i * 37 % 101) / 100, (i * 53 % 97) / 96, i % 3 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, f1 double, f2 double, y int")
    dealt = groups.leaf_deal(df, t, ["f1", "f2"], "row_id", 10, trials=2).withColumn("leaf", tree.leaf(t, ["f1", "f2"])).collect()
    assert sorted(r.row_id for r in dealt) == list(range(300))
    sizes = np.bincount([r.group_id for r in dealt])
    assert len(sizes) == 10 and set(sizes) == {30}
    for at in {r.leaf for r in dealt}:
        some = np.bincount([r.group_id for r in dealt if r.leaf == at], minlength=10)
        assert some.max() - some.min() <= 1
    few = groups.leaf_deal(df.limit(4), t, ["f1", "f2"], "row_id", 10).collect()
    assert len({r.group_id for r in few}) == 4
    assert groups.leaf_deal(df.limit(0), t, ["f1", "f2"], "row_id", 10).count() == 0


@pytest.mark.parametrize("options", [{"grouping": "leaf"}, {"methods": "CF+MILP"}])
def test_search_with_other_groups_or_none(toy, options):
    _, cost, bound = Search(toy, ["f1", "f2"], 1, **options).run(max_nodes=12, seconds=60)
    assert bound <= OPTIMUM[1][2] + 1e-6 <= cost + 2e-6


def test_ways_to_an_incumbent(toy):
    search = Search(toy, ["f1", "f2"], 2)
    a, b = Tree(2, {1: (1, 0.5)}, {5: 1, 7: 3}), Tree(2, {1: (1, 0.7)}, {5: 1, 7: 3})
    search.propose("slt", [a, b])
    first = search.ub
    search.propose("merg", [a, b])
    search.propose("heur")
    assert OPTIMUM[2][2] - 1e-6 <= search.ub <= first
    for bad in (lambda: search.propose("none"), lambda: Search(toy, ["f1", "f2"], 2, grouping="none")):
        with pytest.raises(ValueError):
            bad()


def test_read_data(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,7,2,b\n3,7,NA,a\n5,7,4,a\n2,7,6,b\n")
    df, kept, k = tables.read_data(spark, str(path), 3)
    assert kept == ["f1", "f3"] and k == 2 and df.columns == ["row_id", "f1", "f3", "y"]
    assert sorted((r.f1, r.f3, r.y) for r in df.collect()) == [(0.0, 0.0, 2), (0.25, 1.0, 2), (1.0, 0.5, 1)]
    path.write_text("")
    assert tables.read_data(spark, str(path), 3)[2] == 0


def test_search_finds_the_optimum(spark, toy):
    search = Search(toy, ["f1", "f2"], 2)
    found, cost, bound = search.run(max_nodes=60, seconds=60)
    assert cost == pytest.approx(7.90) and bound <= cost and errors(found, X, Y) == 3
    log = search.bound_log(spark).orderBy("iter").collect()
    assert all(a.lb <= b.lb + 1e-9 for a, b in zip(log, log[1:], strict=False)) and all(r.lb <= r.ub for r in log)
    with pytest.raises(ValueError):
        Search(toy, ["f1", "f2"], 2, methods="MILP")


def test_candidates_only_improve_the_incumbent(toy):
    search = Search(toy, ["f1", "f2"], 2)
    search.offer([Tree(2)])
    costs = [search.ub]
    search.bootstrap(toy, n_groups=3, size=20)
    costs.append(search.ub)
    search.offer(search.drawn(box.free(2, 2, 3), search.tree))
    assert costs[0] >= costs[1] >= search.ub >= OPTIMUM[2][2]


def test_results_of_groups_are_kept_for_the_halves(toy):
    """A box bounded again finds all its groups in the stored results; its halves solve what no longer lies in them."""
    search = Search(toy, ["f1", "f2"], 2)
    (first,) = search.bound([Node(0.0, 1, box.free(2, 2, 3))])
    solved = search.solved
    (again,) = search.bound([first])
    assert again.lb == first.lb and search.solved == solved and again.path != first.path
    halves = [Node(0.0, 2, b, first.number, first.path) for b in box.branch(first.box, "b", 1)]
    fresh = [Node(0.0, 2, n.box) for n in halves]
    assert [n.lb for n in search.bound(halves)] == pytest.approx([n.lb for n in search.bound(fresh)])


@pytest.mark.parametrize("batch", [3, 8])
def test_rounds_of_several_boxes(spark, toy, batch):
    search = Search(toy, ["f1", "f2"], 2)
    found, cost, bound = search.run(max_nodes=9, batch=batch)
    assert cost == pytest.approx(7.90) and bound <= cost and errors(found, X, Y) == 3
    done = [r[0] for r in search.log]
    assert done[:4] == ([0, 1, 3, 6] if batch == 3 else [0, 1, 3, 7]) and done[-1] == 9 and max(np.diff(done)) <= batch


def test_trees_in_boxes_as_columns(spark):
    random = np.random.default_rng(4)
    boxes, trees = [], []
    for _ in range(12):
        b = box.free(2, 2, 3)
        for _ in range(int(random.integers(1, 6))):
            open_ = [(k, at) for k, some in b.undetermined().items() for at in some]
            b = box.branch(b, *open_[int(random.integers(len(open_)))])[int(random.integers(2))]
        boxes.append(b)
        nodes = [t for t in (1, 2, 3) if random.random() < 0.7 and (t == 1 or trees is not None)]
        trees.append(Tree(2, {t: (int(random.integers(1, 3)), float(random.random())) for t in nodes}, {t: int(k) for t, k in zip((4, 5, 6, 7), random.integers(0, 4, 4), strict=True) if k}))
    trees += [Tree(2, {1: (1, 0.5)}, {5: 1, 7: 2}), Tree(2, {}, {7: 3})]
    rows = spark.createDataFrame(bounds.box_rows({i: (0, b) for i, b in enumerate(boxes)}), bounds.BOXES)
    table = spark.createDataFrame([(0, j, *bounds.encoded(t)) for j, t in enumerate(trees)], "parent int, tree int, feature array<int>, threshold array<double>, label array<int>")
    got = {(r.box, r.tree): r.inside for r in table.join(rows, "parent").select("box", "tree", bounds.holds().alias("inside")).collect()}
    assert got == {(i, j): b.holds(t) for i, b in enumerate(boxes) for j, t in enumerate(trees)}
    assert set(got.values()) == {True, False}
    assert [bounds.decoded(r, 2) for r in table.orderBy("tree").collect()] == trees


def test_feasibility_with_the_closed_form(toy):
    values = {1: sorted({r[0] / 3 for r in TOY}), 2: sorted({r[1] / 3 for r in TOY})}
    b = box.branch(box.free(2, 2, 3), "d", 2)[1]
    some = [b, replace(b, threshold=b.threshold | {2: (0.4, 0.6)}), replace(b, threshold=b.threshold | {1: (0.3, 0.35)}), replace(b, features=b.features | {2: frozenset()}), box.free(2, 2, 3)]
    found = bounds.closed_and_feasible(toy, some, ["f1", "f2"], 5 / 13, 0.05)
    assert [v < float("inf") for v in found] == [box.feasible(c, values) for c in some] == [True, False, True, False, True]
    fine = [c for c in some if box.feasible(c, values)]
    assert [v for v in found if v < float("inf")] == pytest.approx(bounds.closed_forms(toy, fine, ["f1", "f2"], 5 / 13, 0.05))


def test_reachable_leaves_and_the_others(toy):
    b = box.branch(box.free(2, 2, 3), "b", 1)[1]
    found = bounds.reachability(toy, b, ["f1", "f2"]).withColumn("rest", bounds.unreachable(F.col("reach"), 2)).collect()
    assert all(sorted(r.reach + r.rest) == [4, 5, 6, 7] for r in found)


def test_numbering():
    assert tree.ancestors(6) == ([3], [1]) and tree.ancestors(1) == ([], [])
    assert tree.subtree(2, 2) == ([2], [4, 5]) and tree.subtree(1, 2) == ([1, 2, 3], [4, 5, 6, 7])
    assert tree.rightmost(1, 3) == 15 and tree.shapes(2) == 5


def test_edits(spark, toy):
    t = Tree(2, {1: (1, 0.5), 3: (2, 0.25)}, {5: 1, 6: 2, 7: 3})
    assert tree.same(t, t) and not tree.same(t, Tree(2, {1: (2, 0.5), 3: (2, 0.25)}, t.label))
    assert tree.pruned(t, 0) is t
    assert tree.pruned(t, 0b110) == Tree(2, {1: (1, 0.5), 2: (1, 0.5)}, {4: 1, 5: 1, 6: 2, 7: 3})
    assert tree.pruned(t, 0b011).split == {}  # no split below a node without one
    m = tree.merged([t, Tree(2, {1: (1, 0.7)}, {}), Tree(2, {1: (2, 0.1), 2: (2, 0.1)}, {})])
    assert m.split == {1: (1, 0.6)}
    assert tree.render(t, ["a", "b"]).splitlines() == ["[1] a >= 0.5", "  [5] class 1", "  [3] b >= 0.25", "    [6] class 2", "    [7] class 3"]
    assert tree.dot(t, ["a", "b"]).count("->") == 5
    assert t.to_df(spark).count() == 7


def test_relabelling_takes_the_smaller_class_of_equals(toy):
    t = tree.relabelled(Tree(1), tree.leaf_counts(toy, Tree(1), ["f1", "f2"]))
    assert t.label == {3: 1}


def test_branching_keeps_boxes_consistent():
    b = box.free(2, 3, 3)
    left, right = box.branch(b, "d", 2)
    assert left.labels[4] == frozenset() and left.labels[5] and left.splits[2] == (0, 0)
    assert right.splits[1] == (1, 1) and right.splits[2] == (1, 1)
    forbid, fix = box.branch(b, "a", (2, 1))
    assert forbid.features[1] == {1, 3} and fix.features[1] == {2}
    assert [x.threshold[1] for x in box.branch(b, "b", 1)] == [(0.0, 0.5), (0.5, 1.0)]
    assert box.free(2, 3, 3, shape=0b100).splits == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    assert box.feasible(fix, {1: [0.0], 2: [0.5], 3: []}) and not box.feasible(box.branch(right, "b", 1)[0], {1: [0.9], 2: [], 3: []})


def test_split_and_deal(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(400)], "k long, y boolean")
    split = prep.stratified_split(df, "y", F.pmod(F.col("k") * 7919, F.lit(104729)), "k")
    counts = {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(True, "train"): 67, (True, "valid"): 33, (True, "test"): 34, (False, "train"): 133, (False, "valid"): 66, (False, "test"): 67}
    sizes = [r["count"] for r in groups.deal(df, "y", F.col("k"), n_groups=7, carry=True).groupBy("group_id").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert groups.group_count(30, 2, 3, 2) == 2 and groups.group_count(2000, 4, 3, 3) == 20


def test_tables(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("  1, 2.5,  a\r\nNA,1,b\r\n3,4,b")
    df = tables.delimited(spark, str(path), 2)
    assert sorted(tuple(r) for r in df.collect()) == [(1.0, 2.5, "a"), (3.0, 4.0, "b")]
    tables.write_delimited(df, str(tmp_path / "out"), header=True)
    assert tables.delimited(spark, str(tmp_path / "out"), 2, header=True).count() == 2
    two = spark.createDataFrame([(1, "a"), (1, "b")], "id int, class string")
    with pytest.raises(ValueError):
        tables.with_class(df.withColumn("id", F.lit(1)), two, "id", "class")
    made = tables.clusters(spark, 50, 3, 2)
    assert made.count() == 150 and made.columns == ["row_id", "f1", "f2", "label"]
    values, _ = np.linalg.eigh(tables.covariance([1.0, 4.0], 3))
    assert values == pytest.approx([1.0, 4.0])


def test_scaling_drops_constant_features(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, 5.0)], "a double, b double")
    out, kept = prep.scaled(df, ["a", "b"])
    assert kept == ["a"] and sorted(r.a for r in out.collect()) == [0.0, 0.5, 1.0]
    assert {r.f: r.gap for r in prep.min_gaps(df, ["a", "b"]).collect()} == {1: 1.0, 2: 1e-10}


def test_gaps_over_buckets(spark):
    r = np.random.default_rng(6)
    x = np.stack([np.where(r.random(3000) < 0.6, 0.0, r.random(3000)), r.integers(-40, 40, 3000).astype(float)], 1)
    rows = [(float(a), float(b), None) for a, b in x] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    want = {i + 1: np.diff(np.unique(x[:, i])).min() for i in (0, 1)}
    for parts in (1, 7, 256):
        assert {g.f: g.gap for g in prep.min_gaps(df, ["a", "b", "c"], parts).collect()} == want
    assert prep.min_gaps(df.limit(0), ["a", "b"]).count() == 0


def test_stream_scoring(spark, tmp_path, toy):
    toy.withColumn("ts", F.timestamp_seconds(F.col("row_id") * 600)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, f1 double, f2 double, y int, ts timestamp").parquet(str(tmp_path / "in"))
    t = Tree(1, {1: (1, 0.5)}, {2: 1, 3: 3})
    for made, name in ((scoring.scored(stream, t, ["f1", "f2"]), "rows"), (scoring.windowed_accuracy(stream, t, ["f1", "f2"], "ts"), "windows")):
        query = made.writeStream.format("memory").queryName(name).outputMode("append" if name == "rows" else "update").start()
        query.processAllAvailable()
        query.stop()
    want = tree.predict(toy, t, ["f1", "f2"])
    assert sorted((r.row_id, r.pred) for r in spark.table("rows").collect()) == sorted((r.row_id, r.pred) for r in want.collect())
    assert sum(r.n for r in spark.table("windows").collect()) == 13


def test_costs_of_many_trees(spark):
    df = prep.cells(catalog.points(spark, SMALL), catalog.FEATURES)
    trees = [*catalog.CANDIDATES, Tree(1), Tree(3, {1: (1, 0.4), 3: (2, 0.5), 7: (3, 0.5)}, {11: 1, 13: 2, 15: 3})]
    want = [r.cost for r in tree.score(df, trees, catalog.FEATURES, 0.34, 0.05, F.col("n")).orderBy("tree_id").collect()]
    assert tree.costs(df, trees, catalog.FEATURES, 0.34, 0.05, "n") == want
    assert tree.costs(df.limit(0), trees[:1], catalog.FEATURES, 0.34, 0.05, "n") == [0.05 * len(trees[0].split)]


def test_last_splits_of_many_subsets():
    random = np.random.default_rng(5)
    for least in (0, 3):
        x, y = random.integers(0, 9, (14, 2)) / 10, random.integers(1, 4, 14)
        solver = exact.Solver(x, y, np.ones(14), box.free(1, 2, 3), 0.4, 0.05, np.array([0.05, 0.05]), least)
        inside = random.random((40, 14)) < 0.5
        inside[0], inside[1] = False, True
        found = solver._last(1, np.arange(14), inside)
        assert np.allclose(found, [solver.solve(1, np.flatnonzero(i))[0] for i in inside])


def test_depth2_is_independent_of_batches(monkeypatch):
    random = np.random.default_rng(6)
    x, y = random.random((25, 2)), random.integers(1, 4, 25)
    whole = exact.fit(x, y)
    monkeypatch.setattr(exact, "BATCH", 200)
    assert exact.fit(x, y) == whole


def test_large_groups_of_depth_2():
    """A group of 8,000 values of one feature: its pairs of cuts on that feature are not tried one by one."""
    r = np.random.default_rng(3)
    x, y = np.column_stack([r.permutation(8000) / 7999, r.integers(0, 25, 8000) / 24]), r.choice([1, 3, 4, 5], 8000)
    y[(x[:, 0] > 0.3) & (x[:, 0] < 0.7)] = 2
    began = time.monotonic()
    cost, found = exact.fit(x, y, share=0.4)
    assert time.monotonic() - began < 15
    assert cost == pytest.approx(errors(found, x, y) / 0.4 + 0.05 * len(found.split))
    assert all(min(abs(b - c) for f, b in found.split.values() if f == 1) < 0.01 for c in (0.3, 0.7))


def test_groups_at_once_are_as_one_by_one():
    r = np.random.default_rng(8)
    for depth in (1, 2, 3):
        x, y, at = r.integers(0, 6, (60, 2)) / 5, r.integers(1, 4, 60), r.integers(0, 7, 60)
        at[:7] = np.arange(7)
        for b in (box.free(depth, 2, 3), box.branch(box.free(depth, 2, 3), "b", 1)[1], box.branch(box.free(depth, 2, 3), "d", 1)[1]):
            values, trees = exact.solve_groups(x, y, at, b, 0.4, 0.01, exact.gaps(x))
            for g in range(7):
                mine, n = at == g, int((at == g).sum())
                assert b.holds(trees[g])
                assert values[g] == pytest.approx(errors(trees[g], x[mine], y[mine]) / 0.4 + 0.01 * n * len(trees[g].split))
                if depth == 2:
                    cells = x[mine]
                    assert values[g] == pytest.approx(every_tree(cells, y[mine], b, exact.gaps(x), 0.4, 0.01 * n))


def test_many_trees_are_counted():
    """Against routing each row through each tree; nulls go left, as do rows a slack below a threshold."""
    r = np.random.default_rng(9)
    for m in (0, 1, 500):
        x = [np.where(r.random(m) < 0.1, np.nan, r.integers(0, 9, m) / 8) for _ in range(3)]
        y, n = r.integers(1, 5, m), r.integers(1, 9, m)
        trees = [Tree(2, {s: (int(r.integers(1, 4)), float(r.choice([r.random(), r.integers(9) / 8]))) for s in (1, 2, 3) if r.random() < 0.7}, {s: int(r.integers(1, 6)) for s in (4, 5, 6, 7) if r.random() < 0.8}) for _ in range(100)]
        assert tree.right_weights(trees, x, y, n).tolist() == [int(n[tree.labels_on(t, x) == y].sum()) if m else 0 for t in trees]
    x, y, n = [r.random(200_000) for _ in range(2)], r.integers(1, 7, 200_000), np.ones(200_000, int)
    trees = [Tree(2, {1: (1, float(a)), 2: (2, float(b)), 3: (2, float(c))}, {4: 1, 5: 2, 6: 3, 7: 4}) for a, b, c in r.random((5000, 3))]
    began = time.monotonic()
    found = tree.right_weights(trees, x, y, n)
    assert time.monotonic() - began < 30 and [int((tree.labels_on(t, x) == y).sum()) for t in trees[:5]] == found[:5].tolist()


def test_costs_of_more_trees_than_are_tried(spark):
    df = prep.cells(catalog.points(spark, SMALL), catalog.FEATURES)
    trees = catalog.CANDIDATES * tree.MANY
    few = tree.costs(df, catalog.CANDIDATES, catalog.FEATURES, 0.34, 0.05, "n")
    assert tree.costs(df, trees, catalog.FEATURES, 0.34, 0.05, "n") == few * tree.MANY
    assert tree.costs(df.limit(0), trees[:70], catalog.FEATURES, 0.34, 0.05, "n")[:1] == [0.05 * len(trees[0].split)]


def test_clusters_by_blocks(spark):
    """Many clusters in a large leaf: about as many as asked, as near to their points as those of Spark's k-means."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.random((2500, 2)), 0.5 + 0.05 * r.normal(size=(2500, 2))]).clip(0, 1)
    df = spark.createDataFrame([(i, float(a), float(b), 2) for i, (a, b) in enumerate(x)], "row_id long, f1 double, f2 double, _leaf int").repartition(5)

    def spread(found, name):
        at = np.unique([r[name] for r in found], return_inverse=True)[1]
        v = np.array([(r.f1, r.f2) for r in found])
        centre = np.stack([np.bincount(at, v[:, j]) / np.bincount(at) for j in (0, 1)], 1)
        return ((v - centre[at]) ** 2).sum(), at.max() + 1

    found = groups.leaf_clusters(df, ["f1", "f2"], 25, 2, 123).collect()
    assert len({r._top for r in found}) > 2 and len(found) == 5000
    cost, k = spread(found, "_part")
    assert 190 <= k <= 205
    assert cost < 1.1 * spread(groups.clustered(df, ["f1", "f2"], 200, 2).collect(), "_cluster")[0], cost
    assert sorted(groups.leaf_clusters(df.repartition(3), ["f1", "f2"], 25, 2, 123).collect()) == sorted(found)


def test_large_leaves_are_dealt_in_time(spark):
    """Clusters grow with a leaf's rows: 8,571 here."""
    rows = spark.range(60_000).select(F.col("id").alias("row_id"), *[(F.pmod(F.xxhash64(F.floor(F.col("id") / 2), F.lit(j)), F.lit(9973)) / 9973).alias(f"f{j}") for j in (1, 2)], F.lit(1).alias("y"))
    began = time.monotonic()
    dealt = groups.leaf_deal(rows, Tree(1), ["f1", "f2"], "row_id", 7, trials=2)
    sizes = [r["count"] for r in dealt.groupBy("group_id").count().collect()]
    assert time.monotonic() - began < 60 and sum(sizes) == 60_000 and len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_points_that_are_few_or_alike():
    one = np.full((9, 2), 0.5)
    assert groups.near_means(one[:3], np.ones(3), 3, 2, 1).tolist() == [0, 1, 2]
    x = np.repeat([[0.0, 0.0], [0.9, 0.1], [1.0, 0.1]], [5, 1, 1], axis=0)
    at = groups.near_means(x, np.ones(7), 2, 3, 1)
    assert len(set(at[:5])) == 1 and at[5] == at[6] != at[0]
    with pytest.raises(ValueError):
        groups.near_means(np.array([[0.1], [np.nan], [0.2]]), np.ones(3), 2, 1, 1)
