"""Registered tree queries over the driver's tables, each with a SQL twin where SQL can express it."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.functions import prep
from timberline.operators import bounds, groups, tree
from timberline.operators.box import Box, branch, feasible_in, free, widest_threshold
from timberline.operators.optimal import Optimal, classified
from timberline.operators.pull import tuned
from timberline.operators.scan import Layout, anywhere, class_stats, square_stats
from timberline.operators.tree import Tree
from timberline.sources import tables
from timberline.streaming import scoring

FEATURES = ["f1", "f2", "f3"]
ALPHA = 0.05
#: Splits at the root and its left child; the right child sends all rows to the right-most leaf; leaf 6 has no label.
DEMO = Tree(2, {1: (1, 0.5), 2: (2, 0.3)}, {4: 1, 5: 2, 7: 3})
TWO = Tree(2, {1: (1, 0.5), 2: (2, 0.3)}, {4: 1, 5: 2, 7: 3})
OTHER = Tree(2, {1: (2, 0.5), 2: (1, 0.25), 3: (3, 0.4)}, {4: 3, 5: 1, 6: 2, 7: 1})
CANDIDATES = [DEMO, OTHER, Tree(2, {}, {7: 2}), Tree(2, {1: (3, 0.5), 3: (1, 0.75)}, {5: 1, 6: 2, 7: 3})]
BOX = Box(
    2,
    {1: frozenset({1}), 2: frozenset({1, 2, 3}), 3: frozenset({1, 2, 3})},
    {1: (0.25, 0.75), 2: (0.0, 1.0), 3: (0.0, 1.0)},
    {1: (1, 1), 2: (1, 1), 3: (1, 1)},
    {4: frozenset({1}), 5: frozenset({1, 2, 3}), 6: frozenset({1, 2, 3}), 7: frozenset({1, 2, 3})},
)
#: A box over ``part`` whose thresholds leave rows that can reach some leaves only.
PART_FEATURES = ["f1", "f2"]
PART_BOX = Box(
    2,
    {1: frozenset({1}), 2: frozenset({1, 2}), 3: frozenset({1, 2})},
    {1: (0.25, 0.75), 2: (0.2, 0.6), 3: (0.4, 0.8)},
    {1: (1, 1), 2: (1, 1), 3: (1, 1)},
    {4: frozenset({1}), 5: frozenset(range(1, 7)), 6: frozenset({2, 3}), 7: frozenset(range(1, 7))},
)
#: Boxes for the feasibility query: id, node, feature, range. The second lies between two neighbouring values of f3.
RANGES = [(1, 1, 1, 0.25, 0.75), (1, 2, 3, 0.0, 1.0), (2, 1, 1, 0.0, 1.0), (2, 3, 3, 0.13, 0.24), (3, 1, 3, 0.13, 0.24), (3, 1, 2, 0.45, 0.55)]
#: A branching: kind of variable, where, and the half that it goes on with.
STEPS = [("d", 2, 1), ("b", 1, 1), ("a", (2, 1), 0), ("a", (3, 2), 1), ("c", (1, 15), 1), ("b", 2, 0), ("d", 5, 0), ("b", 1, 0), ("c", (3, 9), 0), ("d", 3, 0)]
#: A tree within ``BOX``.
INSIDE = Tree(2, {1: (1, 0.5), 2: (2, 0.3), 3: (3, 0.6)}, {4: 1, 5: 2, 6: 3, 7: 1})
MODULUS = 104729
N_GROUPS, N_BOOTSTRAP = 7, 6
#: Groups of ``group_bound_depth2``, for tables of any size: each is solved exactly, so larger tables have larger groups.
N_EXACT = 25


def points(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """``lineitem`` as labelled points: keys, three features scaled to [0, 1], and the return flag's code."""
    rows = tables.parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"), "l_returnflag", *more)
    return prep.scaled(prep.encode(rows, "l_returnflag"), FEATURES)[0].drop("l_returnflag")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` by features of few values: line number, discount and tax, scaled, and the return flag's code."""
    rows = tables.parquet(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("f1"), F.col("l_discount").alias("f2"), F.col("l_tax").alias("f3"), "l_returnflag")
    return prep.scaled(prep.encode(rows, "l_returnflag"), FEATURES)[0].drop("l_returnflag")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` by its extended price, scaled, and the return flag's code."""
    rows = tables.parquet(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("f1"), "l_returnflag")
    return prep.scaled(prep.encode(rows, "l_returnflag"), ["f1"])[0].drop("l_returnflag")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as labelled points: size and price scaled, and the type's code."""
    rows = tables.parquet(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("f1"), F.col("p_retailprice").alias("f2"), "p_type")
    return prep.scaled(prep.encode(rows, "p_type"), PART_FEATURES)[0].drop("p_type")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.parquet(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("f1"), F.col("c_nationkey").cast("double").alias("f2"), "c_mktsegment")
    return prep.scaled(prep.encode(rows, "c_mktsegment"), PART_FEATURES)[0].drop("c_mktsegment")


def _share(df: DataFrame) -> float:
    return prep.majority_share(df, "y").first()["share"]


POINTS = """
r AS (SELECT min(l_quantity) a1, max(l_quantity) b1, min(l_discount) a2, max(l_discount) b2, min(l_tax) a3, max(l_tax) b3 FROM lineitem),
k AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag)::INTEGER AS y FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
p AS (SELECT l_orderkey, l_linenumber, (l_quantity - a1) / (b1 - a1) AS f1, (l_discount - a2) / (b2 - a2) AS f2, (l_tax - a3) / (b3 - a3) AS f3, y
      FROM lineitem JOIN k USING (l_returnflag), r)"""
PARTS = """
r AS (SELECT min(p_size)::DOUBLE a1, max(p_size)::DOUBLE b1, min(p_retailprice) a2, max(p_retailprice) b2 FROM part),
k AS (SELECT p_type, row_number() OVER (ORDER BY p_type)::INTEGER AS y FROM (SELECT DISTINCT p_type FROM part)),
p AS (SELECT p_partkey, (p_size::DOUBLE - a1) / (b1 - a1) AS f1, (p_retailprice - a2) / (b2 - a2) AS f2, y FROM part JOIN k USING (p_type), r)"""
CUSTOMERS = """
r AS (SELECT min(c_acctbal) a1, max(c_acctbal) b1, min(c_nationkey)::DOUBLE a2, max(c_nationkey)::DOUBLE b2 FROM customer),
k AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment)::INTEGER AS y FROM (SELECT DISTINCT c_mktsegment FROM customer)),
p AS (SELECT c_custkey, (c_acctbal - a1) / (b1 - a1) AS f1, (c_nationkey::DOUBLE - a2) / (b2 - a2) AS f2, y FROM customer JOIN k USING (c_mktsegment), r)"""
SHARE = "(SELECT max(n)::DOUBLE / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM p GROUP BY y))"


def sql_leaf(t: Tree, node: int = 1) -> str:
    if node in t.leaves:
        return str(node)
    if node not in t.split:
        return sql_leaf(t, 2 * node + 1)
    f, b = t.split[node]
    return f"CASE WHEN f{f} + 1e-12 >= {b}::DOUBLE THEN {sql_leaf(t, 2 * node + 1)} ELSE {sql_leaf(t, 2 * node)} END"


def sql_label(t: Tree) -> str:
    return f"CASE {sql_leaf(t)} " + " ".join(f"WHEN {leaf} THEN {k}" for leaf, k in t.label.items()) + " ELSE 0 END"


def sql_scores(trees: list[Tree]) -> str:
    """One row for each tree over ``p``: errors, splits, cost, accuracy."""
    each = " UNION ALL ".join(f"SELECT {i}::INTEGER AS tree_id, sum(CASE WHEN ({sql_label(t)}) = y THEN 0 ELSE 1 END)::BIGINT AS errors, {len(t.split)}::INTEGER AS splits, count(*) AS n FROM p" for i, t in enumerate(trees))
    return f"SELECT tree_id, errors, splits, round(errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * splits, 6) AS cost, round(1 - errors::DOUBLE / n, 6) AS accuracy FROM ({each})"


def sql_reach(box: Box) -> str:
    """The reachable leaves of a row of ``p`` as comma-joined text."""
    ways: dict[int, str] = {}

    def walk(t: int, come: str) -> None:
        if t >= 2**box.depth:
            ways[t] = come
            return
        lo, hi = box.threshold[t]
        fs = sorted(box.features[t])
        walk(2 * t, f"{come} AND NOT ({' AND '.join(f'f{f} >= {hi}::DOUBLE' for f in fs)})")
        walk(2 * t + 1, f"{come} AND NOT ({' AND '.join(f'f{f} < {lo}::DOUBLE' for f in fs)})")

    walk(1, "true")
    return "list_filter([" + ", ".join(f"CASE WHEN {ways[t]} THEN {t} END" for t in sorted(ways)) + "], lambda x: x IS NOT NULL)"


def sql_values(box: Box) -> str:
    cases = " ".join(f"WHEN {t} THEN CASE WHEN y NOT IN ({', '.join(map(str, sorted(lab)))}) THEN 1 ELSE {0 if len(lab) == 1 else -1} END" for t, lab in sorted(box.labels.items()))
    return f"list_transform(reach, lambda t: CASE t {cases} END)"


def class_frequency(spark, sf_dir):
    both = [prep.class_frequency(tables.parquet(spark, sf_dir, t), c).select(F.lit(t).alias("tab"), "label", "n") for t, c in (("lineitem", "l_returnflag"), ("events", "event_type"))]
    return both[0].unionByName(both[1])


def majority_share(spark, sf_dir):
    return prep.majority_share(tables.parquet(spark, sf_dir, "events"), "event_type").select(F.round("share", 9).alias("share"))


def label_encode(spark, sf_dir):
    return prep.encode(tables.parquet(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "c_mktsegment", "y")


def one_hot(spark, sf_dir):
    df = prep.encode(tables.parquet(spark, sf_dir, "customer"), "c_mktsegment").withColumn("code", prep.one_hot(F.col("y"), 5))
    df = df.withColumn("decoded", prep.from_one_hot(F.col("code")))
    return df.select("c_custkey", F.concat_ws(",", F.transform("code", lambda c: c.cast("string"))).alias("code"), "decoded")


def minmax_scale(spark, sf_dir):
    return points(spark, sf_dir).select("l_orderkey", "l_linenumber", *FEATURES)


def drop_constant(spark, sf_dir):
    rows = tables.parquet(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    return prep.feature_report(rows, ["l_quantity", "l_discount", "one"])


def feature_min_gap(spark, sf_dir):
    rows = tables.parquet(spark, sf_dir, "lineitem")
    return prep.min_gaps(rows, ["l_quantity", "l_discount", "l_tax"]).select("f", F.round("gap", 9).alias("gap"))


def stratified_split(spark, sf_dir):
    rows = tables.parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(rows, "o_orderstatus", F.pmod(F.col("o_orderkey") * 7919, F.lit(MODULUS)), "o_orderkey")


def route_leaf(spark, sf_dir):
    return points(spark, sf_dir).select("l_orderkey", "l_linenumber", tree.leaf(DEMO, FEATURES).alias("leaf"))


def predict(spark, sf_dir):
    return tree.predict(points(spark, sf_dir), DEMO, FEATURES).select("l_orderkey", "l_linenumber", "y", "leaf", "pred")


def tree_cost(spark, sf_dir):
    df = points(spark, sf_dir)
    return tree.score(df, [DEMO], FEATURES, _share(df), ALPHA)


def leaf_histogram(spark, sf_dir):
    counts = tree.leaf_counts(points(spark, sf_dir), DEMO, FEATURES)
    return counts.join(tree.majority_labels(counts), "leaf").select("leaf", "y", "n", "label")


def confusion(spark, sf_dir):
    return tree.predict(points(spark, sf_dir), DEMO, FEATURES).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))


def prediction_agreement(spark, sf_dir):
    df = points(spark, sf_dir)
    a, b = (tree.label_at(t, tree.leaf(t, FEATURES)) for t in (DEMO, OTHER))
    return df.groupBy(a.alias("pred_a"), b.alias("pred_b")).agg(F.count(F.lit(1)).alias("n"))


def accuracy_report(spark, sf_dir):
    """Accuracies in percent of two trees on the train and test part, as one row."""
    df = prep.stratified_split(points(spark, sf_dir), "y", F.pmod(F.col("l_orderkey") * 7919, F.lit(MODULUS)), "l_orderkey", "l_linenumber", *FEATURES)  # the keys repeat
    cols = [F.round(100 * F.avg(F.when((F.col("split") == "test") == F.lit(test), (tree.label_at(t, tree.leaf(t, FEATURES)) == F.col("y")).cast("double"))), 3).alias(f"{part}_{name}") for name, t in (("a", DEMO), ("b", OTHER)) for part, test in (("train", False), ("test", True))]
    return df.agg(*cols)


def score_many_trees(spark, sf_dir):
    df = points(spark, sf_dir)
    found = tree.score(df, CANDIDATES, FEATURES, _share(df), ALPHA)
    return found.withColumn("best", F.col("tree_id") == F.min_by("tree_id", F.struct("cost", "tree_id")).over(Window.partitionBy()))


def prune_and_score(spark, sf_dir):
    df = points(spark, sf_dir)
    return tree.score(df, [tree.pruned(OTHER, shape) for shape in range(8)], FEATURES, _share(df), ALPHA)


def merge_trees(spark, sf_dir):
    df = points(spark, sf_dir)
    joined = tree.merged(CANDIDATES)
    joined = tree.relabelled(joined, tree.leaf_counts(df, joined, FEATURES))
    return tree.score(df, [joined], FEATURES, _share(df), ALPHA)


def _laid(df: DataFrame, features: list[str], classes: int) -> Layout:
    """The cells of labelled points, laid out for scans."""
    return Layout(*_class_args(prep.cells(df, features), features, classes), df.count())


def _class_args(rows: DataFrame, features: list[str], classes: int) -> tuple[DataFrame, list[str], list[str]]:
    found, names = class_stats(rows, classes)
    return found, features, names


def _stump(spark: SparkSession, df: DataFrame, features: list[str], classes: int) -> DataFrame:
    """The single threshold of least cost, or no split."""
    share = _share(df)
    (fact,) = _laid(df, features, classes).facts([anywhere(len(features))])
    none = float(fact.sums.sum() - fact.sums.max())
    options = [(round(none / share, 6), 0, 0, 0.0, int(none))]
    if fact.feature:
        options.append((round(fact.value / share + ALPHA, 6), 1, fact.feature, round(fact.threshold, 9), int(fact.value)))
    return spark.createDataFrame([min(options)], "cost double, splits int, f int, v double, errors long")


def best_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single threshold of least cost, or no split, from running class counts along each feature."""
    return _stump(spark, points(spark, sf_dir), FEATURES, 3)


def best_stump_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a feature with nearly as many values as rows."""
    return _stump(spark, prices(spark, sf_dir), ["f1"], 3)


def optimal_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least cost of a tree of depth 2: root cuts searched with bounds between them, each side's best split or none."""
    df = points(spark, sf_dir)
    share = _share(df)
    found = Optimal(_laid(df, FEATURES, 3), 2, share, ALPHA).fit()
    wrong = sum(int(v.sum() - v.max()) for v in found.leaves.values())
    return spark.createDataFrame([(round(found.cost, 6), wrong, len(found.split))], "cost double, errors long, splits long")


def _fitted(df: DataFrame, share: float, **limits) -> DataFrame:
    """The exact tree of depth 2, scored on all rows."""
    found = Optimal(_laid(df, FEATURES, 3), 2, share, ALPHA, **limits).fit()
    return tree.score(df, [classified(found, 2)], FEATURES, share, ALPHA).select("cost", "errors", F.col("splits").cast("long").alias("splits"))


def exact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the same optimum."""
    df = points(spark, sf_dir)
    return _fitted(df, _share(df))


def min_leaf_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tree whose splits leave a fifth of all rows, at least, on both sides."""
    df = points(spark, sf_dir)
    return _fitted(df, _share(df), least=df.count() / 5)


def shaped_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tree of a fixed shape: the root and its left child split, the right child does not."""
    df = points(spark, sf_dir)
    return _fitted(df, _share(df), shape=0b110)


def exact_tree_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tree of depth 2 where a feature has nearly as many values as rows."""
    df = parts(spark, sf_dir)
    share = _share(df)
    found = Optimal(_laid(df, PART_FEATURES, 6), 2, share, ALPHA).fit()
    return tree.score(df, [classified(found, 2)], PART_FEATURES, share, ALPHA).select("cost")


def exact_tree_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact tree of depth 3 on line number, discount and tax."""
    df = lines(spark, sf_dir)
    share = _share(df)
    found = Optimal(_laid(df, FEATURES, 3), 3, share, ALPHA).fit()
    return tree.score(df, [classified(found, 3)], FEATURES, share, ALPHA).select("cost")


def regression_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least squares of a tree of depth 2 whose leaves give the mean price, with the penalty of its splits."""
    df = points(spark, sf_dir, F.col("l_extendedprice").alias("price"))
    df, _ = prep.scaled(df, ["price"])
    each = square_stats(df, "price")
    sums = each[0].groupBy(*FEATURES).agg(*[F.sum(c).alias(c) for c in each[1]])
    found = Optimal(Layout(sums, FEATURES, each[1], df.count()), 2, 1.0, ALPHA, criterion="squares").fit()
    return spark.createDataFrame([(round(found.cost, 4), len(found.split))], "cost double, splits int")


def leaf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and errors by leaf, class and part of the split, with all their margins from one pass."""
    df = prep.stratified_split(points(spark, sf_dir), "y", F.pmod(F.col("l_orderkey") * 7919, F.lit(MODULUS)), "l_orderkey", "l_linenumber", *FEATURES)
    wrong = (F.col("pred") != F.col("y")).cast("long")
    found = tree.predict(df, DEMO, FEATURES).cube("leaf", "y", "split").agg(F.grouping_id().cast("long").alias("margin"), F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("errors"))
    return found.select("leaf", "y", "split", "margin", "n", "errors")


def box_feasible(spark, sf_dir):
    rows = prep.long_form(points(spark, sf_dir), FEATURES).distinct()
    return feasible_in(rows, spark.createDataFrame(RANGES, "box_id int, t int, f int, lo double, hi double"))


def leaf_reach(spark, sf_dir):
    found = bounds.reachability(parts(spark, sf_dir), PART_BOX, PART_FEATURES)
    return found.select("p_partkey", "y", F.concat_ws(",", F.transform("reach", lambda t: t.cast("string"))).alias("reach"), "cost", "lb")


def cf_bound(spark, sf_dir):
    df = parts(spark, sf_dir)
    return bounds.closed_form(df, PART_BOX, PART_FEATURES, _share(df), ALPHA)


def cf_bound_lineitem(spark, sf_dir):
    df = points(spark, sf_dir)
    return bounds.closed_form(df, BOX, FEATURES, _share(df), ALPHA)


def label_cover_counts(spark, sf_dir):
    found = bounds.cover_counts(parts(spark, sf_dir), PART_BOX, PART_FEATURES)
    return found.select("y", F.concat_ws(",", F.transform("reach", lambda t: t.cast("string"))).alias("reach"), "n")


def label_cover_bound(spark, sf_dir):
    df = points(spark, sf_dir)
    counts = [r.asDict() for r in bounds.cover_counts(df, BOX, FEATURES).collect()]  # at most classes times sets of leaves
    return spark.createDataFrame([(round(bounds.label_cover(counts, BOX, _share(df), ALPHA), 6),)], "bound double")


def group_deal(spark, sf_dir):
    df = customers(spark, sf_dir)
    return groups.deal(df, "y", F.pmod(F.col("c_custkey") * 7919, F.lit(MODULUS)), "c_custkey", n_groups=N_GROUPS).select("c_custkey", "y", "group_id")


def bootstrap_groups(spark, sf_dir):
    df = customers(spark, sf_dir)
    return groups.bootstrap(df, F.pmod(F.col("c_custkey") * 7919, F.lit(MODULUS)), "c_custkey", n=df.count(), n_groups=N_BOOTSTRAP, round_=3).select("group_id", "c_custkey", "y")


def _dealt(df: DataFrame, depth: int, n_groups: int = 0) -> tuple[DataFrame, int, np.ndarray]:
    """Customers dealt over groups for trees of a depth (``n_groups`` of them, if stated), their number, and the least gaps of the features."""
    eps, n = {r.f: r.gap for r in prep.min_gaps(df, PART_FEATURES).collect()}, df.count()
    dealt = groups.deal(df, "y", F.pmod(F.col("c_custkey") * 7919, F.lit(MODULUS)), "c_custkey", n_groups=n_groups or groups.group_count(n, 2, 5, depth))
    return dealt, n, np.array([eps[1], eps[2]])


def _group_bound(spark, sf_dir, depth, n_groups=0):
    df = customers(spark, sf_dir)
    dealt, n, eps = _dealt(df, depth, n_groups)
    found = bounds.group_bounds(dealt, free(depth, 2, 5), PART_FEATURES, _share(df), ALPHA, n, eps)
    return found.select("group_id", F.round("bound", 6).alias("bound"))


def multiplier_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' bound of all stumps before and after 10 rounds of multipliers, beside the exact optimum."""
    df = customers(spark, sf_dir)
    (dealt, n, eps), share = _dealt(df, 1), _share(df)
    best = Optimal(_laid(df, PART_FEATURES, 5), 1, share, ALPHA).fit().cost
    _, found = tuned(dealt, free(1, 2, 5), PART_FEATURES, share, ALPHA, n, eps, 5, best, 10)
    row = (round(found[0], 5), round(best, 6), max(found) > found[0], max(found) <= best + 1e-6)
    return spark.createDataFrame([row], "plain double, optimum double, tighter boolean, below boolean")


def group_bound(spark, sf_dir):
    return _group_bound(spark, sf_dir, 1)


def group_bound_depth2(spark, sf_dir):
    return _group_bound(spark, sf_dir, 2, N_EXACT)


def embedding_features(spark, sf_dir):
    """Two dimensions of an embedding, scaled, routed through a tree."""
    df = tables.parquet(spark, sf_dir, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("f1"), F.element_at("embedding", 2).cast("double").alias("f2"), F.lit(0.0).alias("f3"), (F.col("label") + 1).cast("int").alias("y"))
    df = prep.scaled(df, ["f1", "f2"])[0]
    return tree.predict(df, DEMO, FEATURES).select("vec_id", "y", "leaf", "pred")


def order_ranks(spark, sf_dir):
    """First-seen order and size of groups, and where each begins when they are laid out one behind the other."""
    rows = tables.parquet(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)  # over the distinct groups
    return rows.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))


def class_lookup(spark, sf_dir):
    """Rows with the class that another table gives for their id, the id dropped."""
    suppliers = tables.parquet(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    nations = tables.parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return tables.with_class(suppliers, nations, "s_nationkey", "n_name")


def cart_tree(spark, sf_dir):
    from timberline.operators.greedy import cart

    df = points(spark, sf_dir)
    return tree.score(df, [cart(df, FEATURES, 2)], FEATURES, _share(df), ALPHA)


def kmeans_groups(spark, sf_dir):
    """Rows a group, dealt by k-means cluster; whether each cluster lies evenly over the groups, and nearer to its centre
    than the rows do to four fixed ones."""
    found = groups.clustered(customers(spark, sf_dir), PART_FEATURES, 4)
    dealt = groups.deal(found, "_cluster", F.pmod(F.xxhash64("c_custkey", F.lit(123)), F.lit(104729)), "c_custkey", n_groups=N_GROUPS, carry=True)
    each = dealt.groupBy("_cluster", "group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("_cluster").agg((F.max("n") - F.when(F.count(F.lit(1)) < N_GROUPS, 0).otherwise(F.min("n"))).alias("d")).agg((F.max("d") <= 1).alias("even"))
    apart = lambda c: F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count(F.lit(1))
    own = dealt.groupBy("_cluster").agg((apart("f1") + apart("f2")).alias("cost")).agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("k")).first()
    fixed = F.least(*[(F.col("f1") - a) * (F.col("f1") - a) + (F.col("f2") - b) * (F.col("f2") - b) for a, b in product((0.25, 0.75), repeat=2)])
    near = own.cost <= dealt.agg(F.sum(fixed).alias("most")).first().most
    return dealt.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).select("group_id", "n", F.lit(each.first().even).alias("even"), F.lit(near).alias("near"), F.lit(own.k).cast("int").alias("clusters"))


def leaf_groups(spark, sf_dir):
    """Rows by group and leaf, dealt by leaf of a tree and k-means within the leaf."""
    df = customers(spark, sf_dir)
    dealt = groups.leaf_deal(df, TWO, PART_FEATURES, "c_custkey", N_GROUPS, trials=2)
    return dealt.groupBy("group_id", tree.leaf(TWO, PART_FEATURES).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


def read_delimited(spark, sf_dir):
    """A table written as delimited text and read back as points: cleaned, encoded, scaled."""
    path = tables.scratch(spark, "delimited")
    rows = tables.parquet(spark, sf_dir, "customer").select("c_acctbal", F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double"), "c_mktsegment")
    tables.write_delimited(rows, path)
    found, kept, k = tables.read_data(spark, path, 3)
    return found.select(*kept, "y", F.lit(k).alias("k"))


def branch_and_bound(spark, sf_dir):
    from timberline.operators.search import Search

    search = Search(parts(spark, sf_dir).withColumnRenamed("p_partkey", "row_id"), PART_FEATURES, 2, ALPHA)
    search.run(max_nodes=8, batch=4)
    return search.bound_log(spark)


def unreached_leaves(spark, sf_dir):
    """How many rows no tree of a box sends to some leaves, for each set of such leaves."""
    away = bounds.unreachable(bounds.reach(PART_BOX, PART_FEATURES), 2)
    return parts(spark, sf_dir).groupBy(F.concat_ws(",", F.transform(away, lambda t: t.cast("string"))).alias("unreached")).agg(F.count(F.lit(1)).alias("n"))


def branched_boxes(spark, sf_dir):
    """The box of each step of a branching, node by node, the threshold that would be branched on next, and how many rows
    of ``lineitem`` have each allowed feature within a node's thresholds."""
    box, rows = free(3, 3, 3), []
    for i, (kind, at, half) in enumerate(STEPS, 1):
        box = branch(box, kind, at)[half]
        wide = widest_threshold(box)
        joined = lambda some: ",".join(map(str, sorted(some)))
        rows += [(i, t, joined(box.features[t]), *box.threshold[t], *box.splits[t], t == wide) for t in box.splits]
        rows += [(i, t, joined(lab), None, None, None, None, False) for t, lab in box.labels.items()]
    boxes = spark.createDataFrame(rows, "step int, t int, choices string, low double, high double, split_low int, split_high int, widest boolean")
    values = prep.long_form(prep.cells(points(spark, sf_dir), FEATURES), FEATURES, "n").groupBy("f", "v").agg(F.sum("n").alias("n"))
    asked = boxes.where("low is not null and choices <> ''").select("step", "t", "low", "high", F.explode(F.split("choices", ",").cast("array<int>")).alias("f"))
    hit = values.join(F.broadcast(asked), "f").where(F.col("v").between(F.col("low"), F.col("high"))).groupBy("step", "t").agg(F.sum("n").alias("hits"))
    return boxes.join(hit, ["step", "t"], "left").withColumn("hits", F.when(F.col("low").isNotNull(), F.coalesce("hits", F.lit(0))))


def equal_trees(spark, sf_dir):
    """Which of a tree's forms, forced to shapes, are the same tree, and on how many rows two of them give other labels."""
    df = points(spark, sf_dir)
    forms, pairs = [tree.pruned(OTHER, shape) for shape in range(8)], list(product(range(8), repeat=2))
    labels = df.select(*[tree.label_at(t, tree.leaf(t, FEATURES)).alias(f"l{i}") for i, t in enumerate(forms)])
    row = labels.agg(*[F.sum((F.col(f"l{a}") != F.col(f"l{b}")).cast("long")).alias(f"d{a}{b}") for a, b in pairs]).first()
    return spark.createDataFrame([(a, b, tree.same(forms[a], forms[b]), row[f"d{a}{b}"]) for a, b in pairs], "a int, b int, same boolean, differing long")


def drop_missing(spark, sf_dir):
    """Rows of a delimited table without a missing value, one field in three of which is empty."""
    path = tables.scratch(spark, "missing")
    rows = tables.parquet(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")), F.col("c_custkey").cast("double"), "c_mktsegment")
    tables.write_delimited(rows, path)
    return tables.delimited(spark, path, 2)


def group_counts(spark, sf_dir):
    """How many groups tables of some sizes and classes are dealt over, by depth."""
    rows = []
    for name, label, p in (("lineitem", "l_returnflag", 3), ("customer", "c_mktsegment", 2), ("embeddings", "label", 64)):
        n, k = prep.class_frequency(tables.parquet(spark, sf_dir, name), label).agg(F.sum("n"), F.count(F.lit(1))).first()
        rows += [(name, depth, groups.group_count(n, p, k, depth)) for depth in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "tab string, depth int, n_groups int")


def group_blocks(spark, sf_dir):
    """Groups laid out in contiguous parts: into how many each falls, and whether its part is not before the last group's."""
    df = groups.deal(customers(spark, sf_dir), "y", F.pmod(F.col("c_custkey") * 7919, F.lit(MODULUS)), "c_custkey", n_groups=25)
    placed = groups.blocks(df, "group_id", 4).withColumn("part", F.spark_partition_id())
    each = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"), F.min("part").alias("part"))
    before = F.lag("part").over(Window.orderBy("group_id"))  # over the groups
    return each.select("group_id", "n", "parts", F.coalesce(F.col("part") >= before, F.lit(True)).alias("in_order"))


def result_row(spark, sf_dir):
    """The line of results of a tree within a box: its cost, the box's bound, the gap between them, its accuracy."""
    df = points(spark, sf_dir)
    share = _share(df)
    found = tree.score(df, [INSIDE], FEATURES, share, ALPHA).first()
    lb = bounds.closed_form(df, BOX, FEATURES, share, ALPHA).first()["bound"]
    return tables.result_line(spark, name="lineitem", objv=found.cost, lb=lb, gap=round((found.cost - lb) / lb, 6), accuracy=found.accuracy)


def covariance_spectrum(spark, sf_dir):
    """Eigenvalues of a covariance made in random directions from the variances of the features of ``lineitem``."""
    import numpy as np

    row = points(spark, sf_dir).agg(*[F.var_pop(f).alias(f) for f in FEATURES]).first()
    found = np.linalg.eigvalsh(tables.covariance([row[f] for f in FEATURES], 7))
    return spark.createDataFrame([(i, round(float(v), 9)) for i, v in enumerate(found, 1)], "i int, eigenvalue double")


def synthetic_clusters(spark, sf_dir):
    """Clusters as many as the market segments of ``customer``, with as many rows as those have on average."""
    n, k = prep.class_frequency(tables.parquet(spark, sf_dir, "customer"), "c_mktsegment").agg(F.sum("n"), F.count(F.lit(1))).first()
    return tables.clusters(spark, n // k, k).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1"), F.avg("f2").alias("f2"))


def tree_nodes(spark, sf_dir):
    """The nodes of a tree, and how many rows of ``lineitem`` come to each."""
    counts = tree.leaf_counts(points(spark, sf_dir), DEMO, FEATURES).groupBy("leaf").agg(F.sum("n").alias("n"))
    up = counts.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(DEMO.depth)), lambda k: F.call_function("shiftright", F.col("leaf"), k))).alias("t"))
    return DEMO.to_df(spark).join(up.groupBy("t").agg(F.sum("n").alias("hits")), "t", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def windowed_accuracy(spark, sf_dir):
    """Accuracy of a tree by day, as the stream operator computes it, over all events."""
    rows = tables.parquet(spark, sf_dir, "events").select("ts", F.hour("ts").cast("double").alias("f1"), "value", "event_type")
    df = prep.scaled(prep.encode(rows, "event_type").withColumnRenamed("value", "f2"), ["f1", "f2"])[0]
    found = scoring.windowed_accuracy(df, TWO, PART_FEATURES, "ts", "1 day")
    return found.select(F.col("window.start").cast("date").cast("string").alias("day"), "n", F.round("accuracy", 9).alias("accuracy"))


QUERIES = {f.__name__: f for f in (class_frequency, majority_share, label_encode, one_hot, minmax_scale, drop_constant, feature_min_gap, stratified_split, route_leaf, predict, tree_cost, leaf_histogram, confusion, prediction_agreement, accuracy_report, score_many_trees, prune_and_score, merge_trees, best_stump, best_stump_price, optimal_depth2, exact_tree, min_leaf_tree, shaped_tree, exact_tree_prices, exact_tree_depth3, regression_tree, leaf_report, box_feasible, leaf_reach, cf_bound, cf_bound_lineitem, label_cover_counts, label_cover_bound, group_deal, bootstrap_groups, group_bound, group_bound_depth2, multiplier_bound, embedding_features, order_ranks, class_lookup, cart_tree, kmeans_groups, leaf_groups, read_delimited, branch_and_bound, unreached_leaves, branched_boxes, equal_trees, drop_missing, group_counts, group_blocks, result_row, covariance_spectrum, synthetic_clusters, tree_nodes, windowed_accuracy)}

_MERGED = tree.merged(CANDIDATES)
_CLASSES = range(1, 4)


def _sql_merge() -> str:
    return f"""WITH {POINTS},
c AS (SELECT {sql_leaf(_MERGED)} AS leaf, y, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT sum(n) - sum(top) AS errors, sum(n) AS n FROM (SELECT leaf, sum(n) AS n, max(n) AS top FROM c GROUP BY leaf))
SELECT 0::INTEGER AS tree_id, errors::BIGINT AS errors, {len(_MERGED.split)}::INTEGER AS splits,
  round(errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * {len(_MERGED.split)}, 6) AS cost, round(1 - errors::DOUBLE / n::DOUBLE, 6) AS accuracy FROM m"""


_LONG = "l AS (SELECT 1 AS f, f1 AS v, * FROM c UNION ALL SELECT 2, f2, * FROM c UNION ALL SELECT 3, f3, * FROM c)"
_STUMP = f"""WITH {POINTS}, c AS (SELECT f1, f2, f3, y, count(*) AS n FROM p GROUP BY ALL), {_LONG},
g AS (SELECT f, v, {', '.join(f'sum(n) FILTER (y = {k}) AS n{k}' for k in _CLASSES)} FROM l GROUP BY f, v),
w AS (SELECT f, v, {', '.join(f'sum(coalesce(n{k}, 0)) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a{k}, sum(coalesce(n{k}, 0)) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{k}' for k in _CLASSES)} FROM g),
o AS (SELECT f, v, a1 + a2 + a3 - greatest(a1, a2, a3) + b1 + b2 + b3 - greatest(b1, b2, b3) AS errors, 1 AS splits FROM w WHERE a1 IS NOT NULL
      UNION ALL SELECT 0, 0, sum(n) - max(n), 0 FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round(errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * splits, 6) AS cost, splits::INTEGER AS splits, f::INTEGER AS f, round(v::DOUBLE, 9) AS v, errors::BIGINT AS errors
FROM o ORDER BY 1, 2, 3, v LIMIT 1"""


def _depth2(allowed: str = "true", splits: str = "(a1 + a2 + a3 > 0)::INTEGER", root: str = "true", stop: str = "true") -> str:
    """The best tree of depth 2; which splits of a side and of the root count, and whether the root may stop."""
    return f"""WITH {POINTS}, c AS (SELECT f1, f2, f3, y, count(*) AS n FROM p GROUP BY ALL), {_LONG},
q AS (SELECT DISTINCT f AS rf, v AS rv FROM l), t AS (SELECT * FROM q WHERE rv > (SELECT min(rv) FROM q q2 WHERE q2.rf = q.rf)),
s AS (SELECT rf, rv, (CASE rf WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END >= rv)::INTEGER AS side, f, v,
        {', '.join(f'sum(n) FILTER (y = {k}) AS n{k}' for k in _CLASSES)} FROM l, t GROUP BY ALL),
w AS (SELECT rf, rv, side, {', '.join(f'coalesce(sum(coalesce(n{k}, 0)) OVER (PARTITION BY rf, rv, side, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a{k}, sum(coalesce(n{k}, 0)) OVER (PARTITION BY rf, rv, side, f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{k}' for k in _CLASSES)} FROM s),
z AS (SELECT sum(n)::DOUBLE AS total FROM c),
o AS (SELECT rf, rv, side, a1 + a2 + a3 - greatest(a1, a2, a3) + b1 + b2 + b3 - greatest(b1, b2, b3) AS errors, {splits} AS splits, a1 + a2 + a3 + b1 + b2 + b3 AS m FROM w, z WHERE {allowed}),
b AS (SELECT rf, rv, side, errors, splits, m, row_number() OVER (PARTITION BY rf, rv, side ORDER BY errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * splits, errors) AS i FROM o),
d AS (SELECT sum(errors) AS errors, sum(splits) + 1 AS splits FROM b, z WHERE i = 1 GROUP BY rf, rv HAVING {root}
      UNION ALL SELECT sum(n) - max(n), 0 FROM (SELECT sum(n) AS n FROM c GROUP BY y) HAVING {stop})
SELECT round(errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * splits, 6) AS cost, errors::BIGINT AS errors, splits::BIGINT AS splits FROM d ORDER BY 1, 2 LIMIT 1"""


LINES = """
r AS (SELECT min(l_linenumber)::DOUBLE a1, max(l_linenumber)::DOUBLE b1, min(l_discount) a2, max(l_discount) b2, min(l_tax) a3, max(l_tax) b3 FROM lineitem),
k AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag)::INTEGER AS y FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
p AS (SELECT (l_linenumber::DOUBLE - a1) / (b1 - a1) AS f1, (l_discount - a2) / (b2 - a2) AS f2, (l_tax - a3) / (b3 - a3) AS f3, y FROM lineitem JOIN k USING (l_returnflag), r)"""
PRICES = """
r AS (SELECT min(l_extendedprice) a1, max(l_extendedprice) b1 FROM lineitem),
k AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag)::INTEGER AS y FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
p AS (SELECT (l_extendedprice - a1) / (b1 - a1) AS f1, y FROM lineitem JOIN k USING (l_returnflag), r)"""


def _sql_stump(rows: str, p: int, classes: int) -> str:
    """The best single threshold of ``p`` features, or no split, from running counts."""
    ks = range(1, classes + 1)
    run = ", ".join(f"sum(n{k}) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a{k}, sum(n{k}) OVER (PARTITION BY f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{k}" for k in ks)
    wrong = " + ".join(f"{' + '.join(f'{s}{k}' for k in ks)} - greatest({', '.join(f'{s}{k}' for k in ks)})" for s in "ab")
    return f"""WITH {rows}, l AS ({" UNION ALL ".join(f"SELECT {j} AS f, f{j} AS v, y FROM p" for j in range(1, p + 1))}),
g AS (SELECT f, v, {", ".join(f"count(*) FILTER (y = {k}) AS n{k}" for k in ks)} FROM l GROUP BY f, v), w AS (SELECT f, v, {run} FROM g),
o AS (SELECT f, v, {wrong} AS errors, 1 AS splits FROM w WHERE a1 IS NOT NULL UNION ALL SELECT 0, 0, sum(n) - max(n), 0 FROM (SELECT count(*) AS n FROM p GROUP BY y))
SELECT round(errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * splits, 6) AS cost, splits::INTEGER AS splits, f::INTEGER AS f, round(v::DOUBLE, 9) AS v, errors::BIGINT AS errors FROM o ORDER BY 1, 2, 3, v LIMIT 1"""


def _sql_optimal(rows: str, p: int, classes: int, depth: int) -> str:
    """The least cost of a tree of depth 2 or 3 over the cells: all cuts at all nodes, the last ones by running counts."""
    ks, fs = range(1, classes + 1), range(1, p + 1)
    value = lambda f, v: f"(CASE {f} {' '.join(f'WHEN {j} THEN f{j}' for j in fs)} END >= {v})::INTEGER"
    node = ["rf", "rv", "s1", *(["sf", "sv", "s2"] if depth == 3 else [])]
    run = lambda k: f"coalesce(sum(n{k}) OVER (PARTITION BY {', '.join(node)}, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a{k}, sum(n{k}) OVER (PARTITION BY {', '.join(node)}, f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{k}"
    total = lambda s: "(" + " + ".join(f"{s}{k}" for k in ks) + ")"
    wrong = " + ".join(f"{total(s)} - greatest({', '.join(f'{s}{k}' for k in ks)})" for s in "ab")
    upper = f"e AS (SELECT rf, rv, s1, min(cost) AS cost FROM o GROUP BY ALL)," if depth == 2 else f"""u AS (SELECT rf, rv, s1, sum(cost) + {ALPHA}::DOUBLE AS cost FROM (SELECT rf, rv, s1, sf, sv, s2, min(cost) AS cost FROM o GROUP BY ALL) GROUP BY rf, rv, s1, sf, sv),
d AS (SELECT rf, rv, s1, (sum(n) - max(n))::DOUBLE / {SHARE} AS cost FROM (SELECT rf, rv, {value("rf", "rv")} AS s1, y, sum(n) AS n FROM c, t GROUP BY ALL) GROUP BY rf, rv, s1),
e AS (SELECT rf, rv, s1, min(cost) AS cost FROM (SELECT * FROM u UNION ALL SELECT * FROM d) GROUP BY ALL),"""
    second = f", t2.rf AS sf, t2.rv AS sv, {value('t2.rf', 't2.rv')} AS s2" if depth == 3 else ""
    return f"""WITH {rows}, c AS (SELECT {", ".join(f"f{j}" for j in fs)}, y, count(*) AS n FROM p GROUP BY ALL),
l AS ({" UNION ALL ".join(f"SELECT {j} AS f, f{j} AS v, * FROM c" for j in fs)}),
t AS (SELECT DISTINCT f AS rf, v AS rv FROM l WHERE v > (SELECT min(v) FROM l m WHERE m.f = l.f)),
s AS (SELECT t.rf, t.rv, {value("t.rf", "t.rv")} AS s1{second}, f, v, {", ".join(f"coalesce(sum(n) FILTER (y = {k}), 0) AS n{k}" for k in ks)} FROM l, t{", t t2" if depth == 3 else ""} GROUP BY ALL),
w AS (SELECT {", ".join(node)}, {", ".join(map(run, ks))} FROM s),
o AS (SELECT {", ".join(node)}, ({wrong})::DOUBLE / {SHARE} + CASE WHEN {total("a")} > 0 THEN {ALPHA}::DOUBLE ELSE 0 END AS cost FROM w),
{upper}
z AS (SELECT sum(cost) + {ALPHA}::DOUBLE AS cost FROM e GROUP BY rf, rv UNION ALL SELECT (sum(n) - max(n))::DOUBLE / {SHARE} FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT round(min(cost), 6) AS cost FROM z"""


def _sql_regression() -> str:
    """The least squares of a tree of depth 2, by all root cuts and running sums on both sides."""
    rows = POINTS.replace("SELECT l_orderkey, l_linenumber,", "SELECT (l_extendedprice - a4) / (b4 - a4) AS price,").replace("max(l_tax) b3", "max(l_tax) b3, min(l_extendedprice) a4, max(l_extendedprice) b4")
    run = ", ".join(f"coalesce(sum({c}) OVER (PARTITION BY rf, rv, side, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a{c}, sum({c}) OVER (PARTITION BY rf, rv, side, f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{c}" for c in ("w", "y", "z"))
    return f"""WITH {rows}, c AS (SELECT f1, f2, f3, count(*) AS w, sum(price) AS y, sum(price * price) AS z FROM p GROUP BY ALL), {_LONG},
t AS (SELECT DISTINCT f AS rf, v AS rv FROM l WHERE v > (SELECT min(v) FROM l m WHERE m.f = l.f)),
s AS (SELECT rf, rv, (CASE rf WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END >= rv) AS side, f, v, sum(w) AS w, sum(y) AS y, sum(z) AS z FROM l, t GROUP BY ALL),
r2 AS (SELECT rf, rv, side, {run} FROM s),
o AS (SELECT rf, rv, side, CASE WHEN aw > 0 THEN az - ay * ay / aw ELSE 0 END + bz - by_ * by_ / bw + CASE WHEN aw > 0 THEN {ALPHA}::DOUBLE ELSE 0 END AS cost, (aw > 0)::INTEGER AS splits FROM (SELECT *, "by" AS by_ FROM r2)),
b AS (SELECT rf, rv, side, min(cost) AS cost, min_by(splits, cost) AS splits FROM o GROUP BY ALL),
d AS (SELECT sum(cost) + {ALPHA}::DOUBLE AS cost, sum(splits) + 1 AS splits FROM b GROUP BY rf, rv UNION ALL SELECT sum(z) - sum(y) * sum(y) / sum(w), 0 FROM c)
SELECT round(min(cost), 4) AS cost, min_by(splits, cost)::INTEGER AS splits FROM d"""


_REACH = f"{PARTS}, q AS (SELECT p_partkey, y, {sql_reach(PART_BOX)} AS reach FROM p), v AS (SELECT *, {sql_values(PART_BOX)} AS vals FROM q), z AS (SELECT *, CASE WHEN list_min(vals) = list_max(vals) AND list_min(vals) >= 0 THEN list_min(vals) ELSE -1 END AS cost, CASE WHEN list_min(vals) = 1 THEN 1 ELSE 0 END AS lb FROM v)"
_REACH_L = f"{POINTS}, q AS (SELECT y, {sql_reach(BOX)} AS reach FROM p), v AS (SELECT *, {sql_values(BOX)} AS vals FROM q), z AS (SELECT *, CASE WHEN list_min(vals) = list_max(vals) AND list_min(vals) >= 0 THEN list_min(vals) ELSE -1 END AS cost, CASE WHEN list_min(vals) = 1 THEN 1 ELSE 0 END AS lb FROM v)"
_COVER = " UNION ALL ".join(f"SELECT {', '.join(f'{k} AS c{t}' for t, k in zip(sorted(BOX.labels), labels, strict=True))}" for labels in product(*[sorted(BOX.labels[t]) for t in sorted(BOX.labels)]))


def _closed(table: str, box: Box) -> str:
    return f"SELECT coalesce(sum((cost = -1)::INTEGER), 0)::BIGINT AS undetermined, coalesce(sum(lb), 0)::BIGINT AS determined_errors, round(coalesce(sum(lb), 0)::DOUBLE / {SHARE} + {ALPHA * box.least_splits}::DOUBLE, 6) AS bound FROM {table}"


_DEAL = f"(row_number() OVER (PARTITION BY y ORDER BY (c_custkey * 7919) % {MODULUS}, c_custkey) - 1)"


def _sql_groups(depth: int) -> str:
    """How many groups the customers are dealt over, for two features and five classes."""
    return f"(SELECT CASE WHEN count(*) < 50 THEN 2 ELSE greatest(1, round_even(count(*) / ({(152 + 2) / 2**depth - (2 + 2 + 5)}::DOUBLE), 0)) END::BIGINT FROM p)"


_DEALT1 = f"SELECT *, {_DEAL} % {_sql_groups(1)} AS group_id FROM p"
_GROUP_STUMPS = f"""t AS (SELECT count(*) AS total FROM p),
l AS (SELECT group_id, y, 1 AS f, f1 AS v FROM g UNION ALL SELECT group_id, y, 2, f2 FROM g),
h AS (SELECT group_id, f, v, y, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT DISTINCT group_id, f, v AS cut FROM h),
o AS (SELECT s.group_id, s.f, s.cut, h.y, sum(CASE WHEN h.v < s.cut THEN n ELSE 0 END) AS a, sum(CASE WHEN h.v < s.cut THEN 0 ELSE n END) AS b
      FROM s JOIN h ON s.group_id = h.group_id AND s.f = h.f GROUP BY ALL),
e AS (SELECT group_id, sum(a) - max(a) + sum(b) - max(b) AS errors, (sum(a) > 0) AS cut, sum(a) + sum(b) AS m FROM o GROUP BY group_id, f, o.cut),
best AS (SELECT group_id, min(errors::DOUBLE / {SHARE} + CASE WHEN cut THEN {ALPHA}::DOUBLE * m::DOUBLE / total ELSE 0 END) AS bound FROM e, t GROUP BY group_id)"""
_GROUP1 = f"WITH {CUSTOMERS}, g AS ({_DEALT1}), {_GROUP_STUMPS} SELECT group_id::BIGINT AS group_id, round(bound, 6) AS bound FROM best"
#: All rows as one group have the best stump of all.
_MULTIPLIER = f"""WITH {CUSTOMERS}, g AS ({_DEALT1} UNION ALL SELECT *, -1 FROM p), {_GROUP_STUMPS}
SELECT round(sum(bound) FILTER (group_id >= 0), 5) AS plain, round(sum(bound) FILTER (group_id < 0), 6) AS optimum, true AS tighter, true AS below FROM best"""


def _sql_group2() -> str:
    """Of each group the best tree of depth 2: every root cut with the best cut, or none, of each side; or no split."""
    ks = range(1, 6)
    run = ", ".join(f"coalesce(sum(n{k}) OVER (PARTITION BY group_id, rf, rv, side, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a{k}, sum(n{k}) OVER (PARTITION BY group_id, rf, rv, side, f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{k}" for k in ks)
    side = lambda s: f"({' + '.join(f'{s}{k}' for k in ks)})"
    wrong = " + ".join(f"{side(s)} - greatest({', '.join(f'{s}{k}' for k in ks)})" for s in "ab")
    return f"""WITH {CUSTOMERS}, g AS (SELECT *, {_DEAL} % {N_EXACT} AS group_id FROM p),
m AS (SELECT group_id, {ALPHA}::DOUBLE * count(*)::DOUBLE / (SELECT count(*) FROM p) AS pen FROM g GROUP BY group_id),
l AS (SELECT group_id, y, f1, f2, 1 AS f, f1 AS v FROM g UNION ALL SELECT group_id, y, f1, f2, 2, f2 FROM g),
q AS (SELECT DISTINCT group_id, f AS rf, v AS rv FROM l),
s AS (SELECT group_id, rf, rv, (CASE rf WHEN 1 THEN f1 ELSE f2 END >= rv) AS side, f, v, {", ".join(f"count(*) FILTER (y = {k}) AS n{k}" for k in ks)} FROM q JOIN l USING (group_id) GROUP BY ALL),
w AS (SELECT group_id, rf, rv, side, {run} FROM s),
o AS (SELECT group_id, rf, rv, side, min(({wrong})::DOUBLE / {SHARE} + CASE WHEN {side("a")} > 0 THEN pen ELSE 0 END) AS cost FROM w JOIN m USING (group_id) GROUP BY ALL),
d AS (SELECT group_id, sum(cost) + any_value(pen) AS cost FROM o JOIN m USING (group_id) GROUP BY group_id, rf, rv
      UNION ALL SELECT group_id, (sum(n) - max(n))::DOUBLE / {SHARE} FROM (SELECT group_id, count(*) AS n FROM g GROUP BY group_id, y) GROUP BY group_id)
SELECT group_id::BIGINT AS group_id, round(min(cost), 6) AS bound FROM d GROUP BY group_id"""


def _sql_cart() -> str:
    """The greedy tree of depth 2: least entropy with a twentieth of the rows, at least, on both sides; equal leaves are one."""
    run = ", ".join(f"sum(n{k}) OVER (PARTITION BY node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a{k}, sum(n{k}) OVER (PARTITION BY node, f ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{k}" for k in _CLASSES)
    part = lambda s: " + ".join(f"CASE WHEN {s}{k} > 0 THEN {s}{k} * ln({s}{k}::DOUBLE / ({s}1 + {s}2 + {s}3)) ELSE 0 END" for k in _CLASSES)

    def pick(name: str, rows: str) -> str:
        return f"""{name}l AS (SELECT node, y, n, 1 AS f, f1 AS v FROM {rows} UNION ALL SELECT node, y, n, 2, f2 FROM {rows} UNION ALL SELECT node, y, n, 3, f3 FROM {rows}),
{name}h AS (SELECT node, f, v, {", ".join(f"coalesce(sum(n) FILTER (y = {k}), 0) AS n{k}" for k in _CLASSES)} FROM {name}l GROUP BY ALL),
{name}w AS (SELECT node, f, v, {run} FROM {name}h),
{name} AS (SELECT node, f, v FROM {name}w, z WHERE a1 + a2 + a3 >= least AND b1 + b2 + b3 >= least QUALIFY row_number() OVER (PARTITION BY node ORDER BY (-({part("a")})) + (-({part("b")})), f, v) = 1)"""

    value = "CASE f WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END >= v"
    return f"""WITH {POINTS}, c AS (SELECT f1, f2, f3, y, count(*) AS n, 1 AS node FROM p GROUP BY ALL), z AS (SELECT ceil(0.05::DOUBLE * sum(n)) AS least FROM c),
{pick("top", "c")}, i AS (SELECT f1, f2, f3, y, n, CASE WHEN {value} THEN 3 ELSE 2 END AS node FROM c JOIN top USING (node)),
{pick("next", "i")}, j AS (SELECT i.node, y, n, 2 * i.node + CASE WHEN f IS NULL OR {value} THEN 1 ELSE 0 END AS leaf FROM i LEFT JOIN next USING (node)),
e AS (SELECT node, leaf, y, sum(n) AS n FROM j GROUP BY ALL),
b AS (SELECT node, leaf, sum(n) - max(n) AS errors, sum(n) AS n, first(y ORDER BY n DESC, y) AS label FROM e GROUP BY ALL),
t AS (SELECT sum(errors) AS errors, sum(n) AS n, count(DISTINCT label) FILTER (node = 2) + count(DISTINCT label) FILTER (node = 3) - 2 + CASE WHEN count(DISTINCT label) > 1 THEN 1 ELSE 0 END AS splits FROM b)
SELECT 0::INTEGER AS tree_id, errors::BIGINT AS errors, splits::INTEGER AS splits, round(errors::DOUBLE / {SHARE} + {ALPHA}::DOUBLE * splits, 6) AS cost, round(1 - errors::DOUBLE / n::DOUBLE, 6) AS accuracy FROM t"""


_SIZES = ", ".join(f"(SELECT '{name}' AS tab, {p} AS p, count(*) AS n, count(DISTINCT {label}) AS k FROM {name})" for name, label, p in (("lineitem", "l_returnflag", 3), ("customer", "c_mktsegment", 2), ("embeddings", "label", 64))).replace("), (", ") UNION ALL (")
_GROUP_COUNTS = f"""WITH t AS ({_SIZES}), q AS (SELECT *, d AS depth, (152 + p)::DOUBLE / (1 << d) - (p + 2 + k) AS a FROM t, range(1, 5) r(d)),
s AS (SELECT *, CASE WHEN depth > 2 THEN CASE WHEN n BETWEEN 1000 AND 5000 THEN 100 ELSE 50 END WHEN a > 0 THEN a ELSE greatest(30, k) END AS size FROM q)
SELECT tab, depth::INTEGER AS depth, CASE WHEN n < 50 THEN 2 ELSE greatest(1, round_even(n / size, 0)) END::INTEGER AS n_groups FROM s"""
#: What is left of each node's choices after the steps so far, by the bits of node numbers: ``t >> k`` are the nodes above ``t``.
_BRANCHED = f"""WITH {POINTS}, g AS (SELECT f, v, count(*) AS n FROM (SELECT 1 AS f, f1 AS v FROM p UNION ALL SELECT 2, f2 FROM p UNION ALL SELECT 3, f3 FROM p) GROUP BY ALL), s(i, kind, x, t, half) AS (VALUES {", ".join(f"({i}, '{kind}', {at[0] if isinstance(at, tuple) else 0}, {at[1] if isinstance(at, tuple) else at}, {half})" for i, (kind, at, half) in enumerate(STEPS, 1))}),
b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY i) AS r FROM s WHERE kind = 'b'),
n AS (SELECT u::INTEGER AS step, g::INTEGER AS t FROM range(1, {len(STEPS) + 1}) a(u), range(1, 16) c(g)),
up AS (SELECT n.*, k, n.t >> k::INTEGER AS above FROM n, range(4) r(k) WHERE n.t >> k::INTEGER > 0),
must AS (SELECT DISTINCT s.t >> k::INTEGER AS t, n.step FROM s, range(3) r(k), n WHERE kind = 'd' AND half = 1 AND i <= n.step),
off AS (SELECT DISTINCT up.step, up.t FROM up JOIN s ON s.t = above WHERE kind = 'd' AND half = 0 AND i <= step AND (up.t < 8 OR up.t <> ((s.t + 1) << k::INTEGER) - 1)),
gone AS (SELECT DISTINCT step, n.t, x.x FROM n JOIN s ON s.t = n.t AND i <= step AND kind = CASE WHEN n.t < 8 THEN 'a' ELSE 'c' END, (VALUES (1), (2), (3)) x(x) WHERE (half = 0) = (s.x = x.x)),
have AS (SELECT n.step, n.t, string_agg(x.x::VARCHAR, ',' ORDER BY x.x) AS choices FROM n, (VALUES (1), (2), (3)) x(x) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.step = n.step AND gone.t = n.t AND gone.x = x.x) GROUP BY ALL),
cut AS (SELECT n.step, n.t, coalesce(sum(half * pow(2, -r)), 0) AS low, pow(2, -count(r)) AS width FROM n LEFT JOIN b ON b.t = n.t AND i <= step GROUP BY ALL),
w AS (SELECT n.step, n.t, CASE WHEN off.t IS NULL THEN choices ELSE '' END AS choices, low, CASE WHEN off.t IS NULL THEN low + width ELSE 0 END AS high, (must.t IS NOT NULL)::INTEGER AS split_low, (off.t IS NULL)::INTEGER AS split_high
      FROM n LEFT JOIN have USING (step, t) JOIN cut USING (step, t) LEFT JOIN off USING (step, t) LEFT JOIN must USING (step, t)),
o AS (SELECT step, t FROM w WHERE t < 8 AND low < high AND split_high = 1 QUALIFY row_number() OVER (PARTITION BY step ORDER BY (high - low) * (5 - length(bin(t))) DESC, t) = 1)
SELECT w.step, w.t, choices, CASE WHEN w.t < 8 THEN coalesce((SELECT sum(g.n) FROM g WHERE list_contains(string_split(w.choices, ','), g.f::VARCHAR) AND g.v BETWEEN w.low AND w.high), 0)::BIGINT END AS hits, CASE WHEN w.t < 8 THEN low END AS low, CASE WHEN w.t < 8 THEN high END::DOUBLE AS high, CASE WHEN w.t < 8 THEN split_low END AS split_low, CASE WHEN w.t < 8 THEN split_high END AS split_high, o.t IS NOT NULL AS widest
FROM w LEFT JOIN o ON o.step = w.step AND o.t = w.t"""

#: Group sizes do not depend on what the rows are dealt by; the rest holds for true clusters only.
_DEALT = f"SELECT g::BIGINT AS group_id, ((SELECT count(*) FROM customer) - g + {N_GROUPS - 1}) // {N_GROUPS} AS n, true AS even, true AS near, 4::INTEGER AS clusters FROM range({N_GROUPS}) r(g) WHERE g < (SELECT count(*) FROM customer)"
#: A leaf's rows are dealt in turn behind those of the leaves before it.
_LEAF_DEALT = f"""WITH {CUSTOMERS}, q AS (SELECT {sql_leaf(TWO)} AS leaf FROM p), i AS (SELECT leaf, row_number() OVER (ORDER BY leaf) - 1 AS i FROM q)
SELECT (i % {N_GROUPS})::BIGINT AS group_id, leaf::INTEGER AS leaf, count(*) AS n FROM i GROUP BY ALL"""


ORACLES = {
    "class_frequency": "SELECT 'lineitem' AS tab, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY ALL",
    "majority_share": "SELECT round(max(n)::DOUBLE / sum(n)::DOUBLE, 9) AS share FROM (SELECT count(*) AS n FROM events GROUP BY event_type)",
    "label_encode": "SELECT c_custkey, c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER AS y FROM customer",
    "one_hot": "SELECT c_custkey, array_to_string(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN i = y THEN 1 ELSE -1 END), ',') AS code, y AS decoded FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INTEGER AS y FROM customer)",
    "minmax_scale": f"WITH {POINTS} SELECT l_orderkey, l_linenumber, f1, f2, f3 FROM p",
    "drop_constant": "SELECT 'l_quantity' AS feature, min(l_quantity) AS low, max(l_quantity) AS high, min(l_quantity) <> max(l_quantity) AS kept FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount), min(l_discount) <> max(l_discount) FROM lineitem UNION ALL SELECT 'one', 1.0::DOUBLE, 1.0::DOUBLE, false",
    "feature_min_gap": "SELECT f::INTEGER AS f, round(coalesce(min(gap), 1e-10), 9) AS gap FROM (SELECT f, v - lag(v) OVER (PARTITION BY f ORDER BY v) AS gap FROM (SELECT DISTINCT 1 AS f, l_quantity AS v FROM lineitem UNION SELECT 2, l_discount FROM lineitem UNION SELECT 3, l_tax FROM lineitem)) GROUP BY f",
    "stratified_split": f"SELECT o_orderkey, o_orderstatus, CASE WHEN i::DOUBLE / n <= 0.5 THEN 'train' WHEN i::DOUBLE / n <= 0.75 THEN 'valid' ELSE 'test' END AS split FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 7919) % {MODULUS}, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)",
    "route_leaf": f"WITH {POINTS} SELECT l_orderkey, l_linenumber, {sql_leaf(DEMO)} AS leaf FROM p",
    "predict": f"WITH {POINTS} SELECT l_orderkey, l_linenumber, y, {sql_leaf(DEMO)} AS leaf, {sql_label(DEMO)} AS pred FROM p",
    "tree_cost": f"WITH {POINTS} {sql_scores([DEMO])}",
    "leaf_histogram": f"WITH {POINTS}, c AS (SELECT {sql_leaf(DEMO)} AS leaf, y, count(*) AS n FROM p GROUP BY ALL) SELECT leaf, y, n, first_value(y) OVER (PARTITION BY leaf ORDER BY n DESC, y) AS label FROM c",
    "confusion": f"WITH {POINTS} SELECT y, {sql_label(DEMO)} AS pred, count(*) AS n FROM p GROUP BY ALL",
    "prediction_agreement": f"WITH {POINTS} SELECT {sql_label(DEMO)} AS pred_a, {sql_label(OTHER)} AS pred_b, count(*) AS n FROM p GROUP BY ALL",
    "accuracy_report": f"WITH {POINTS}, s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY (l_orderkey * 7919) % {MODULUS}, l_orderkey, l_linenumber, f1, f2, f3)::DOUBLE / count(*) OVER (PARTITION BY y) > 0.75 AS test FROM p) SELECT "
    + ", ".join(f"round(100 * avg((({sql_label(t)}) = y)::INTEGER) FILTER (test = {flag}), 3) AS {part}_{name}" for name, t in (("a", DEMO), ("b", OTHER)) for part, flag in (("train", "false"), ("test", "true")))
    + " FROM s",
    "score_many_trees": f"WITH {POINTS} SELECT *, tree_id = first_value(tree_id) OVER (ORDER BY cost, tree_id) AS best FROM ({sql_scores(CANDIDATES)})",
    "prune_and_score": f"WITH {POINTS} {sql_scores([tree.pruned(OTHER, shape) for shape in range(8)])}",
    "merge_trees": _sql_merge(),
    "best_stump": _STUMP,
    "best_stump_price": _sql_stump(PRICES, 1, 3),
    "exact_tree_prices": _sql_optimal(PARTS, 2, 6, 2),
    "exact_tree_depth3": _sql_optimal(LINES, 3, 3, 3),
    "regression_tree": _sql_regression(),
    "leaf_report": f"WITH {POINTS}, s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY (l_orderkey * 7919) % {MODULUS}, l_orderkey, l_linenumber, f1, f2, f3)::DOUBLE / count(*) OVER (PARTITION BY y) AS part FROM p), q AS (SELECT {sql_leaf(DEMO)} AS leaf, y, CASE WHEN part <= 0.5 THEN 'train' WHEN part <= 0.75 THEN 'valid' ELSE 'test' END AS split, ({sql_label(DEMO)} <> y)::INTEGER AS wrong FROM s) SELECT leaf, y, split, grouping(leaf, y, split)::BIGINT AS margin, count(*) AS n, sum(wrong)::BIGINT AS errors FROM q GROUP BY CUBE (leaf, y, split)",
    "optimal_depth2": _depth2(),
    "exact_tree": _depth2(),
    "min_leaf_tree": _depth2("a1 + a2 + a3 = 0 OR least(a1 + a2 + a3, b1 + b2 + b3)::DOUBLE >= total / 5", root="min(m)::DOUBLE >= max(total) / 5"),
    "shaped_tree": _depth2("side = 0 OR a1 + a2 + a3 = 0", "(1 - side)", stop="false"),
    "box_feasible": f"WITH {POINTS}, l AS (SELECT DISTINCT 1 AS f, f1 AS v FROM p UNION SELECT 2, f2 FROM p UNION SELECT 3, f3 FROM p), b(box_id, t, f, lo, hi) AS (VALUES {', '.join(map(str, RANGES))}), n AS (SELECT box_id, t, max(EXISTS (SELECT 1 FROM l WHERE l.f = b.f AND l.v BETWEEN b.lo::DOUBLE AND b.hi::DOUBLE)::INTEGER) AS hit FROM b GROUP BY box_id, t) SELECT box_id, min(hit) = 1 AS feasible FROM n GROUP BY box_id",
    "leaf_reach": f"WITH {_REACH} SELECT p_partkey, y, array_to_string(reach, ',') AS reach, cost, lb FROM z",
    "cf_bound": f"WITH {_REACH} {_closed('z', PART_BOX)}",
    "cf_bound_lineitem": f"WITH {_REACH_L} {_closed('z', BOX)}",
    "label_cover_counts": f"WITH {_REACH} SELECT y, array_to_string(reach, ',') AS reach, count(*) AS n FROM z GROUP BY ALL",
    "label_cover_bound": f"WITH {_REACH_L}, n AS (SELECT y, reach, count(*) AS n FROM z GROUP BY ALL), a AS ({_COVER}), u AS (SELECT sum(CASE WHEN {' OR '.join(f'(list_contains(reach, {t}) AND c{t} = y)' for t in sorted(BOX.labels))} THEN 0 ELSE n END) AS errors FROM a, n GROUP BY {', '.join(f'c{t}' for t in sorted(BOX.labels))}) SELECT round(min(errors)::DOUBLE / {SHARE} + {ALPHA * BOX.least_splits}::DOUBLE, 6) AS bound FROM u",
    "group_deal": f"WITH {CUSTOMERS} SELECT c_custkey, y, ({_DEAL} % {N_GROUPS})::BIGINT AS group_id FROM p",
    "bootstrap_groups": f"WITH {CUSTOMERS}, q AS (SELECT *, row_number() OVER (ORDER BY (c_custkey * 7919) % {MODULUS}, c_custkey) - 1 AS i FROM p), d AS (SELECT DISTINCT g AS group_id, (g * 1000003 + j * 7919 + 3 * {MODULUS}) % (SELECT count(*) FROM p) AS i FROM range({N_BOOTSTRAP}) a(g), range(50) b(j)) SELECT group_id, c_custkey, y FROM d JOIN q USING (i)",
    "group_bound": _GROUP1,
    "multiplier_bound": _MULTIPLIER,
    "group_bound_depth2": _sql_group2(),
    "cart_tree": _sql_cart(),
    "unreached_leaves": f"WITH {_REACH} SELECT array_to_string(list_filter([4, 5, 6, 7], lambda t: NOT list_contains(reach, t)), ',') AS unreached, count(*) AS n FROM z GROUP BY ALL",
    "branched_boxes": _BRANCHED,
    "equal_trees": f"WITH {POINTS}, f AS (SELECT {', '.join(f'{sql_label(tree.pruned(OTHER, i))} AS l{i}' for i in range(8))} FROM p), d AS ("
    + " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, sum((l{a} <> l{b})::INTEGER)::BIGINT AS differing FROM f" for a, b in product(range(8), repeat=2))
    + ") SELECT a::INTEGER AS a, b::INTEGER AS b, (CASE WHEN a = 0 THEN 7 WHEN a < 4 THEN 3 ELSE a END) = (CASE WHEN b = 0 THEN 7 WHEN b < 4 THEN 3 ELSE b END) AS same, differing FROM d",
    "drop_missing": "SELECT c_acctbal AS f1, c_custkey::DOUBLE AS f2, c_mktsegment AS label FROM customer WHERE c_custkey % 3 > 0",
    "group_counts": _GROUP_COUNTS,
    "group_blocks": f"WITH {CUSTOMERS}, g AS (SELECT ({_DEAL} % 25)::BIGINT AS group_id FROM p) SELECT group_id, count(*) AS n, 1::BIGINT AS parts, true AS in_order FROM g GROUP BY group_id",
    "result_row": f"WITH {_REACH_L}, o AS ({sql_scores([INSIDE])}), b AS ({_closed('z', BOX)}) SELECT 'lineitem' AS name, cost AS objv, bound AS lb, round((cost - bound) / bound, 6) AS gap, accuracy FROM o, b",
    "covariance_spectrum": f"WITH {POINTS}, v AS (SELECT unnest([var_pop(f1), var_pop(f2), var_pop(f3)]) AS x FROM p) SELECT row_number() OVER (ORDER BY x)::INTEGER AS i, round(x, 9) AS eigenvalue FROM v",
    "embedding_features": f"WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, (label + 1)::INTEGER AS y FROM embeddings), r AS (SELECT min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2 FROM e), p AS (SELECT vec_id, y, (x1 - a1) / (b1 - a1) AS f1, (x2 - a2) / (b2 - a2) AS f2, 0.0::DOUBLE AS f3 FROM e, r) SELECT vec_id, y, {sql_leaf(DEMO)} AS leaf, {sql_label(DEMO)} AS pred FROM p",
    "order_ranks": "SELECT event_type, first_id, n, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"begin\" FROM (SELECT event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY event_type)",
    "class_lookup": "SELECT s_suppkey, s_acctbal, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "kmeans_groups": _DEALT,
    "leaf_groups": _LEAF_DEALT,
    "windowed_accuracy": f"WITH e AS (SELECT ts, hour(ts)::DOUBLE AS x1, value AS x2, event_type FROM events), r AS (SELECT min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2 FROM e), k AS (SELECT event_type, row_number() OVER (ORDER BY event_type)::INTEGER AS y FROM (SELECT DISTINCT event_type FROM e)), p AS (SELECT ts, (x1 - a1) / (b1 - a1) AS f1, (x2 - a2) / (b2 - a2) AS f2, y FROM e JOIN k USING (event_type), r) SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg((({sql_label(TWO)}) = y)::INTEGER), 9) AS accuracy FROM p GROUP BY 1",
    "read_delimited": f"WITH {CUSTOMERS}, c AS (SELECT min(c_custkey)::DOUBLE a3, max(c_custkey)::DOUBLE b3, count(DISTINCT c_mktsegment) AS k FROM customer) SELECT f1, f2, (c_custkey::DOUBLE - a3) / (b3 - a3) AS f3, y, k::INTEGER AS k FROM p, c",
    "tree_nodes": f"WITH {POINTS}, q AS (SELECT {sql_leaf(DEMO)} AS leaf FROM p), h AS (SELECT leaf >> k::INTEGER AS t, count(*) AS hits FROM q, range({DEMO.depth + 1}) r(k) GROUP BY ALL) SELECT v.*, coalesce(hits, 0) AS hits FROM (VALUES " + ", ".join(f"({t}, 'branch', {DEMO.split[t][0] if t in DEMO.split else 'NULL'}, {DEMO.split[t][1] if t in DEMO.split else 'NULL'}::DOUBLE, {'true' if t in DEMO.split else 'false'}, NULL)" for t in DEMO.branches) + ", " + ", ".join(f"({t}, 'leaf', NULL, NULL, NULL, {DEMO.label.get(t, 0)})" for t in DEMO.leaves) + ") v(t, kind, feature, threshold, has_split, label) LEFT JOIN h USING (t)",
}
