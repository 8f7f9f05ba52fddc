"""Groups of rows: how many, dealt evenly by class or cluster, or drawn with repetition."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from timberline.functions.prep import class_position
from timberline.operators.tree import Tree, leaf
from timberline.sources.tables import scratch

#: Distinct points of a leaf that one k-means takes, about; parts that a round cuts a block into at most; steps of a k-means.
BLOCK, WAYS, STEPS = 1024, 4, 20


def group_count(n: int, n_features: int, n_classes: int, depth: int) -> int:
    """How many groups of a size that an exact solver manages: smaller for deeper trees and more features."""
    if n < 50:
        return 2
    if depth > 2:
        size = 100 if 1000 <= n <= 5000 else 50
    else:
        size = (152 + n_features) / 2**depth - (n_features + 2 + n_classes)
        size = size if size > 0 else max(30, n_classes)
    return max(1, round(n / size))


def deal(df: DataFrame, by: str, order: Column, *ties: str, n_groups: int, carry: bool = False, under: str | None = None) -> DataFrame:
    """``df`` with ``group_id``: the rows of each value of ``by`` are dealt in turn, in ``order``.

    With ``carry`` the next value goes on where the last one ended. Ranks come from class sizes and ranks within
    buckets, so no task holds a whole class. ``under``: a column in whose order that of ``by`` lies, where values of
    ``by`` are many; only the distinct values of ``under`` are then ordered in one task.
    """
    placed = class_position(df, by, order, *ties)
    start = F.lit(0)
    if carry:
        sizes = df.groupBy(by, *([under] if under else [])).agg(F.count(F.lit(1)).alias("_size"))
        sizes = _starts(sizes, Window.orderBy(by)) if under is None else _starts(sizes, Window.partitionBy(under).orderBy(by))
        if under is not None:
            tops = _starts(sizes.groupBy(under).agg(F.sum("_size").alias("_size")), Window.orderBy(under)).select(under, F.col("_start").alias("_top"))
            sizes = sizes.join(tops, under).withColumn("_start", F.col("_start") + F.col("_top"))
        placed = placed.join(sizes.select(by, "_start"), by)
        start = F.col("_start")
    return placed.withColumn("group_id", F.pmod(F.col("_place") - 1 + start, F.lit(n_groups)).cast("long")).drop("_place", "_of", "_start")


def _starts(sizes: DataFrame, order: Window) -> DataFrame:
    """``sizes`` with ``_start``, the sum of ``_size`` before each row."""
    return sizes.withColumn("_start", F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def draws(df: DataFrame, n: int, n_groups: int, size: int = 50, round_: int = 0) -> DataFrame:
    """Rows ``group_id`` and ``_place`` (from 0) of groups drawn with repetition, repeats dropped; the draw is arithmetic."""
    spark = df.sparkSession
    groups = spark.range(n_groups).select(F.col("id").alias("group_id"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_draw"))
    place = F.pmod(F.col("group_id") * 1000003 + F.col("_draw") * 7919 + round_ * 104729, F.lit(max(n, 1)))
    return groups.select("group_id", place.alias("_place")).distinct()


def bootstrap(df: DataFrame, order: Column, *ties: str, n: int, n_groups: int, size: int = 50, round_: int = 0) -> DataFrame:
    """``df``'s rows in the groups that drew them, with ``group_id``; a row can be in several."""
    placed = class_position(df.withColumn("_all", F.lit(0)), "_all", order, *ties).withColumn("_place", F.col("_place") - 1)
    return placed.join(draws(df, n, n_groups, size, round_), "_place").drop("_place", "_of", "_all")


def clustered(df: DataFrame, features: list[str], n_clusters: int, trials: int = 5, seed: int = 123) -> DataFrame:
    """``df`` with its k-means ``_cluster``, by the cheapest of several trials (the later of equals)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    models = [KMeans(k=n_clusters, seed=seed + i, featuresCol="_x", predictionCol="_cluster").fit(points) for i in range(trials)]
    best = min(enumerate(models), key=lambda m: (m[1].summary.trainingCost, -m[0]))[1]
    return best.transform(points).drop("_x")


def kmeans_deal(df: DataFrame, features: list[str], key: str, n_groups: int, n_clusters: int, trials: int = 5, seed: int = 123) -> DataFrame:
    """Rows dealt over groups by k-means cluster; group sizes differ by one at most."""
    found = clustered(df, features, n_clusters, trials, seed)
    return deal(found, "_cluster", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(104729)), key, n_groups=n_groups, carry=True).drop("_cluster")


def near_means(x: np.ndarray, w: np.ndarray, k: int, trials: int, seed: int) -> np.ndarray:
    """The k-means cluster of each weighted point, by the cheapest of several trials (the later of equals).

    Where there are no more points than clusters, each is its own.
    """
    if k >= len(x):
        return np.arange(len(x))
    if np.isnan(x).any():
        raise ValueError("k-means needs features without nulls")
    x = x - x.mean(0)
    found, least, squares = np.zeros(len(x), int), np.inf, (x**2).sum(1)
    for i in range(trials):
        random = np.random.default_rng(seed + i)
        centre = np.empty((k, x.shape[1]))
        far = np.ones(len(x))
        for j in range(k):
            chance = np.cumsum(w * far)
            centre[j] = x[min(int(np.searchsorted(chance, random.random() * chance[-1], "right")), len(x) - 1)]
            away = ((x - centre[j]) ** 2).sum(1)
            far = away if j == 0 else np.minimum(far, away)
        for _ in range(STEPS):
            gap = (centre**2).sum(1) - 2 * x @ centre.T
            at = gap.argmin(1)
            size = np.bincount(at, w, k)
            moved = np.stack([np.bincount(at, w * v, k) for v in x.T], 1) / np.maximum(size, 1e-300)[:, None]
            moved = np.where(size[:, None] > 0, moved, centre)
            step, centre = ((moved - centre) ** 2).sum(1).max(), moved
            if step == 0:
                break
        gap = (centre**2).sum(1) - 2 * x @ centre.T
        at = gap.argmin(1)
        cost = float((w * (squares + gap[np.arange(len(x)), at])).sum())
        if cost <= least:
            found, least = at, cost
    return found


def _cut(points: DataFrame, features: list[str], large: list[int], rounds: int) -> DataFrame:
    """``points`` with ``_block``: those of ``large`` leaves in blocks of neighbours, about ``BLOCK`` points in each.

    In each round every block with more points is cut along its widest feature, at approximate quantiles, into ``WAYS``
    parts at most. Bounds of blocks are a table that is joined; nothing of them comes to the driver. Those of leaves of
    more than some 10,000 points can differ with how the points are parted.
    """
    placed = points.withColumn("_block", F.lit(0).cast("long"))
    for _ in range(rounds):
        sums = [f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]
        shares = [i / WAYS for i in range(1, WAYS)]
        quantiles = [F.percentile_approx(c, shares).alias(f"q{i}") for i, c in enumerate(features)]
        boxes = placed.where(F.col("_leaf").isin(large)).groupBy("_leaf", "_block").agg(F.count(F.lit(1)).alias("d"), *sums, *quantiles).where(F.col("d") > BLOCK)
        wide = F.array(*[F.coalesce(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(0.0)) for i in range(len(features))])
        boxes = boxes.withColumn("w", wide).withColumn("f", F.array_position("w", F.array_max("w")).cast("int")).where(F.array_max("w") > 0)
        cuts = F.element_at(F.array(*[F.col(f"q{i}") for i in range(len(features))]), F.col("f"))
        # As many parts as the points want, by every so-manieth quantile.
        each = F.greatest(F.lit(1), F.floor(F.lit(WAYS) * BLOCK / F.col("d")).cast("int"))
        some = F.array_distinct(F.filter(cuts, lambda c, i: (i + 1) % each == 0))
        boxes = boxes.select(F.col("_leaf").alias("_l"), F.col("_block").alias("_b"), "f", some.alias("cuts"))
        x = F.element_at(F.array(*features), F.col("f"))
        part = F.size(F.filter("cuts", lambda c: c <= x))
        joined = placed.join(boxes, (F.col("_leaf") == F.col("_l")) & (F.col("_block") == F.col("_b")), "left")
        joined = joined.withColumn("_block", F.col("_block") * WAYS + F.coalesce(F.when(F.col("f").isNotNull(), part), F.lit(0)))
        path = scratch(points.sparkSession, "blocks")
        joined.select(*placed.columns).write.parquet(path)
        placed = points.sparkSession.read.schema(placed.schema).parquet(path)
    return placed


def leaf_clusters(routed: DataFrame, features: list[str], n_groups: int, trials: int, seed: int) -> DataFrame:
    """``_leaf``, features, ``_top`` and ``_part`` of the distinct points of each ``_leaf``: its blocks and their clusters, as numbers in order.

    Clusters are as many as ``n_groups`` go into a leaf's rows, so they grow with the table. Leaves of more than
    ``BLOCK`` points are cut into blocks of neighbours, at quantiles, and each block has its share of the
    clusters, found in one task; a cluster does not reach over the bounds of its block. A block whose share is more
    than its points has each of them as a cluster.
    """
    points = routed.groupBy("_leaf", *features).agg(F.count(F.lit(1)).alias("_w"))
    leaves = {r._leaf: (r.n, r.d) for r in points.groupBy("_leaf").agg(F.sum("_w").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    large = [at for at, (_, d) in leaves.items() if d > BLOCK]
    rounds = 0
    while large and BLOCK * WAYS**rounds < max(leaves[at][1] for at in large):
        rounds += 1
    schema = T.StructType([*points.schema.fields, T.StructField("_block", T.LongType())])
    placed = _cut(points, features, large, rounds)
    # Distances fall with the number of clusters to the power -2/p; the least sum gives a block a power of its spread.
    power = len(features) / (len(features) + 2)
    wide = reduce(lambda a, b: a + b, [F.sum(F.col("_w") * F.col(c) * F.col(c)) - F.sum(F.col("_w") * F.col(c)) ** 2 / F.sum("_w") for c in features])
    spread = {}
    if large:
        each = placed.where(F.col("_leaf").isin(large)).groupBy("_leaf", "_block").agg(F.greatest(wide, F.lit(0.0)).alias("_s"))
        spread = {r._leaf: r.s for r in each.groupBy("_leaf").agg(F.sum(F.pow("_s", F.lit(power))).alias("s")).collect()}

    def cluster(rows):
        rows = rows.sort_values(features)
        n, _ = leaves[at := int(rows["_leaf"].iloc[0])]
        block, x, w = int(rows["_block"].iloc[0]), rows[features].to_numpy(float), rows["_w"].to_numpy(float)
        k = max(2, n // n_groups)
        if spread.get(at):
            k = max(1, round(k * float((w @ (x - w @ x / w.sum()) ** 2).sum()) ** power / spread[at]))
        found = np.zeros(len(rows), int) if n <= n_groups else near_means(x, w, k, trials, seed)
        return rows[["_leaf", *features]].assign(_top=(at << 30) + block, _part=(((at << 30) + block) << 20) + found)

    # The number of parts is stated: the points are few bytes and much work, which Spark would put into one task.
    parts = max(2 * routed.sparkSession.sparkContext.defaultParallelism, sum(d for _, d in leaves.values()) // (64 * BLOCK))
    out = T.StructType([*[f for f in schema.fields if f.name not in ("_w", "_block")], T.StructField("_top", T.LongType()), T.StructField("_part", T.LongType())])
    return placed.repartition(parts, "_leaf", "_block").groupBy("_leaf", "_block").applyInPandas(cluster, out)


def leaf_deal(df: DataFrame, tree: Tree, features: list[str], key: str, n_groups: int, trials: int = 5, seed: int = 123) -> DataFrame:
    """Rows dealt over groups by leaf of ``tree`` and, within a leaf, by k-means cluster; sizes differ by one at most.

    A leaf has a cluster for every ``n_groups`` of its rows, two at least; a leaf with fewer rows than groups is one.
    So each group holds rows from all over each leaf. The clusters of distinct points are written to the shared folder.
    A null feature is an error, as it has no distance.
    """
    routed = df.withColumn("_leaf", leaf(tree, features))
    path = scratch(df.sparkSession, "clusters")
    leaf_clusters(routed, features, n_groups, trials, seed).write.parquet(path)
    found = df.sparkSession.read.parquet(path).select(F.col("_leaf").alias("_l"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(features)], "_top", "_part")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(features)], F.col("_leaf") == F.col("_l"))
    placed = routed.join(found, same).select(*df.columns, F.col("_top").alias("_block"), "_part")
    return deal(placed, "_part", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(104729)), key, n_groups=n_groups, carry=True, under="_block").drop("_part", "_block")


def blocks(df: DataFrame, group: str, n_parts: int) -> DataFrame:
    """``df`` with whole groups in contiguous parts."""
    return df.repartitionByRange(n_parts, group)
