"""Preparing labelled tables: encoding, scaling, statistics of classes and features, stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Smallest gap of a feature whose values are all equal.
NO_GAP = 1e-10
#: Labels that are sent to the rows.
FEW = 1 << 16


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``label, y``: the distinct labels in order, coded from 1. The window runs over the distinct labels only."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("y", F.row_number().over(Window.orderBy(label)).cast("int"))


def encode(df: DataFrame, label: str) -> DataFrame:
    """``df`` with the label's code ``y``; rows without a label go.

    Up to ``FEW`` labels are looked up once and sent to the rows, which stay where they are: a join by shuffle would put
    all rows of a label into one task.
    """
    codes = label_codes(df, label)
    some = codes.limit(FEW + 1).collect()
    return df.join(F.broadcast(df.sparkSession.createDataFrame(some, codes.schema)) if len(some) <= FEW else codes, label)


def one_hot(y: Column, k: int, low: int = -1) -> Column:
    """An array with 1 at the label's place and ``low`` (-1 or 0) elsewhere."""
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i == y, 1).otherwise(low))


def from_one_hot(code: Column) -> Column:
    """The first place that holds 1, 0 if none."""
    return F.array_position(code, 1).cast("int")


def ranges(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each feature over all rows, in one aggregation."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(features)}


def scaled(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with features scaled to [0, 1] by the range over all rows (or those of ``fit_on``), and the features kept.

    Features with one value are dropped.
    """
    found = ranges(df if fit_on is None else fit_on, features)
    kept = [c for c in features if found[c][0] is not None and found[c][0] != found[c][1]]
    out = df.withColumns({c: (F.col(c) - F.lit(found[c][0])) / F.lit(found[c][1] - found[c][0]) for c in kept})
    return out.drop(*[c for c in features if c not in kept]), kept


def feature_report(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, low, high, kept`` of every feature: one aggregation, then one row a feature."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(f"_{i}") for i, c in enumerate(features)])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}.low").alias("low"), F.col(f"_{i}.high").alias("high")) for i, c in enumerate(features)]))
    return row.select(one.alias("r")).select("r.*").withColumn("kept", F.coalesce(F.col("low") != F.col("high"), F.lit(False)))


def long_form(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row for each row and feature: ``f`` (place of the feature, from 1), ``v``, and the columns to keep."""
    cells = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)]))
    return df.select(*keep, cells.alias("_c")).select(*keep, "_c.f", "_c.v")


def min_gaps(df: DataFrame, features: list[str], parts: int = 256) -> DataFrame:
    """``f, gap``: the smallest gap between consecutive distinct values of each feature.

    Values are made distinct and ordered within buckets between approximate quantiles, so a feature with very many
    of them spreads over tasks; the ends of buckets are compared afterwards, at most ``parts`` of them a feature.
    Nulls do not count; a feature of one value has the least gap there is, and one without values has no row.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(f"q{i}") for i, c in enumerate(features)]).first()
    bucket = F.lit(0)
    for i in range(len(features)):
        steps = sorted(set(cuts[f"q{i}"] or []))
        below = F.size(F.filter(F.lit(steps).cast("array<double>"), lambda q: q <= F.col("v"))) if steps else F.lit(0)
        bucket = F.when(F.col("f") == i + 1, below).otherwise(bucket)
    values = long_form(df, features).where("v is not null").distinct().withColumn("_b", bucket)
    inside = F.col("v") - F.lag("v").over(Window.partitionBy("f", "_b").orderBy("v"))
    ends = values.withColumn("_gap", inside).groupBy("f", "_b").agg(F.min("_gap").alias("_gap"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    between = F.col("_low") - F.lag("_high").over(Window.partitionBy("f").orderBy("_b"))
    return ends.withColumn("_gap", F.least("_gap", between)).groupBy("f").agg(F.coalesce(F.min("_gap"), F.lit(NO_GAP)).alias("gap"))


def class_frequency(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """One row ``share``: the largest class's part of all rows."""
    return class_frequency(df, label).agg((F.max("n") / F.sum("n")).alias("share"))


def class_position(df: DataFrame, label: str, order: Column, *ties: str, bucket: int = 64) -> DataFrame:
    """``df`` with each row's place in its class (``_place``, from 1) and the class's size (``_of``).

    Places by ``order`` (a number from 0) then ``ties``. Ranks are taken within buckets of ``order`` and added to
    the rows of earlier buckets, so a class that holds most rows is still dealt over many tasks.
    """
    df = df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / bucket))
    counts = df.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_prior", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_of", F.sum("_n").over(Window.partitionBy(label)))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_o", *ties))
    ranked = df.withColumn("_rank", rank).join(counts.drop("_n"), [label, "_b"])
    return ranked.withColumn("_place", F.col("_prior") + F.col("_rank")).drop("_o", "_b", "_rank", "_prior")


def stratified_split(df: DataFrame, label: str, order: Column, *ties: str, train: float = 0.5, valid: float = 0.25) -> DataFrame:
    """``df`` with ``split``: of each class the first part is train, the next valid, the rest test."""
    placed = class_position(df, label, order, *ties)
    part = F.col("_place") / F.col("_of")
    split = F.when(part <= train, "train").when(part <= train + valid, "valid").otherwise("test")
    return placed.withColumn("split", split).drop("_place", "_of")


def cells(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Distinct rows of features and label with their number ``n``: what an exact search needs to know of the data."""
    return df.groupBy(*features, label).agg(F.count(F.lit(1)).alias("n"))
