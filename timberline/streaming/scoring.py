"""Scoring a stream of rows with a fixed tree: a stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.tree import Tree, predict


def scored(stream: DataFrame, tree: Tree, features: list[str]) -> DataFrame:
    """The stream with ``leaf`` and ``pred``."""
    return predict(stream, tree, features)


def windowed_accuracy(stream: DataFrame, tree: Tree, features: list[str], time: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Accuracy of the labelled rows (``y``) of a stream by time window; rows later than ``late`` are left out by the watermark."""
    rows = scored(stream, tree, features).withWatermark(time, late)
    right = F.avg((F.col("pred") == F.col("y")).cast("double"))
    return rows.groupBy(F.window(time, every)).agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"))
