"""Group bounds tightened by multipliers.

Each group's best tree fits its own rows, so the sum of their costs is far below that of one tree for all. Here a group
pays for what its tree chooses: the feature and the piece of the threshold at each node, the label at each leaf. What all
groups pay for one choice adds up to nothing, so a tree common to all costs what it did, and the sum stays a bound of it,
in every box. Groups that choose what few others do pay more for it from round to round, and come to agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.bounds import cut
from timberline.operators.box import Box
from timberline.operators.exact import Pull, solve_groups
from timberline.sources.tables import scratch

STATE = "group_id long, x array<double>, y array<int>, bound double, chosen array<int>, pull array<double>"
#: Part of a full step to begin with, rounds without a better bound after which it is halved, and the least part.
FIRST_STEP, PATIENCE, LEAST_STEP = 0.25, 3, 1e-3


def _round(state: DataFrame, box: Box, n_features: int, share: float, alpha: float, eps: np.ndarray, classes: int, step: float, mean: np.ndarray) -> DataFrame:
    """``state`` with each group's multipliers moved by ``step`` along its choices less their ``mean``, and solved anew."""

    def work(batches):
        for b in batches:
            if not len(b):
                continue
            pull = np.stack(b["pull"].to_numpy()) - step * mean
            for line, places in zip(pull, b["chosen"], strict=True):
                line[places] += step
            at = np.repeat(np.arange(len(b)), b["y"].map(len))
            x, y = np.concatenate(b["x"].to_numpy()).reshape(-1, n_features), np.concatenate(b["y"].to_numpy())
            values, trees = solve_groups(x, y, at, box, share, alpha, eps, Pull.of(pull, box.depth, n_features, classes))
            yield b.assign(bound=values, chosen=[Pull.chosen(t, n_features, classes) for t in trees], pull=list(pull))

    return state.mapInPandas(work, STATE)


def tuned(groups: DataFrame, box: Box, features: list[str], share: float, alpha: float, total: int, eps: np.ndarray, classes: int, upper: float, rounds: int, parts: int | None = None) -> tuple[DataFrame, list[float]]:
    """``group_id, pull`` of the best round, and the bounds of all rounds, the first of which is the plain sum.

    ``groups``: ``group_id``, features and ``y`` from 1 to ``classes``, none null; groups are small, as ``group_count``
    has them. ``upper`` is the cost of a known tree, which sets the steps. A round is one pass without a shuffle over a
    table with a line for each group, and one small aggregate, all that the driver sees. An empty table has the bound 0.
    It ends early where all groups agree or steps get too small. Depths 1 and 2.
    """
    spark, size = groups.sparkSession, Pull.size(box.depth, len(features), classes)
    rows = F.collect_list(F.struct(F.array(*features).cast("array<double>").alias("x"), F.col("y").cast("int").alias("y")))
    state = groups.repartition(parts or 2 * spark.sparkContext.defaultParallelism, "group_id").groupBy("group_id").agg(rows.alias("r"))
    nothing = F.lit(0.0).alias("bound"), F.array().cast("array<int>").alias("chosen"), F.array_repeat(F.lit(0.0), size).alias("pull")
    state = state.select("group_id", F.flatten("r.x").alias("x"), F.col("r.y").alias("y"), *nothing)
    step, mean, part, worse, values, best = 0.0, np.zeros(size), FIRST_STEP, 0, [], None
    for _ in range(rounds):
        path = scratch(spark, "pulled")
        _round(state, box, len(features), share, alpha / total, eps, classes, step, mean).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        row = state.agg(F.sum(cut(F.col("bound"))).alias("s"), F.count(F.lit(1)).alias("n")).first()
        found = state.select(F.explode("chosen").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()
        values.append(float(row.s or 0.0))
        if best is None or values[-1] > values[best[0]]:
            best, worse = (len(values) - 1, state.select("group_id", "pull")), 0
        else:
            worse += 1
            if worse >= PATIENCE:
                part, worse = part / 2, 0
        mean = np.zeros(size)
        for r in found:
            mean[r.at] = r.n / row.n
        apart = row.n * float((mean * (1 - mean)).sum())
        if apart <= 1e-9 or part < LEAST_STEP or upper <= values[-1]:
            break
        step = part * (upper - values[-1]) / apart
    return best[1], values
