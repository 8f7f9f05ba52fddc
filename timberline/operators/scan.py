"""Best splits of many boxes of rows at once, by a prefix scan in two levels along each feature.

Rows lie on shared files once a feature, in order of its values, in blocks. To scan, each block first sums up what it
has of every box; running sums over the blocks give each block what lies before it; then each block looks at its own
cuts. So a feature with as many values as rows is scanned by many tasks, and no task sees more than blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.operators.tree import SLACK
from timberline.sources.tables import PART, scratch, shuffles

#: Rows of a block, boxes that one block looks at together, and numbers that all blocks together may sum up in a job.
BLOCK, TOGETHER, SUMS = 16_384, 32, 1 << 22
#: Boxes of a job at least, and quantiles of a feature.
BOXES, GRID = 64, 100
#: Tasks that a small table is dealt over, for each core.
WAVES = 2
#: Bytes of a broadcast side at most, and blocks of a part where blocks are shuffled.
SENT, MOVED = 32 << 20, 64
#: Half-open ranges of the features, one pair a feature; a null value counts as below all.
Box = tuple[tuple[float, float], ...]
BLOCKS = "f int, rows int, x binary, s binary, first double, last double"


@dataclass
class Facts:
    """Of the rows in a box: sums of their statistics, least and greatest value of each feature, and the best split.

    ``value`` is the criterion's value of the split and ``left`` the sums of the rows below its threshold; ``feature``
    is 0 where no split fits.
    """

    sums: np.ndarray
    low: list[float]
    high: list[float]
    value: float = float("inf")
    feature: int = 0
    threshold: float = 0.0
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))


def errors(sums: np.ndarray) -> np.ndarray:
    """Rows that are not of the most frequent class; ``sums`` has the classes last."""
    return sums.sum(-1) - sums.max(-1)


def entropy(sums: np.ndarray) -> np.ndarray:
    """Entropy of the classes times the number of rows."""
    whole = sums.sum(-1, keepdims=True)
    return -np.where(sums > 0, sums * np.log(np.maximum(sums, 1e-300) / np.maximum(whole, 1e-300)), 0.0).sum(-1)


def squares(sums: np.ndarray) -> np.ndarray:
    """Squared distances from the mean, of ``sums`` of weights, targets, and their squares."""
    w, y, yy = sums[..., 0], sums[..., 1], sums[..., 2]
    return np.maximum(yy - np.where(w > 0, y * y / np.where(w > 0, w, 1), 0.0), 0.0)


CRITERIA = {"errors": errors, "entropy": entropy, "squares": squares}


def weight(sums: np.ndarray, criterion: str) -> np.ndarray:
    return sums[..., 0] if criterion == "squares" else sums.sum(-1)


def _inside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows lie in which boxes."""
    out = np.ones((len(x), len(low)), bool)
    for j in range(x.shape[1]):
        v = x[:, j, None]
        if np.isfinite(low[:, j]).any():
            out &= v + SLACK >= low[None, :, j]
        if np.isfinite(high[:, j]).any():
            out &= v + SLACK < high[None, :, j]
    return out


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other: blocks are large, so that a batch is not copied as a whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Layout:
    """Rows of ``df`` (features, and numeric ``stats`` that are summed up) laid out by feature in the shared folder.

    ``df`` is computed once; ``made_of``: the rows that it is an aggregate of, if it is one, so that no task of its
    shuffles takes more than some ``PART`` of them. The same holds for the tasks that order rows.
    """

    def __init__(self, df: DataFrame, features: list[str], stats: list[str], made_of: int = 0) -> None:
        self.spark, self.features, self.stats = df.sparkSession, features, stats
        p = len(features)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def block(rows: np.ndarray) -> pa.RecordBatch:
                f = int(rows[0, 0])
                v = rows[:, f]
                return pa.RecordBatch.from_pylist([{"f": f, "rows": len(rows), "x": rows[:, 1 : p + 1].tobytes(), "s": rows[:, p + 1 :].tobytes(), "first": v[0], "last": v[-1]}], schema=pa.schema({"f": pa.int32(), "rows": pa.int32(), "x": pa.binary(), "s": pa.binary(), "first": pa.float64(), "last": pa.float64()}))

            def flushed(rows: np.ndarray, final: bool) -> Iterator[pa.RecordBatch]:
                for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                    end = len(part) if final or part[0, 0] != rows[-1, 0] else len(part) // BLOCK * BLOCK
                    for low in range(0, end, BLOCK):
                        yield block(part[low : min(low + BLOCK, end)])
                    held[:] = [part[end:]] if end < len(part) else []

            for batch in batches:
                if batch.num_rows:
                    held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1))
                    if sum(map(len, held)) >= BLOCK:
                        yield from flushed(np.concatenate(held), False)
            if held:
                yield from flushed(np.concatenate(held), True)

        x = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(f"_x{j}") for j, c in enumerate(features)]
        rows = df.select(*x, *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(stats)])
        rows_path = scratch(self.spark, "scan-rows")
        with shuffles(self.spark, made_of):
            rows.write.parquet(rows_path)
        whole = rows = self.spark.read.schema(rows.schema).parquet(rows_path)
        each = F.explode(F.array(*[F.struct(F.lit(j + 1).alias("f"), F.col(f"_x{j}").alias("v")) for j in range(p)]))
        rows = rows.withColumn("_c", each).select("_c.f", "_c.v", *[f"_x{j}" for j in range(p)], *[f"_s{i}" for i in range(len(stats))])
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), WAVES * self.spark.sparkContext.defaultParallelism, -(-whole.count() * p // PART))
        # The order of parts, and of rows within them, is that of the blocks' numbers. Rows of one value are parted by the other features.
        order = ["f", "v", *[f"_x{j}" for j in range(p) if p > 1]]
        laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("v").mapInArrow(pack, BLOCKS)
        path = scratch(self.spark, "scan")
        laid.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
        self.blocks = self.spark.read.schema(f"{BLOCKS}, block long").parquet(path)
        before = F.lag("last").over(Window.partitionBy("f").orderBy("block"))  # a number a block
        meta = self.blocks.select("block", "f", "first", "last").withColumn("fresh", F.coalesce(before != F.col("first"), F.lit(True))).select("block", "fresh")
        meta_path = scratch(self.spark, "scan-meta")
        meta.write.parquet(meta_path)
        self.meta = self.spark.read.schema("block long, fresh boolean").parquet(meta_path)
        self.n_blocks = self.meta.count()
        shares = [i / GRID for i in range(GRID + 1)]
        known = [F.when(F.col(f"_x{j}") > float("-inf"), F.col(f"_x{j}")) for j in range(p)]  # no nulls
        found = whole.agg(*[F.percentile_approx(c, shares).alias(f"q{j}") for j, c in enumerate(known)]).first()
        #: Some values of each feature, by its quantiles.
        self.grid = [sorted(set(found[f"q{j}"] or [])) for j in range(p)]

    def _dealt(self, n_boxes: int) -> tuple[DataFrame, int]:
        """The blocks, those of a small table together with parts of the boxes, dealt evenly over the cores."""
        tasks = WAVES * self.spark.sparkContext.defaultParallelism
        if self.n_blocks >= 2 * tasks:
            return self.blocks.withColumn("slice", F.lit(0)), 1
        slices = max(1, min(-(-n_boxes // 8), -(-2 * tasks // max(1, self.n_blocks))))
        return self.blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks), slices

    def facts(self, boxes: list[Box], criterion: str = "errors", split: bool = True, least: float = 0.0) -> list[Facts]:
        """The facts of each box; ``least``: the weight that both sides of a split must have.

        Boxes go to the tasks as they are, so many in a job that what the blocks sum up for them stays bounded.
        """
        step = max(BOXES, SUMS // max(1, self.n_blocks * len(self.stats)))
        out: list[Facts] = []
        for low in range(0, len(boxes), step):
            out += self._facts(boxes[low : low + step], criterion, split, least)
        return out

    def _facts(self, boxes: list[Box], criterion: str, split: bool, least: float) -> list[Facts]:
        p, m = len(self.features), len(self.stats)
        low, high = (np.array([[r[i] for r in b] for b in boxes], float).reshape(len(boxes), p) for i in (0, 1))
        dealt, slices = self._dealt(len(boxes))
        sums, measure = [f"s{i}" for i in range(m)], CRITERIA[criterion]

        def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.frombuffer(row["x"]).reshape(row["rows"], p), np.frombuffer(row["s"]).reshape(row["rows"], m), np.arange(row["slice"], len(boxes), slices)

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in each_row(batches):
                x, s, mine = opened(row)
                v = x[:, row["f"] - 1]
                for at in np.split(mine, range(TOGETHER, len(mine), TOGETHER)):
                    if not len(at):
                        continue
                    inside = _inside(x, low[at], high[at])
                    some = inside.any(0)
                    first, last = v[inside.argmax(0)], v[len(v) - 1 - inside[::-1].argmax(0)]
                    found = inside.T.astype(float) @ s
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"])), pa.array(np.full(len(at), row["f"], np.int32)), pa.array(at, pa.int32()), pa.array(np.where(some, first, np.inf)), pa.array(np.where(some, last, -np.inf)), *[pa.array(found[:, i]) for i in range(m)]], names=["block", "f", "box", "low", "high", *sums])

        partial = dealt.mapInArrow(total, "block long, f int, box int, low double, high double, " + ", ".join(f"{c} double" for c in sums))
        if split:
            path = scratch(self.spark, "scan-sums")
            partial.write.parquet(path)
            partial = self.spark.read.schema(partial.schema).parquet(path)
        ends = partial.groupBy("box", "f").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in sums])
        out = [Facts(np.zeros(m), [np.inf] * p, [-np.inf] * p) for _ in boxes]
        for r in ends.collect():
            out[r.box].low[r.f - 1], out[r.box].high[r.f - 1] = r.low, r.high
            if r.f == 1:
                out[r.box].sums = np.array([r[c] for c in sums])
        if not split:
            return out
        behind = Window.partitionBy("f", "box").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks
        offsets = partial.select("block", "box", F.array(*[F.coalesce(F.sum(c).over(behind), F.lit(0.0)) for c in sums]).alias("o"))
        offsets = offsets.groupBy("block", F.pmod("box", F.lit(slices)).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("box", "o"))).alias("offsets"))
        whole = np.array([b.sums for b in out])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in each_row(batches):
                x, s, mine = opened(row)
                before = np.array([o["o"] for o in row["offsets"]])
                v = x[:, row["f"] - 1]
                starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                real = np.ones(len(starts), bool)
                real[0] = row["fresh"]
                for part in np.split(np.arange(len(mine)), range(TOGETHER, len(mine), TOGETHER)):
                    if not len(part) or not real.any():
                        continue
                    at = mine[part]
                    inside = _inside(x, low[at], high[at])
                    left = np.stack([np.cumsum(np.add.reduceat(inside * s[:, i, None], starts, 0), 0) for i in range(m)], 2)
                    left = np.concatenate([np.zeros((1, *left.shape[1:])), left[:-1]])[real] + before[part][None]
                    right = whole[at][None] - left
                    wl, wr = weight(left, criterion), weight(right, criterion)
                    value = np.where((wl > 0) & (wr > 0) & (wl >= least) & (wr >= least), measure(left) + measure(right), np.inf)
                    best = value.argmin(0)
                    each = np.arange(len(at))
                    fits = np.flatnonzero(np.isfinite(value[best, each]))
                    if len(fits):
                        chosen = left[best[fits], fits]
                        yield pa.RecordBatch.from_arrays([pa.array(at[fits], pa.int32()), pa.array(np.round(value[best[fits], fits], 9)), pa.array(np.full(len(fits), row["f"], np.int32)), pa.array(v[starts[real]][best[fits]]), pa.array(chosen.tolist(), pa.list_(pa.float64()))], names=["box", "value", "f", "v", "left"])

        # Blocks are far larger than what lies before them, and stay where they are while that can be sent.
        if self.n_blocks * len(boxes) * (m + 6) * 8 <= SENT:
            offsets = F.broadcast(offsets)
        else:
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.n_blocks * slices // MOVED)
            dealt, offsets = (d.repartition(parts, "block", "slice") for d in (dealt, offsets))
        met = dealt.join(offsets, ["block", "slice"]).join(F.broadcast(self.meta) if self.n_blocks * 32 <= SENT else self.meta, "block")
        best = met.mapInArrow(cut, "box int, value double, f int, v double, left array<double>").groupBy("box").agg(F.min(F.struct("value", "f", "v", "left")).alias("b"))
        for r in best.collect():
            fact = out[r.box]
            fact.value, fact.feature, fact.threshold, fact.left = r.b["value"], r.b["f"], r.b["v"], np.array(r.b["left"])
        return out


def anywhere(p: int) -> Box:
    return ((float("-inf"), float("inf")),) * p


def halves(box: Box, f: int, threshold: float) -> tuple[Box, Box]:
    """The parts of a box below a threshold of a feature, and from it on."""
    lo, hi = box[f - 1]
    return box[: f - 1] + ((lo, min(hi, threshold)),) + box[f:], box[: f - 1] + ((max(lo, threshold), hi),) + box[f:]


def class_stats(df: DataFrame, classes: int, n: str = "n") -> tuple[DataFrame, list[str]]:
    """``df`` with a column for each class: the weight of rows of that class ``y``."""
    names = [f"_n{k}" for k in range(1, classes + 1)]
    return df.withColumns({c: F.when(F.col("y") == k, F.col(n)).otherwise(0) for k, c in enumerate(names, 1)}), names


def square_stats(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """``df`` with weight, target and square, summed over rows of equal features beforehand by the caller or not."""
    return df.withColumns({"_w": F.lit(1.0), "_y": F.col(target), "_yy": F.col(target) * F.col(target)}), ["_w", "_y", "_yy"]
