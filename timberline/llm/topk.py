"""Exact top-k search by distributed histogram selection.

Scores of all queries against all rows are made again in each round, block by block, and never stored. A round counts
them in bins of each query's interval, and the bins add up over all blocks to global histograms. The bin that holds
the k-th value becomes the next interval, until few rows lie at or above it. Where one score is shared by more rows
than that, the same rounds go on over their ids. The last round gives the rows within the intervals, and these are
put in order. So neither many equal scores nor a query near to all rows make a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import small, table, written
from timberline.llm.frugal import frugal

#: A component counts ``floor(SCALE * x)``.
SCALE = 1024
#: Queries in a block, rows in a block at most, rows scored at once, and blocks that meet a block of queries under one key.
QUERIES, ROWS, AT_ONCE, MEET = 512, 8192, 2048, 64
#: Bins of an interval (a power of 2), and rows that the last round may give for each of the k.
BINS, SLACK = 1024, 4
#: Largest score.
MOST = 2**63 - 1

STATE = "query long, block int, place int, phase int, score long, low long, high long, above long, done boolean"
BLOCK = "ids binary, data binary, width int, largest double, rows long"


def _matrix(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, width) if rows * width else np.zeros((rows, width))


def _packed(ids: np.ndarray, vectors: list) -> dict:
    """A block of vectors, shorter ones filled up with zeros."""
    width = max(map(len, vectors), default=0)
    data = np.zeros((len(vectors), width))
    for row, v in zip(data, vectors, strict=True):
        row[: len(v)] = v
    return {"ids": ids.astype("<i8").tobytes(), "data": data.tobytes(), "width": width, "largest": float(np.abs(data).max(initial=0)), "rows": len(ids)}


def _whole(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` as Python numbers, for values beyond 64-bit floating point."""
    return np.array([int(v) * SCALE if abs(v) > 2.0**53 else int(np.floor(v * SCALE)) for v in x.flat], object).reshape(x.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and of ``b`` as whole numbers, exact; what 64 bits do not hold is cut to their ends.

    Vectors of different lengths agree in length by zeros.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b)]
    top = [float(np.abs(m).max(initial=0)) * SCALE + 1 for m in (a, b)]
    if top[0] * top[1] * max(width, 1) < 2.0**52:
        return (np.floor(a * SCALE) @ np.floor(b * SCALE).T).astype(np.int64)
    return np.clip(_whole(a).dot(_whole(b).T), -MOST - 1, MOST).astype(np.int64).reshape(len(a), len(b))


def _offsets(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How far values lie above a lower end, as unsigned numbers, so that no interval is too wide."""
    return values.view(np.uint64) - low.view(np.uint64)


def _shift(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The power of 2 of a bin's width, for ``BINS`` bins between two ends (both within)."""
    span = _offsets(high, low)
    return np.array([max(0, int(s).bit_length() - (BINS.bit_length() - 1)) for s in span.tolist()], np.uint64)


class Meeting:
    """A block of queries with their state, and a block of rows: values, and which of them count.

    In phase 0 the value is the score, in phase 1 the inverted id of the rows that have the k-th score, so greater is
    better in both; a query's own row does not count.
    """

    def __init__(self, pair: dict) -> None:
        state = pair["state"]
        self.state = {c: np.array([s[c] for s in state]) for c in ("query", "phase", "score", "low", "high", "above")}
        done = np.array([s["done"] for s in state], bool)
        self.open = np.flatnonzero(~done) if not pair["last"] else np.arange(len(state))
        n, width = len(state), pair["q_width"]
        self.q = _matrix(pair["q_data"], width, n)[self.open]
        self.state = {c: v[self.open].astype(np.int64) for c, v in self.state.items()}
        ids = np.frombuffer(pair["ids"], "<i8").reshape(2, -1)
        self.row, self.id = ids[0], ids[1]
        self.x = _matrix(pair["data"], pair["width"], len(self.row))

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores, ids and row numbers, some rows at a time."""
        for low in range(0, len(self.row), AT_ONCE):
            yield scores(self.q, self.x[low : low + AT_ONCE]), self.id[low : low + AT_ONCE], self.row[low : low + AT_ONCE]

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, bin and number of values, from a query's top bin down to where ``k`` of this block are reached.

        The k-th of all rows is not below the k-th of these, so bins further down tell nothing.
        """
        n, s = len(self.open), self.state
        total, shift = np.zeros(n * BINS, np.int64), _shift(s["low"], s["high"])[:, None]
        low, high = s["low"][:, None], s["high"][:, None]
        for value, id_, row in self.parts():
            second = np.flatnonzero(s["phase"] == 1)
            tied = value[second] == s["score"][second][:, None]
            value[second] = ~id_[None, :]
            here = (value >= low) & (value <= high) & (row[None, :] != s["query"][:, None])
            here[second] &= tied
            q, at = np.nonzero(here)
            bin_ = _offsets(value[q, at], s["low"][q]) >> shift[q, 0]
            total += np.bincount(q * BINS + bin_.astype(np.int64), minlength=n * BINS)
        total = total.reshape(n, BINS)
        behind = np.cumsum(total[:, ::-1], 1)[:, ::-1] - total  # how many lie in higher bins
        q, at = np.nonzero((total > 0) & (behind < k))
        return s["query"][q], at, total[q, at]

    def taken(self, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Query, id and score of the rows at or above each query's bound; of rows alike in both, ``k`` at most."""
        s = self.state
        for value, id_, row in self.parts():
            first, second = (s["phase"] == 0)[:, None], (s["phase"] == 1)[:, None]
            here = first & (value >= s["low"][:, None]) | second & ((value > s["score"][:, None]) | (value == s["score"][:, None]) & (~id_[None, :] >= s["low"][:, None]))
            here &= row[None, :] != s["query"][:, None]
            q, at = np.nonzero(here)
            found = pd.DataFrame({"query": s["query"][q], "vec_id": id_[at], "score": value[q, at]})
            found = found[found.groupby(["query", "vec_id", "score"]).cumcount() < k]
            yield found["query"].to_numpy(), found["vec_id"].to_numpy(), found["score"].to_numpy()


def narrowed(state: pd.DataFrame, k: int) -> pd.DataFrame:
    """The state of queries after a round: ``bin`` holds the k-th value, ``upto`` rows lie in it or in higher bins of the interval, ``n`` in it."""
    some = state["bin"].notna().to_numpy()
    out = state.copy()
    low, high = out["low"].to_numpy().copy(), out["high"].to_numpy().copy()
    shift = _shift(low, high)
    bin_ = state["bin"].fillna(0).to_numpy().astype(np.uint64)
    new_low = (low.view(np.uint64) + (bin_ << shift)).view(np.int64)
    width = (np.uint64(1) << shift) - np.uint64(1)
    new_high = np.where(_offsets(high, new_low) > width, (new_low.view(np.uint64) + width).view(np.int64), high)
    inside, above = state["n"].fillna(0).to_numpy().astype(np.int64), out["above"].to_numpy() + (state["upto"] - state["n"]).fillna(0).to_numpy().astype(np.int64)
    few = above + inside <= SLACK * k
    single = new_low == new_high
    ties = some & single & ~few & (out["phase"].to_numpy() == 0)
    out["low"], out["high"], out["above"] = np.where(some, new_low, low), np.where(some, new_high, high), np.where(some, above, out["above"])
    out["score"] = np.where(ties, new_low, out["score"])
    out["phase"] = np.where(ties, 1, out["phase"])
    out["low"], out["high"] = np.where(ties, state["id_low"], out["low"]), np.where(ties, state["id_high"], out["high"])
    out["done"] = out["done"].to_numpy(bool) | some & ~ties & (few | single)
    return out


def _arrow(columns: dict[str, np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in kinds], names=list(kinds))


def _clean(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    x = F.col(vector)
    fine = F.col(id_).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_).cast("long").alias("id"), F.col("_query"), x.cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("row"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of greatest inner product with each query but itself, all if fewer.

    Queries are the rows for which ``is_query`` holds. Scores are whole numbers, those of components
    ``floor(SCALE * x)``; ties go to the smaller id. Rows without id, and vectors that are null or hold null, NaN or
    infinite components, take no part; empty vectors score 0 with all, and shorter ones count as filled up with zeros.
    Rows that share an id are told apart by their place: each is a query of its own, and a candidate of the others.
    Scores beyond 64 bits are cut to their ends. Vectors of any length are held in blocks of ``ROWS`` of them. Without
    queries, without another row, or on an empty table there are no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(_clean(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))), id_, vector), "topk-rows")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_query").cast("long")).alias("q"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not sums.q or sums.n < 2:
        return spark.createDataFrame([], result)
    ends = F.bitwise_not(F.lit(sums.high).cast("long")), F.bitwise_not(F.lit(sums.low).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                ids = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
                flat, ends_ = part.column(2).flatten().to_numpy(zero_copy_only=False), part.column(2).offsets.to_numpy()
                block = _packed(ids[0], [flat[a - ends_[0] : b - ends_[0]] for a, b in zip(ends_[:-1], ends_[1:], strict=True)])
                yield pa.RecordBatch.from_pylist([block | {"ids": ids.astype("<i8").tobytes()}], schema=pa.schema({"ids": pa.binary(), "data": pa.binary(), "width": pa.int32(), "largest": pa.float64(), "rows": pa.int64()}))

    blocks = written(rows.select("row", "id", "x").mapInArrow(frugal(pack), BLOCK).withColumn("number", F.monotonically_increasing_id()), "topk-blocks")
    facts = blocks.agg(F.max("largest").alias("largest"), F.max("width").alias("width"), F.count(F.lit(1)).alias("n")).first()

    # Queries in blocks of like size, by a hash; the blocks and what is known of each query.
    n_blocks = -(-sums.q // QUERIES)
    asked = rows.where("_query").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    asked = asked.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("row")) - 1)

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        block = _packed(part["row"].to_numpy(), list(part["x"]))
        return pd.DataFrame({"block": [part["block"].iloc[0]], "q_data": [block["data"]], "q_width": [block["width"]]})

    asked = written(asked.select("row", "id", "block", "place", "x"), "topk-asked")
    q_blocks = written(asked.select("row", "block", "place", "x").groupBy("block").applyInPandas(gather, "block int, q_data binary, q_width int"), "topk-queries")
    # No score lies further from 0 than this, with room for rounding.
    far = (F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)) * SCALE + 1) * F.lit((facts.largest * SCALE + 1) * max(facts.width, 1))
    reach = F.when(far < 2.0**62, far.cast("long") + 1).otherwise(F.lit(MOST))
    few = sums.n - 1 <= SLACK * k
    state = asked.select(F.col("row").alias("query"), "block", "place", F.lit(0).alias("phase"), F.lit(0).cast("long").alias("score"), (-reach - 1).alias("low"), reach.alias("high"), F.lit(0).cast("long").alias("above"), F.lit(few).alias("done"))
    state = written(state.selectExpr(*[f"cast({c.rsplit(' ', 1)[0]} as {c.rsplit(' ', 1)[1]}) {c.rsplit(' ', 1)[0]}" for c in STATE.split(", ")]), "topk-state")

    slices = -(-facts.n // MEET)

    def met(now: DataFrame, last: bool) -> DataFrame:
        """Each block of queries that is still open with each block of rows."""
        open_ = now if last else now.where("not done")
        packed = now.join(open_.select("block").distinct(), "block", "left_semi").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "query", "phase", "score", "low", "high", "above", "done"))).alias("state"))
        held = packed.join(q_blocks, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        side = blocks.select("ids", "data", "width", F.pmod(F.col("number"), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        return side.join(small(held, n_blocks * slices * QUERIES * (facts.width // 4 + 2)), ["block", "slice"]).withColumn("last", F.lit(last)).drop("slice", "block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q, at, n = Meeting(pair).counted(k)
                yield _arrow({"query": q, "bin": at, "n": n}, {"query": pa.int64(), "bin": pa.int64(), "n": pa.int64()})

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                for q, v, s in Meeting(pair).taken(k):
                    yield _arrow({"query": q, "vec_id": v, "score": s}, {"query": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()})

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            yield narrowed(rows_, k)[[c.split()[0] for c in STATE.split(", ")]]

    while state.where("not done").take(1):
        bins = met(state, False).mapInArrow(frugal(count), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))  # BINS rows a query at most
        found = bins.join(state.where("not done").select("query", "above"), "query").withColumn("upto", upto)
        found = found.where((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k)).select("query", "bin", "n", "upto")
        state = written(state.join(found, "query", "left").withColumn("id_low", ends[0]).withColumn("id_high", ends[1]).mapInPandas(narrow, STATE), "topk-state")

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = met(state, True).mapInArrow(frugal(give), "query long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)
    named = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return found.join(named, "query").select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= 10
"""
