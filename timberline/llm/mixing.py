"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All DataFrame operations. The text is scanned once; afterwards only (id, source, size) rows move.
A hot source is dealt over ``2 ** 12`` hash buckets, so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import WORD, small, table, words_in, written

CYCLE = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 17


def targets(by_source: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Water-filling over one row per source (``source, skey, source_size``); adds ``weight`` and ``target``.

    Clamping sources at ``epochs`` times their size and resharing the excess by weight ends where every
    unclamped source has the same level (target / weight). With the sources ordered by the level at which
    each is full, that level follows from running sums, so no rounds are needed.
    """
    n = len(cycle)
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % n + 1).cast("int")).cast("long"))
    cap = (epochs * F.col("source_size")).cast("long")
    filled = Window.orderBy(cap / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, on = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(on)
    leveled = ranked.withColumn("level", level).withColumn("open", cap / F.col("weight") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("n_full", "level"))).over(everything)["level"]
    leveled = leveled.withColumn("n_full", F.row_number().over(filled)).withColumn("level", final)
    target = F.least(cap.cast("double"), F.coalesce(F.col("weight") * F.col("level"), cap.cast("double")))
    return leveled.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))).select("source", "skey", "source_size", "weight", "target")


def _skey() -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("!"))


def _draw(seed: int) -> Column:
    """Where a row comes in its source's order; its text counts as well, so that rows of one doc_id are dealt apart."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), text).cast("binary"))


def _placed(docs: DataFrame, cycle: Sequence[int], share: float, epochs: int, seed: int) -> DataFrame:
    """Rows ``doc_id, source, skey, draw, size, source_size, target, whole, extra, twins, shared``.

    ``twins`` counts the rows that are equal to one in id, text and source, ``shared`` is what is taken of them together
    beyond whole repetitions.
    """
    sizes = written(docs.select("doc_id", "source", _skey().alias("skey"), _draw(seed).alias("draw"), words_in(F.col("text")).alias("size")), "mix-sizes")
    sizes = sizes.withColumn("bucket", F.substring("draw", 1, 3))
    buckets = sizes.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    by_source = targets(buckets.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), cycle, share, epochs)
    z, t = F.col("source_size"), F.col("target")
    whole = F.when(z > 0, F.floor(t / z)).otherwise(F.lit(0)).cast("long")
    by_source = by_source.withColumn("whole", whole).withColumn("rest", F.floor(t - F.col("whole") * z).cast("long"))
    so_far = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = buckets.select("skey", "bucket", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("prior"))
    cuts = cuts.join(by_source.drop("source"), "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy("skey", "bucket", "draw", "doc_id", "size")  # as dealt and sorted already
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.withColumn("twins", F.count(F.lit(1)).over(equal)).withColumn("first", F.min("inner").over(equal)).join(cuts, ["skey", "bucket"])

    def taken(most: Column, inner: str) -> Column:
        return F.greatest(F.lit(0), F.least(most, F.col("rest") - F.col("prior") - F.col(inner)))

    return placed.select("doc_id", "source", "skey", "draw", "size", "source_size", "target", "whole", taken(F.col("size"), "inner").alias("extra"), "twins", taken(F.col("twins") * F.col("size"), "first").alias("shared"))


def plan(docs: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, source``): ``doc_id, source, size, source_size, target, taken``.

    Every document of a source gets ``floor(target / source_size)`` whole repetitions. The remaining words are
    taken from its documents in the order of a seeded hash, the last one in part, so each source meets its
    target to the word. Null texts have size 0 and are taken 0 times; a null source is a source of its own,
    ranked last; repeated rows each count; an empty table gives no rows. Other columns are not read.
    """
    placed = _placed(docs, cycle, share, epochs, seed)
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mix(docs: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` as the plan takes them: a row per whole repetition, and one with the first words, joined by single
    spaces, for a part.

    The plan comes to one row a source: its whole repetitions, and the last document that is taken once more. So
    texts stay where they are, and each is compared with its source's row. All columns of ``docs`` stay; ``n_chars``,
    if there, is that of the text in the row. Documents of size 0 are not words of any source and go. Where several
    rows with one doc_id and text are the last of a source, they are put into one and taken as often as the plan takes
    them together. An empty table gives no rows.
    """
    placed = _placed(docs, cycle, share, epochs, seed)
    lowest = F.lit(-(2**63))
    last = F.max(F.when(F.col("extra") > 0, F.struct("draw", F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), "size", "twins", "shared")))
    rule = written(placed.groupBy("skey").agg(F.first("whole").alias("_mix_whole"), last.alias("_mix_last")).withColumnRenamed("skey", "_mix_skey"), "mix-rule")
    known = docs.withColumns({"_mix_key": _skey(), "_mix_size": words_in(F.col("text"))})
    known = known.join(small(rule, rule.count()), F.col("_mix_key") == F.col("_mix_skey")).where("_mix_size > 0")
    mine = F.struct(_draw(seed).alias("draw"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), F.col("_mix_size").alias("size"))
    end = F.struct(F.col("_mix_last.draw"), F.col("_mix_last.doc_id"), F.col("_mix_last.size"))
    place = F.when(F.col("_mix_last").isNull() | (mine > end), F.lit(1)).when(mine < end, F.lit(-1)).otherwise(F.lit(0))
    known = known.withColumn("_mix_place", place)
    size, whole = F.col("_mix_size"), F.col("_mix_whole").cast("int")
    none = F.array().cast("array<bigint>")
    twins, shared = F.col("_mix_last.twins").cast("int"), F.col("_mix_last.shared")
    part = F.when(shared % size > 0, F.array(shared % size)).otherwise(none)
    together = F.concat(F.array_repeat(size, whole * twins + F.floor(shared / size).cast("int")), part)
    alone = F.array_repeat(size, whole + F.when(F.col("_mix_place") < 0, 1).otherwise(0))
    single = (F.col("_mix_place") != 0) | (twins == 1)
    rows = known.where(single).withColumn("_mix_part", F.explode(F.when(F.col("_mix_place") == 0, together).otherwise(alone)))
    if rule.where("_mix_last.twins > 1").take(1):
        again = known.where(~single).dropDuplicates(["_mix_key"])
        rows = rows.unionByName(again.withColumn("_mix_part", F.explode(together)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("_mix_part").cast("int")), " ")
    out = rows.withColumn("text", F.when(F.col("_mix_part") == size, F.col("text")).otherwise(cut))
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}:' || md5(coalesce(text, ''))) AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (
  SELECT *, row_number() OVER f AS k,
    ({SHARE}::DOUBLE * sum(z) OVER () - coalesce(sum({EPOCHS} * z) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM w WINDOW f AS (ORDER BY ({EPOCHS} * z)::DOUBLE / weight, rank)),
v AS (SELECT *, (SELECT arg_min(lev, k) FROM l WHERE ({EPOCHS} * z)::DOUBLE / weight >= lev) AS level FROM l),
t AS (
  SELECT source, z, CASE WHEN z > 0 THEN least(({EPOCHS} * z)::DOUBLE, coalesce(weight * level, ({EPOCHS} * z)::DOUBLE)) ELSE 0.0::DOUBLE END AS target FROM v),
r AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z)::BIGINT ELSE 0 END AS whole FROM t),
p AS (
  SELECT d.*, r.z, r.target, r.whole, floor(r.target - r.whole * r.z)::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, z AS source_size, target, (whole * size + greatest(0, least(size, rest - prior)))::BIGINT AS taken FROM p
"""
