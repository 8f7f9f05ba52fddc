"""Exact deduplication by an extendible-hash index on shared files.

The index key is a 64-bit hash of the normalised text. Rows are combined within the tasks that read them to chain
links (key, SHA-256 of the text, number of rows, best row). A directory on the leading bits of the keys doubles
until no bucket holds more keys than its capacity. It routes every link to the bucket of its key; owner tasks hold
ranges of buckets, join the links of one text there, chain different texts under one key, and write their buckets as
files. Each row finds its link again through the directory, its bucket and its key. The bytes of all texts of a link
are compared. A hot group sends one link per reading task, and its rows are looked up by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import WHITE, small, table, written

#: Keys in a bucket before it is split.
CAPACITY = 4096
#: Bits that the directory has beyond those that even buckets would need, and that it grows by if that is too few.
SPARE, MORE = 3, 8
LINK = "struct<sha:binary,n:bigint,best:struct<less:int,none:boolean,doc_id:bigint,mark:binary,row:bigint>>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", "")


def mark(text: Column) -> Column:
    """What tells a row's whole text from others in 16 bytes; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def first_key(key: Column, depth: Column | int) -> Column:
    """The first key (in unsigned order) that has the ``depth`` leading bits of ``key``."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    rest = (64 - depth).cast("int")
    cut = F.call_function("shiftleft", F.call_function("shiftrightunsigned", key, rest), rest)
    return F.when(depth > 0, cut).otherwise(F.lit(0).cast("long"))  # a shift by 64 is one by 0


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory over distinct keys (``key``): rows ``slot, bucket, local``, and its depth.

    A slot stands for the keys with its ``depth`` leading bits, a bucket for those with its ``local`` ones; both are
    named by their first key. A bucket that holds more than ``capacity`` keys is split by its next bit; where it has
    as many bits as the directory, that doubles. Only slots that hold a key have a row, so the depth has no cap and
    nothing of it comes to the driver.
    """
    n = keys.count()
    depth = (max(n - 1, 0) // capacity).bit_length()
    depth = depth + SPARE if depth else 0
    while True:
        slots = written(keys.groupBy(first_key(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "exact-slots")
        if depth >= 64 or not slots.where(F.col("n") > capacity).take(1):
            break
        depth = min(64, depth + MORE)
    levels = slots.withColumn("local", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("bucket", first_key(F.col("slot"), F.col("local")))
    fits = levels.groupBy("local", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("local") == depth)).drop("held")
    found = levels.join(fits, ["local", "bucket"]).groupBy("slot").agg(F.min(F.struct("local", "bucket")).alias("b"))
    found = written(found.select("slot", "b.bucket", "b.local"), "exact-directory")
    used = found.agg(F.max("local")).first()[0] or 0  # bits beyond the deepest bucket's tell nothing
    return found.select(first_key(F.col("slot"), used).alias("slot"), "bucket", "local").distinct(), used


def routed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows`` (with ``key``) and the ``bucket`` that the directory names for each."""
    known = slots.select(F.col("slot").alias("_slot"), "bucket")
    return rows.join(small(known, slots.count()), first_key(F.col("key"), depth) == F.col("_slot")).drop("_slot")


def build_index(links: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The index on shared files: rows ``bucket, key, chain``, one owner task for each range of buckets.

    ``links``: ``key, sha, n, best``, several for one text. Range partitioning by bucket serves both groupings, so
    that links move once; a chain has one link for each text.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = routed(links, slots, depth).repartitionByRange(parts, "bucket")
    texts = owned.groupBy("bucket", "key", "sha").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    chains = texts.groupBy("bucket", "key").agg(F.sort_array(F.collect_list(F.struct("sha", "n", "best").cast(LINK))).alias("chain"))
    return written(chains.sortWithinPartitions("bucket", "key"), "exact-index")


def same_bytes(docs: DataFrame, index: DataFrame, key: Callable[[Column], Column]) -> None:
    """Compare the normalised bytes of all rows in links of two rows or more: their least and greatest text must agree."""
    many = written(index.where(F.exists("chain", lambda c: c["n"] > 1)).select("key"), "exact-many")
    text = normalised(F.col("text"))
    rows = docs.select(text.alias("norm")).withColumn("key", key(F.col("norm")))
    rows = rows.join(small(many, many.count()), "key", "left_semi").withColumn("sha", F.sha2("norm", 256))
    odd = rows.groupBy("key", "sha").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high")
    if odd.select("sha").take(1):
        raise ValueError("different texts have one SHA-256")


def decided(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """What ``dedup`` returns, and ``mark`` of each row's whole text, which names the row together with its doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    norm = docs.select("doc_id", mark(F.col("text")).alias("mark"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), normalised(F.col("text")).alias("norm"))
    entries = norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", "mark", "chars", key(F.col("norm")).alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    entries = written(entries, "exact-entries")  # numbers of rows stay what they are
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    links = entries.groupBy(F.shiftright("row", 33).alias("task"), "key", "sha").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    links = written(links.drop("task"), "exact-links")
    slots, depth = directory(links.select("key").distinct(), capacity)
    index = build_index(links, slots, depth)
    same_bytes(docs, index, key)
    found = routed(entries, slots, depth).join(index, ["bucket", "key"])
    found = found.withColumn("link", F.filter("chain", lambda c: c["sha"] == F.col("sha"))[0])
    return found.select("doc_id", F.col("link.best.doc_id").alias("keep_id"), F.col("link.n").alias("group_size"), (F.col("row") == F.col("link.best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "mark")


def dedup(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are so without ASCII white space; null counts as empty, and all empty texts are
    one group. The row with most code points stays, then the smallest doc_id, a null one last. Exactly one row of a
    group is kept, also where rows repeat a doc_id or are equal throughout. An empty table gives no rows; other
    columns are not read. ``key`` can be a weaker hash, as in tests: chains then get longer, results stay.
    """
    return decided(docs, capacity, key).drop("mark")


def kept_documents(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (``doc_id, mark, kept``, one for each of them) keep; all columns stay.

    A decision belongs to the rows with its doc_id, null being an id like any other, and its text. Of rows that agree
    in both as many stay as are kept, one in all: which of them cannot be told. Rows of one doc_id with different
    texts go or stay by themselves. An empty table gives no rows.
    """
    pairs = decisions.groupBy("doc_id", "mark").agg(F.sum(F.col("kept").cast("int")).alias("_stay"), F.count(F.lit(1)).alias("_rows"))
    pairs = written(pairs.where("_stay < _rows").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark_of"), "_stay"), "dropped")
    again = pairs.where("_stay > 0").count()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("doc_id")]
    rows = docs.toDF(*names).withColumn("_mark", mark(F.col(names[docs.columns.index("text")])))
    rows = rows.join(small(pairs, pairs.count()), F.col(at).cast("long").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_mark_of")), "left")
    kept = rows.where("_stay is null").select(*names)
    if again:
        kept = kept.unionByName(rows.where("_stay > 0").dropDuplicates([at, "_mark"]).select(*names))
    return kept.toDF(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, sha256(regexp_replace(coalesce(text, ''), '[{WHITE}]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
