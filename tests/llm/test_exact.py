import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from timberline.llm import exact
from tests.conftest import SMALL
from tests.llm.conftest import SCHEMA, rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(pairs):
    """One row of each group is kept: among rows that only differ in their place, any."""
    groups = {}
    for i, t in pairs:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    seen, out = Counter(), []
    for i, t in pairs:
        group = groups[norm(t)]
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0))
        mine = (-len(t or ""), i is None, i) == best
        out.append((i, best[2], len(group), mine and not seen[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()))
        seen[norm(t)] += mine
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in exact.dedup(df, **options).collect()), key=str)


def test_awkward_rows(awkward, nothing):
    assert got(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert exact.dedup(nothing).count() == 0


def test_colliding_keys_form_chains(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want
    assert got(df, capacity=7) == want
    assert got(df, capacity=1, key=lambda c: F.pmod(F.xxhash64(c), F.lit(5))) == want


def test_directory_doubles(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact.directory(keys, 16)
    assert 8 <= depth <= 14
    held = Counter()
    starts = {r.slot: (r.bucket, r.local) for r in slots.collect()}
    for (key,) in keys.collect():
        slot = (key % 2**64) >> (64 - depth) << (64 - depth)
        bucket, local = starts[slot - 2**64 if slot >= 2**63 else slot]
        assert (key % 2**64) >> (64 - local) << (64 - local) == bucket % 2**64
        held[bucket] += 1
    assert sum(held.values()) == 3000 and max(held.values()) <= 16
    # Neighbours among keys part only at their last bits.
    slots, depth = exact.directory(spark.range(5).withColumnRenamed("id", "key"), 1)
    assert depth == 64 and slots.select("bucket").distinct().count() == 5
    assert exact.directory(spark.range(0).withColumnRenamed("id", "key"))[1] == 0


def test_owners_hold_ranges(spark):
    links = spark.range(2000).select(F.xxhash64("id").alias("key"), F.lit(b"x").alias("sha"), F.lit(1).alias("n"), F.struct(F.lit(0).alias("less"), F.lit(False).alias("none"), F.col("id").alias("doc_id"), F.lit(b"m").alias("mark"), F.col("id").alias("row")).alias("best"))
    slots, depth = exact.directory(links.select("key"), 50)
    index = exact.build_index(links.unionByName(links), slots, depth)
    parts = index.groupBy(F.input_file_name()).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).select("low", "high")
    ranges = sorted(map(tuple, parts.collect()))
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert {(len(r.chain), r.chain[0].n) for r in index.collect()} == {(1, 2)}


def test_kept_documents(spark, awkward):
    kept = exact.kept_documents(awkward, exact.decided(awkward))
    assert kept.columns == awkward.columns
    norms = [norm(r.text) for r in kept.collect()]
    assert len(norms) == len(set(norms)) and set(norms) == {norm(r.text) for r in awkward.collect()}


def test_rows_of_one_id_are_decided_one_by_one(spark):
    pairs = [(1, "copy"), (2, "c opy"), (2, "only A"), (2, "only B"), (None, "copy"), (None, "only C"), (3, "same"), (3, "same"), (3, "same "), (None, None), (4, ""), (None, "twice"), (None, "twice")]
    df = spark.createDataFrame(rows([(i, t, "s") for i, t in pairs]), SCHEMA)
    decided = exact.decided(df).collect()
    assert Counter(r.text_sha256 for r in decided if r.kept) == Counter({r.text_sha256 for r in decided})
    kept = sorted(((r.doc_id, r.text) for r in exact.kept_documents(df, exact.decided(df)).collect()), key=str)
    assert kept == sorted([(2, "c opy"), (2, "only A"), (2, "only B"), (None, "only C"), (3, "same "), (4, ""), (None, "twice")], key=str)
