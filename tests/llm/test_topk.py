from math import floor, isfinite

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from timberline.llm import common, topk

SCHEMA = "vec_id long, embedding array<double>, query long, score string, rank string, block string"


def brute(pairs, k, wanted):
    fine = [(i, [x if abs(x) > 2.0**53 else floor(1024 * x) for x in v], [abs(x) > 2.0**53 for x in v]) for i, v in pairs if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    fine = [(i, [int(x) * 1024 if big else x for x, big in zip(v, bigs, strict=True)]) for i, v, bigs in fine]
    out = []
    for at, (i, q) in enumerate(fine):
        if not wanted(i):
            continue
        each = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=False)))), j) for place, (j, c) in enumerate(fine) if place != at]
        each = sorted(each, key=lambda e: (-e[0], e[1]))[:k]
        out += [(i, rank, j, score) for rank, (score, j) in enumerate(each, 1)]
    return sorted(out)


def table(spark, pairs):
    return spark.createDataFrame([(i, v, 1, "s", "r", "b") for i, v in pairs], SCHEMA)


def got(df, k=10):
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, k).collect()))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    pairs = [(0, [1.0, -0.5]), (0, [1.0, -0.5]), (100, []), (200, [0.001]), (None, [1.0]), (1, None), (2, [None, 1.0]), (3, [nan]), (4, [inf, 1.0]), (5, [-inf])]
    pairs += [(6, [0.3, 0.3, 0.3]), (-(2**63), [0.5, 0.5]), (2**63 - 1, [0.5, 0.5]), (-100, [1e300, 1.0]), (300, [-1e300]), (7, [2.0**60, 3.0]), (8, [2.0**40 + 0.5, -1.0])]
    assert got(table(spark, pairs), 4) == brute(pairs, 4, lambda i: i % 100 == 0)
    for few in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, None), (100, [nan])]):
        assert got(table(spark, few)) == []


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_equal_scores(spark, monkeypatch, broadcast):
    """A third of the vectors are one, and another third share one score; ids decide, also where many rows have one id."""
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "AT_ONCE", 50)
    monkeypatch.setattr(topk, "MEET", 2)
    monkeypatch.setattr(topk, "BINS", 16)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    random = np.random.default_rng(1)
    pairs = [(int(i), [0.5, 0.5, 0.25]) for i in range(0, 900, 3)] + [(int(i), [0.5, float(x), 0.0]) for i, x in zip(range(1, 900, 3), random.random(300), strict=True)]
    pairs += [(7, [2.0, 0.0, 0.0])] * 150 + [(int(i) - 5000, random.normal(size=3).tolist()) for i in range(150)]
    assert got(table(spark, pairs).repartition(5), 10) == brute(pairs, 10, lambda i: i % 100 == 0)


def test_query_and_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    df = topk.op11_topk(spark, SMALL)
    found = con.execute(topk.SQL)
    assert [d[0] for d in found.description] == df.columns
    want = sorted(found.fetchall())
    assert sorted(map(tuple, df.collect())) == want and len(want) == 50
    pairs = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert want == brute(pairs, 10, lambda i: i % 100 == 0)
