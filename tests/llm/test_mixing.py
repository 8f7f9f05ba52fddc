from collections import defaultdict

import duckdb
import pytest

from timberline.llm import mixing
from tests.conftest import SMALL


def filled(sizes, cycle=(3, 1, 2), share=1.5, epochs=2):
    """Clamp and reshare until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        now = {s: (left - sum(full.values())) * weight[s] / total for s in rest}
        above = [s for s in rest if now[s] > epochs * sizes[s]]
        if not above:
            return full | now
        full |= {s: float(epochs * sizes[s]) for s in above}


def check(df):
    rows = [r.asDict() for r in mixing.plan(df).collect()]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    if rows:
        want = filled(sizes)
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    return rows


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = check(df), check(df.repartition(3))
    key = lambda r: r["doc_id"]
    assert sorted(a, key=key) == sorted(b, key=key)


def test_awkward_rows(awkward, nothing):
    assert len(check(awkward)) == awkward.count()
    assert check(nothing) == []


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({mixing.SQL})").fetchall())
    assert sorted(tuple(r) for r in mixing.op7_mix(spark, SMALL).select(names).collect()) == want


def test_mixed_rows_hold_the_words_taken(spark, awkward):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), awkward):
        words = sum(len((r.text or "").split()) for r in mixing.mix(df).collect())
        assert words == sum(r.taken for r in mixing.plan(df).collect())
        assert mixing.mix(df).columns == df.columns


def test_equal_rows_are_mixed_as_planned(spark):
    """Sources of many rows that are equal, or share an id, or have none: words come out as planned, for several seeds."""
    pairs = [(1, "a b c d e", "x")] * 7 + [(2, "f g h", "y")] * 3 + [(None, "one two", "y")] * 4 + [(2, "i j k l", "z"), (2, "m n", "z"), (None, None, "z")]
    df = spark.createDataFrame(pairs, "doc_id long, text string, source string").repartition(3)
    for seed in range(4):
        taken, words = defaultdict(int), defaultdict(int)
        for r in mixing.plan(df, seed=seed).collect():
            assert r.taken <= 2 * r.size
            taken[r.source] += r.taken
        for r in mixing.mix(df, seed=seed).collect():
            words[r.source] += len(r.text.split())
        assert {s: n for s, n in taken.items() if n} == words
