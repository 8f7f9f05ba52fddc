import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.conftest import SCHEMA, rows
from timberline.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(shown, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def climb(hashes):
    """All levels of a tree, and of each leaf its siblings by level."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for at in range(len(hashes)):
        way = []
        for nodes in levels[:-1]:
            low = at // 3 * 3
            way.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 3])))
            at //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute(found):
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(by[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append((mine, *climb([leaf(r, r.text) for r in mine])))
    if not trees:
        return []
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, ways), top in zip(trees, tops, strict=True):
        for r, way in zip(mine, ways, strict=True):
            cut = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            acc = leaf(r, r.text.replace("\n", "") if cut else r.text)
            for left, right in way + top:
                acc = sha(left + acc + right)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha("".join(a + b for a, b in way + top)), acc, acc == root))
    return sorted(out, key=str)


def got(df):
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return sorted((tuple(r) for r in manifest.manifest(df, tampered={"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}).collect()), key=str)


def test_awkward_rows(awkward, nothing):
    assert got(awkward) == brute(awkward.collect())
    assert got(nothing) == []


@pytest.mark.parametrize("height", [1, 2, 7])
def test_sources_of_all_sizes(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "ROWS", 20)
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "c": 9, "d": 10, "é": 28, "日": 82, "Z": 5, "q": 27}
    pairs = [(1000 * k - i, None if i % 7 == 3 else f"text {i}\nline", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    want = brute(df.collect())
    assert got(df.repartition(3)) == want
    assert {r[-1] for r in want} == {True, False}


def test_one_row_is_its_own_root(spark):
    df = spark.createDataFrame(rows([(5, "x\ny", "s")]), SCHEMA)
    (row,) = got(df)
    assert row[1] == row[2] == row[3] and row[4] == sha("") and row == brute(df.collect())[0]


def test_repeated_rows(spark):
    df = spark.createDataFrame(rows([(1, "same", "s")] * 7 + [(1, "other", "s"), (None, "same", "s"), (None, None, None)]), SCHEMA)
    assert got(df) == brute(df.collect())


def test_query_and_its_sql(spark):
    df = manifest.op12_manifest(spark, SMALL)
    want = brute(spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert sorted(map(tuple, df.collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = con.execute(manifest.SQL)
    assert [d[0] for d in found.description] == df.columns
    assert sorted(found.fetchall(), key=str) == want
