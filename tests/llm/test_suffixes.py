import random
import re
from collections import defaultdict

import numpy as np

from timberline.llm import suffixes
from tests.conftest import SMALL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least):
    """Words of each document that lie in a run of ``least`` words which occurs twice or more."""
    where = defaultdict(list)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].append((i, k))
    out = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                out[i] |= set(range(k, k + least))
    return dict(out)


def covered(found):
    out = defaultdict(set)
    for r in found:
        assert r.n_words == r.end - r.begin
        out[r.doc_id] |= set(range(r.begin, r.end))
    return dict(out)


def test_passages(spark):
    """Passages in random texts, some very common, over many tasks; every word of every repeat, and no other."""
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    hot, rare = fresh(60), [fresh(n) for n in (50, 51, 75, 120, 49)]
    rows = []
    for i in range(300):
        w = fresh(r.randrange(0, 150))
        if i % 3 == 0:
            w[r.randrange(len(w) + 1) : 0] = hot
        w += r.choice(rare) + fresh(r.randrange(0, 30)) if i % 5 == 0 else []
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = suffixes.repeats(df).collect()
    assert covered(found) == brute(rows, 50)
    # What is cut leaves one occurrence of each repeat.
    cut = covered([f for f in found if not f.kept])
    left = defaultdict(int)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if not set(range(k, k + 50)) & cut.get(i, set()):
                left[tuple(w[k : k + 50])] += 1
    assert max(left.values()) == 1 and left[tuple(hot[:50])] == 1


def test_strangers_between(spark):
    """Parts of one long passage, cut anywhere: rows that share more to the right part those that share the left."""
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    base = fresh(140)
    rows = []
    for i in range(400):
        low = r.randrange(0, 90)
        rows.append((i, " ".join(fresh(r.randrange(20)) + base[low : low + r.randrange(20, 70)] + fresh(r.randrange(20)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffixes.repeats(df).collect()
    assert covered(found) == brute(rows, 50)
    again = suffixes.repeats(df.repartition(2)).collect()
    spans = lambda f: sorted((r.doc_id, r.begin, r.end, r.kept) for r in f)
    assert spans(found) == spans(again)


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, got = brute(rows, 50), covered(suffixes.repeats(df).collect())
    assert set(got) <= set(want) and all(got[i] <= want[i] for i in got)
    assert got == want


def test_awkward_rows(awkward, nothing):
    found = suffixes.repeats(awkward).collect()
    rows = [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None]
    assert {f.doc_id for f in found} == set(brute(rows, 50))
    assert suffixes.repeats(nothing).count() == 0


def test_minimisers_cover_every_window():
    r = np.random.default_rng(1)
    hashes = r.integers(1, 50, 400).astype(np.uint64)
    owner = np.repeat([0, 1, 2, 3], [5, 120, 200, 75])
    for window in (1, 7, 43):
        at = set(suffixes.minimisers(hashes, owner, window, np.ones(400, bool)).tolist())
        want = set()
        for i in range(400 - window + 1):
            if owner[i] == owner[i + window - 1]:
                low = hashes[i : i + window].min()
                want |= {i + k for k in range(window) if hashes[i + k] == low}
        assert at == want
