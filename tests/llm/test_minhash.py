import random
import re
from collections import Counter

from pyspark.sql import functions as F

from timberline.llm import exact, minhash
from timberline.llm.components import components
from tests.conftest import SMALL


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if len(words) >= width else {tuple(words)}


def brute(rows, percent=80):
    """``doc_id, n_shingles, component_id, kept`` by comparing all pairs; for unique ids."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = got(awkward)
    assert len(found) == len(rows)
    named = [f for f in found if f[0] is not None and f[0] != 3]
    assert sorted(named) == [b for b in brute([r for r in rows if r[0] != 3] + [(3, "a")]) if b[0] != 3]
    assert {f[2:] for f in found if f[0] is None} == {(None, True)}
    assert minhash.near_duplicates(nothing).count() == 0


def test_copies_with_edits(spark):
    """A large group of near copies of all distances, and documents that share a passage."""
    r = random.Random(2)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9, 12, 20])):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:60] + [f"x{r.randrange(10**6)}" for _ in range(r.randrange(20, 200))]) for _ in range(150)]
    texts += ["A b c d"] * 5 + ["a b c", "a b", "a b c", "", None]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == sorted(brute(rows), key=str)


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == sorted(want, key=str)
    assert any(not w[3] for w in want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200 + i, 200) for i in range(1, 50)] + [(300, 300), (None, 5), (401, 400)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(101)} | {200 + i: 200 for i in range(50)} | {400: 400, 401: 400}


def _units(spark, sizes, block, stream):
    """Rows dealt of one group whose components have the given sizes."""
    members = [(7, i, r, 10) for r, n in enumerate(sizes) for i in range(1000 * r * 100, 1000 * r * 100 + n)]
    df = spark.createDataFrame(members, "key long, doc_id long, root long, n long")
    return members, minhash._dealt(df, "key", F.lit(1), block, stream, "doc_id", "root", "n")


def test_every_two_of_different_components_meet_once(spark):
    members, dealt = _units(spark, [40, 25, 9, 1], 7, 20)
    units = {}
    for r in dealt.collect():
        units.setdefault((r.block, r.part), ([], []))[r.streams].append(r)
    met = Counter()
    for held, stream in units.values():
        met.update(frozenset((x.doc_id, y.doc_id)) for x in held for y in stream if x.root != y.root and (y.big or x.doc_id < y.doc_id))
    want = Counter(frozenset((a[1], b[1])) for k, a in enumerate(members) for b in members[:k] if a[2] != b[2])
    assert met == want


def test_rows_under_a_hot_key_grow_as_its_members(spark):
    """20,000 members of one key, nearly all in one component, or in two halves."""
    for sizes, most in (([19_900, 100], 1.01), ([10_000, 10_000], 3.6)):
        for scale in (1, 2):
            counts = [n // 2 * scale for n in sizes]
            assert _units(spark, counts, minhash.BLOCK, minhash.PART)[1].count() <= most * sum(counts)


def test_one_hot_key_with_two_components(spark):
    """Thousands of documents under the same keys, in two components with no link between them, and one that joins some."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    # Each half shares an ending of its own: 78 % of the halves' shingles are common to both.
    rows = [(i, " ".join([*base, *[f"{'ab'[i % 2]}{k}" for k in range(12)], f"u{i}"])) for i in range(3000)]
    rows += [(5000, " ".join([*base, f"v{r.random()}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {f[0]: f[2] for f in got(df)}
    sets = {i: shingles(t) for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert linked(0, 2) and linked(1, 3)
    assert (found[0] == found[1]) == (linked(0, 1) or linked(0, 5000) and linked(1, 5000))
    assert {found[i] for i in range(0, 3000, 2)} == {found[0]} and {found[i] for i in range(1, 3000, 2)} == {found[1]}


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " more"
    pairs = [(1, long), (2, near), (2, "another text of its own"), (None, near + " yet"), (None, "no id and alone here"), (3, "twice the very same row"), (3, "twice the very same row"), (4, ""), (5, None), (None, "null id twice over now"), (None, "null id twice over now")]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in exact.kept_documents(df, minhash.decided(df)).collect()), key=str)
    assert kept == sorted([(1, long), (2, "another text of its own"), (None, "no id and alone here"), (3, "twice the very same row"), (4, ""), (5, None), (None, "null id twice over now")], key=str)
