import random
import re
from collections import defaultdict

import numpy as np
import pytest

from timberline.llm import borders, passages
from timberline.llm.shingles import word_hashes
from tests.conftest import SMALL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_paragraphs(text, least):
    """First word and end of each paragraph of a text, line by line."""
    lines = [w for w in map(words, (text or "").split("\n")) if w]
    out, at, k = [], 0, 0
    while k < len(lines):
        run = [lines[k]]
        while len(run[0]) < least and k + len(run) < len(lines) and len(lines[k + len(run)]) < least:
            run.append(lines[k + len(run)])
        k, left, start = k + len(run), sum(map(len, run)), at
        whole = left >= least
        for w in run:
            if at - start >= least and left >= least and word_hashes([w[0].encode()])[0][0] % passages.OPENS == 0:
                out.append((start, at))
                start = at
            at, left = at + len(w), left - len(w)
        if whole:
            out.append((start, at))
    return out


def brute_paragraphs(rows, least=25, width=5, percent=80):
    """Paragraphs in components over several documents, with the smallest document, from all pairs."""
    units = []
    for i, t in rows:
        w = words(t)
        for a, b in plain_paragraphs(t, least):
            units.append((i, a, b, {tuple(w[k : k + width]) for k in range(a, b - width + 1)}))
    root = list(range(len(units)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = defaultdict(list)
    for k, u in enumerate(units):
        for s in u[3]:
            where[s].append(k)
    for a, b in {(a, b) for ks in where.values() for a in ks for b in ks if a < b}:
        x, y = units[a][3], units[b][3]
        if 100 * len(x & y) >= percent * len(x | y):
            root[find(b)] = find(a)
    groups = defaultdict(list)
    for k, u in enumerate(units):
        groups[find(k)].append(u[:3])
    return {(i, a, b, min(g)[0]) for g in groups.values() if len({u[0] for u in g}) > 1 for i, a, b in g}


def parts(found, kind):
    return {(r.doc_id, r.begin, r.end, r.keep_id) for r in found if r.kind == kind}


def test_paragraphs_and_inline_passages(spark):
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    base, inline = fresh(60), fresh(51)
    rows = []
    for i in range(120):
        line = list(base)
        for _ in range(r.randrange(0, 3)):
            line[r.randrange(60)] = "Edited"
        text = " ".join(fresh(r.randrange(5, 60)))
        if i % 4 == 0:
            text += "\n" + " ".join(line) + "\n" + " ".join(fresh(20))
        if i % 4 == 1:
            text += " " + " ".join(inline[:30]) + "\n" + " ".join(inline[30:]) + " " + " ".join(fresh(12))
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = passages.repeated_passages(df).collect()
    assert parts(found, "paragraph") == brute_paragraphs(rows)
    ids = {r.doc_id for r in found}
    assert {w[0] for w in brute_paragraphs(rows)} <= ids <= {i for i, _ in rows if i % 4 < 2}
    inline_rows = [r for r in found if r.kind == "stretch" and r.doc_id % 4 == 1]
    assert {r.doc_id for r in inline_rows} == {i for i, _ in rows if i % 4 == 1}
    assert all(r.keep_id == 1 and r.kept == (r.doc_id == 1) for r in inline_rows)


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = passages.repeated_passages(df).collect()
    want = brute_paragraphs(rows)
    got = parts(found, "paragraph")
    assert {g[:3] for g in got} <= {w[:3] for w in want} and len(got) >= 0.98 * len(want)
    where = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 50):
            where[tuple(w[k : k + 51])].add(i)
    assert {i for ids in where.values() if len(ids) > 1 for i in ids} <= {r.doc_id for r in found}


def test_awkward_rows(awkward, nothing):
    found = passages.repeated_passages(awkward).collect()
    assert {r.doc_id for r in found} == {6, 7}
    assert passages.repeated_passages(nothing).count() == 0


@pytest.mark.parametrize(("percent", "rows"), [(80, 3), (60, 2), (90, 5)])
def test_bands_reach_the_recall(percent, rows):
    bands = passages.tuned(percent, rows, 0.99)
    hit = lambda b: 1 - (1 - (percent / 100) ** rows) ** b
    assert hit(bands) >= 0.99 > hit(bands - 1)


def brute_words(rows, least, earlier):
    """Words of each document within ``least`` words that an earlier (or any other) document has, by all runs of words."""
    where, out = defaultdict(set), defaultdict(set)
    texts = {i: words(t) for i, t in rows}
    for i, w in texts.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    for i, w in texts.items():
        for k in range(len(w) - least + 1):
            if any(j < i if earlier else j != i for j in where[tuple(w[k : k + least])]):
                out[i] |= set(range(k, k + least))
    return dict(out)


def reported(found, kept=(False, True)):
    out = defaultdict(set)
    for r in found:
        if r.kind == "stretch" and r.kept in kept:
            out[r.doc_id] |= set(range(r.begin, r.end))
    return dict(out)


@pytest.mark.parametrize("chunk", [8192, 3])
def test_stretches_reach_the_borders(spark, monkeypatch, chunk):
    monkeypatch.setattr(borders, "CHUNK", chunk)
    monkeypatch.setattr(borders, "BLOCKED", 5)
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, i = [], 0
    for length in [51, 51, 52, 60, 77, 120, 200] * 3:
        passage = fresh(length)
        for _ in range(r.randrange(2, 5)):
            before, behind = fresh(r.choice([0, 3, 40])), fresh(r.choice([0, 2, 70]))
            rows.append((i := i + 1, " ".join(before + passage + behind)))
    for _ in range(12):  # later documents share more than the first, on either side or both
        passage = fresh(160)
        for _ in range(6):
            low, high = r.randrange(0, 55), r.randrange(106, 161)
            rows.append((i := i + 1, " ".join(fresh(r.randrange(0, 9)) + passage[low:high] + fresh(r.randrange(0, 9)))))
    passage = fresh(55)
    rows += [(i + 1 + k, " ".join(fresh(8) + passage + fresh(8))) for k in range(60)]  # a common one
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = passages.repeated_passages(df).collect()
    assert reported(found, [False]) == brute_words(rows, 51, True)
    assert reported(found) == brute_words(rows, 51, False)


def test_repeated_words_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for kept, earlier in (([False], True), ([False, True], False)):
        got, must, can = reported(found, kept), brute_words(rows, 51, earlier), brute_words(rows, 25, earlier)
        assert all(must[i] <= got.get(i, set()) for i in must) and all(got[i] <= can.get(i, set()) for i in got)


def test_keepers_have_the_words_they_keep(spark):
    """Each word that can be cut stands in its keeper, in a run of 25; none is short of a passage with what it overlaps."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = {i: words(t) for i, t in rows}
    found = [r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == "stretch"]
    held = {i: " " + " ".join(w) + " " for i, w in texts.items()}
    assert found
    for r in [r for r in found if not r.kept]:
        ahead = set()
        for k in range(r.begin, r.end - 24):
            if " " + " ".join(texts[r.doc_id][k : k + 25]) + " " in held[r.keep_id]:
                ahead |= set(range(k, k + 25))
        assert r.keep_id < r.doc_id and ahead == set(range(r.begin, r.end))
    assert all(r.keep_id == r.doc_id for r in found if r.kept)
    for i, ks in reported(found).items():
        run = 0
        for k in range(len(texts[i]) + 1):
            assert k in ks or run == 0 or run >= passages.PASSAGE
            run = run + 1 if k in ks else 0


@pytest.mark.parametrize("texts", [["one two\nthree\n\nfour", "", "\n", "a", " x\ny z "], ["\n\n", "last line\n"], [""]])
def test_lines_of_texts(texts):
    found, first, owner, begin, end = passages._lines([t.encode() for t in texts], 1)
    got = [(int(o), int(b - first[o]), int(e - b)) for o, b, e in zip(owner, begin, end, strict=True)]
    want = []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            n = len(words(line))
            want += [(i, at, n)] if n else []
            at += n
    assert got == want and len(found) == sum(len(words(t)) for t in texts)


@pytest.mark.parametrize("least", [1, 4, 25])
def test_short_lines_are_joined(least):
    r = random.Random(least)
    texts = ["", "\n\n", "a b c"] + ["\n".join(" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([0, 1, 3, 9, 12, 30]))) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    _, first, text, begin, end = passages._lines([t.encode() for t in texts], least)
    got = [(int(o), int(b - first[o]), int(e - first[o])) for o, b, e in zip(text, begin, end, strict=True)]
    assert got == [(i, a, b) for i, t in enumerate(texts) for a, b in plain_paragraphs(t, least)]


def test_lists_of_short_lines_are_near_copies(spark):
    """Two lists of short lines, one line of which is another, in other surroundings, are of one component."""
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(10**7)}" for _ in range(9))
    shared, rows = [line() for _ in range(40)], []
    for i in range(6):
        mine = list(shared)
        mine[5 + i] = line()
        rows.append((i, "\n".join([line() for _ in range(i)] + mine + [line()])))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert parts(found, "paragraph") == brute_paragraphs(rows)
    assert {r.doc_id for r in found if r.kind == "paragraph"} == set(range(6))


def test_components_of_stretches(spark):
    """Rows that share a passage are of one component; rows of one component hang together by shared or overlapping words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = {i: words(t) for i, t in rows}
    found = [r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == "stretch"]

    def grouped(least):
        root = list(range(len(found)))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        held = {}
        for k, r in enumerate(found):
            for at in range(r.begin, r.end - least + 1):
                root[find(k)] = find(held.setdefault(tuple(texts[r.doc_id][at : at + least]), k))
            for at in range(r.begin, r.end + 1):
                root[find(k)] = find(held.setdefault((r.doc_id, at), k))
        return [find(k) for k in range(len(found))]

    component = [r.component for r in found]
    assert len(set(zip(grouped(passages.PASSAGE), component, strict=True))) == len(set(grouped(passages.PASSAGE)))
    assert len(set(zip(grouped(passages.LEAST), component, strict=True))) == len(set(component)) > 1


def test_ends_of_chunks_in_blocks(spark, monkeypatch):
    """Ends of many chunks, some of which share all or no words, against a loop over all of them."""
    reach, r = 3, np.random.default_rng(2)
    words = sorted({(int(r.integers(3)), bool(r.integers(2)), r.integers(1, 3, reach).astype(np.uint32).tobytes()) for _ in range(400)})
    cuts = sorted({0, len(words), *(int(c) for c in r.integers(1, len(words), 17))})
    docs = r.permutation(len(words))
    share = lambda a, b, level: a[:2] == b[:2] and a[2][: 4 * level] == b[2][: 4 * level]
    rows, want = [], {}
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        name, ends = f"c{low}", []
        for at in (low, high - 1):
            for inside in (range(low, high), range(len(words))):
                alike = [[int(docs[i]) for i in inside if share(words[i], words[at], level)] for level in range(reach + 1)]
                ends.append([[min(a) for a in alike], [max(a) for a in alike]])
        rows.append((name, *words[low], *words[high - 1], *ends[0], *ends[2]))
        want[name] = (*ends[1], *ends[3])
    for size in (2, 3, 4096):
        monkeypatch.setattr(borders, "BLOCKED", size)
        found = borders._ends(spark.createDataFrame(rows, borders.RECORD), reach).collect()
        assert {f.chunk: (f.first_low, f.first_high, f.last_low, f.last_high) for f in found} == want
