import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SMALL
from tests.llm.conftest import SCHEMA, rows
from timberline.llm import runs


def brute(words):
    """Each period's maximal stretches by comparing all words; a stretch that a smaller period has as well is not one."""
    number = {}
    ids, found = np.array([number.setdefault(w, len(number)) for w in words], int), {}
    for q in range(1, len(ids) // 4 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edges[::2], edges[1::2]
        long = end - begin + q >= max(6, 4 * q)
        for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            found.setdefault((i, j - i + q), q)
    return sorted((a, b, q) for (a, b), q in found.items())


def row_of(doc_id, text, changed):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if changed and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for a, b, q in found for i in range(a + q, a + b)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{a},{b},{q}\n" for a, b, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def check(df, changed=True):
    got = sorted((tuple(r) for r in runs.collapsed(df, changed).collect()), key=str)
    assert got == sorted((row_of(r.doc_id, r.text, changed) for r in df.select("doc_id", "text").collect()), key=str)
    return got


def found_in(texts):
    ids = np.array([i for t in texts for i in t], np.int64)
    return [tuple(r) for r in runs.runs(ids, np.cumsum([0, *map(len, texts)])).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_texts_of_few_words(texts):
    assert found_in(texts) == [(i, *r) for i, t in enumerate(texts) for r in brute(t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(2, 9), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 11))
def test_planted_runs(before, part, times, after, cut):
    text = before + part * times + part[: cut % len(part)] + after
    assert found_in([text, [], text[::-1]]) == [(i, *r) for i, t in enumerate([text, [], text[::-1]]) for r in brute(t)]


def test_parts_of_a_level(monkeypatch):
    monkeypatch.setattr(runs, "PERIODS", 7)
    texts = [[1, 2] * 9, [5] * 40, list(range(30)), [1, 2, 3] * 5 + [9] * 7, [4] * 5]
    assert found_in(texts) == [(i, *r) for i, t in enumerate(texts) for r in brute(t)]


def test_a_long_run_and_thue_morse_words():
    text = [0] * 20_000
    assert found_in([text]) == [(0, 0, 20_000, 1)]
    word = [0]
    for _ in range(13):
        word += [1 - i for i in word]
    assert found_in([word]) == []  # no stretch of it holds three periods
    assert found_in([word[:3000] * 4]) == [(0, 0, 12_000, 3000)]


def test_awkward_rows(awkward, nothing):
    check(awkward)
    check(awkward, changed=False)
    assert runs.collapsed(nothing).count() == 0


def test_repeated_ids_white_space_and_long_periods(spark, monkeypatch):
    monkeypatch.setattr(runs, "WORDS", 50)
    texts = ["a\x0bb " * 8, " \x1c \x85 " * 7, "x" * 3 + " y" * 9, ("p q r s " * 4).strip(), "ä ö " * 6 + "ä", "a a a a a", "a a a a a a", None, ""]
    df = spark.createDataFrame(rows([(i // 2, t, "s") for i, t in enumerate(texts * 4)] + [(None, "z " * 8, None)]), SCHEMA)
    got = check(df)
    assert max(r[1] for r in got) >= 1
    check(df, changed=False)


def test_query(spark):
    got = sorted(map(tuple, runs.op13_runs(spark, SMALL).collect()), key=str)
    assert got == sorted((row_of(r.doc_id, r.text, True) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), key=str)
