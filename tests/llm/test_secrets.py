import hashlib
import random
import re

import pytest

from timberline.llm import secrets
from tests.conftest import SMALL

KINDS = ["assign", "access", "hex"]


def brute(text):
    """The contract's base spans, by the regexes as they are written there."""
    text, found = text or "", []
    word = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for order, (pattern, group, least) in enumerate([(word, 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]):
        found += [(m.start(), order, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(found)




def expected(texts):
    out = []
    for i, text in texts:
        spans = brute(text)
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        out.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(df).collect()), key=str)


def noise(n, seed=5):
    r = random.Random(seed)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", '"', "'", "é", "\n", "AKIA", "ABCDEF0123", "deadbeef", "0123456789abcdef", "abc", "value-123=", "/+", "日"]
    return [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(n)]


def test_against_brute_force(spark):
    texts = noise(400)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(df) == expected(texts)


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want


def test_awkward_rows(spark, awkward, nothing):
    assert got(awkward) == expected([(r.doc_id, r.text) for r in awkward.collect()])
    assert secrets.scan(nothing).count() == 0


@pytest.mark.parametrize("rule", [*secrets.BASE, *secrets.MORE], ids=lambda r: r.kind)
def test_queries_hold_for_every_match(rule):
    query = secrets.trigram_query(rule.pattern)

    def holds(q, text):
        if q is True:
            return True
        if isinstance(q, str):
            return q in text
        return (all if q[0] == "and" else any)(holds(p, text) for p in q[1:])

    texts = [t for _, t in noise(300)] + ["ghp_" + "a" * 40, "xoxb-1234567890ab", "AIza" + "b" * 35, "eyJa.eyJb.c", "-----BEGIN RSA PRIVATE KEY-----"]
    for text in texts:
        for m in re.finditer(rule.pattern, text):
            assert holds(query, m[0].lower())
    assert (query is True) == (rule.kind == "hex")


def test_more_spans_are_added(spark):
    df = spark.createDataFrame([(1, "k ghp_" + "a" * 40 + " é -----BEGIN PRIVATE KEY-----")], "doc_id long, text string")
    row = secrets.scan(df).first()
    assert row.spans == "forge:2:46,hex:6:46,private:49:76"
    assert row.n_hex == 1


def test_terms_of_a_text(spark):
    """The one pass finds just the trigrams that a text holds."""
    terms = sorted(set().union(*(secrets.terms_of(secrets.trigram_query(r.pattern)) for r in [*secrets.BASE, *secrets.MORE])))
    texts = [(i, t) for i, t in [*noise(300, 8), (300, " ".join(terms)), (301, None), (302, "")]]
    found = secrets.postings(spark.createDataFrame(texts, "doc_id long, text string"), terms).collect()
    want = [(t, i) for i, text in texts for t in terms if t in (text or "").lower()]
    assert sorted(map(tuple, found)) == sorted(want)


def test_many_matches_in_one_text(spark):
    """A dump of 100,000 hex runs and one of as many assignments, each in seconds."""
    import time

    run = "0123456789abcdef"
    texts = [(1, "\n".join(f"{run} é" for _ in range(100_000))), (2, " ".join("Token=abcdefghijklmnop" for _ in range(100_000))), (3, "eyJ" * 200_000), (4, "-----BEGIN " * 50_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    secrets.scan(df.limit(1)).count()
    start = time.monotonic()
    found = secrets.scan(df).collect()
    assert time.monotonic() - start < 30
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found), key=str) == expected(texts)
