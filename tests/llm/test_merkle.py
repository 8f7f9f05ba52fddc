import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SMALL
from timberline.llm import merkle


def sha(kind, content):
    return hashlib.sha256((kind + content).encode()).hexdigest()


def tree(text):
    """Root, sections and paragraphs of a plain Merkle tree: (hash, [(hash, [(hash, [leaf])])])."""
    sections = []
    for section in text.split("\n\n"):
        paragraphs = []
        for paragraph in section.split("\n"):
            kept = [sha("s", s) for s in re.split(r"(?<=[.!?]) ", paragraph)]
            paragraphs.append((sha("p", "".join(kept)), kept))
        sections.append((sha("c", "".join(p[0] for p in paragraphs)), paragraphs))
    return sha("r", "".join(s[0] for s in sections)), sections


def shown(text):
    root, sections = tree(text)
    return root + ":" + "".join(s[:16] + "[" + "".join(p[:16] + "(" + ",".join(x[:12] for x in kept) + ")" for p, kept in ps) + "]" for s, ps in sections)


def near(a, b):
    x, y = (Counter(leaf for _, ps in tree(t)[1] for _, kept in ps for leaf in kept) for t in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total())


def places(a, b):
    x, y = ([[p[0] for p in s[1]] for s in tree(t)[1]] for t in (a, b))
    out = []
    for i in range(max(len(x), len(y))):
        p, q = x[i] if i < len(x) else [], y[i] if i < len(y) else []
        out += [(i + 1, j + 1) for j in range(max(len(p), len(q))) if p[j : j + 1] != q[j : j + 1]]
    return out


def order(rows):
    """Rows as the operator follows them: descending ids, null last, then by the hash of the text."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).digest()[:16]))


def expected(rows):
    ordered = [(i, t or "") for i, t in order(rows)]
    out = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(text), shown(edited), round(near(text, edited), 12), round(near(text, after), 12), tuple(places(text, edited))))
    return sorted(out, key=str)


def got(df):
    found = merkle.compare(df).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12), tuple(map(tuple, r.changed))) for r in found), key=str)


def test_awkward_rows(awkward, nothing):
    assert got(awkward) == expected([(r.doc_id, r.text) for r in awkward.collect()])
    assert merkle.compare(nothing).count() == 0


def test_single_row_follows_itself(spark):
    df = spark.createDataFrame([(7, "One. Two.")], "doc_id long, text string")
    row = merkle.compare(df).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"One. TOne").hexdigest()


def test_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    for rows in (10, 2_000):  # many ranges, and one
        pairs = merkle.with_next(df.select("doc_id", "text"), ["text"], rows).collect()
        ordered = order(plain)
        want = {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
        assert {r.doc_id: r.next_text for r in pairs} == want and len(pairs) == len(plain)
    found = got(df)
    assert found == expected(plain)
    likely = sorted(f[5] for f in found)
    assert likely[len(likely) // 2] > 0.5 and sum(f[6] > f[5] for f in found) < 0.1 * len(found)


def test_ids_of_any_size_and_many_rows_of_one_id(spark, monkeypatch):
    """Ids at both ends of the range, an outlier, a third of the rows without an id, equal rows: even ranges, all followed."""
    ids = [-(2**63), 2**63 - 1, -1, 0, *range(1, 4000), *[None] * 1500, *[77] * 500]
    rows = [(i, f"text {k % 700}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(merkle, "STEP", 7)
    pairs = merkle.with_next(df, ["text"], 100)
    followed = Counter((r.doc_id, r.text, r.next_text) for r in pairs.collect())
    ordered = order(rows)
    assert followed == Counter((*ordered[k], ordered[(k + 1) % len(ordered)][1]) for k in range(len(ordered)))
    at = F.concat(F.lit(b"x"), merkle._unsigned(F.monotonically_increasing_id()))
    placed, ranges = merkle._ranged(merkle.written(df.select("*", at.alias("_at")), "t"), 100)
    sizes = sorted(r["count"] for r in placed.groupBy("_range").count().collect())
    assert len(sizes) == ranges >= 55 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
    assert placed.where("_head").count() == ranges


def test_branches_locate_edits(spark):
    cases = [("A b. C d.\nE f.\n\nG h.\nI j.", "A b. C d.\nE f.\n\nG X.\nI j.", [(2, 1)], 0.8), ("A\nA\nA", "A\nB\nA", [(1, 2)], 2 / 3), ("A. A. A.", "A.", [(1, 1)], 0.5), ("a\n\nb", "a", [(2, 1)], 2 / 3), ("a", "a", [], 1.0), ("", "x\n\n\ny", [(1, 1), (2, 1), (2, 2)], 0.5)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in cases], "a string, b string").coalesce(1).select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    found = df.select(merkle.differing(merkle.branches(F.col("a")), merkle.branches(F.col("b"))).alias("at"), merkle.likeness(F.col("a"), F.col("b")).alias("like")).collect()
    assert [([tuple(p) for p in r["at"]], round(r["like"], 9)) for r in found] == [(at, round(like, 9)) for *_, at, like in cases]
