import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from timberline.llm import packing
from tests.conftest import SMALL

ODD = ["", "  ", "a's 'S DON'T  it's''s", "İstanbul ſ ŉ é é x", "<|endoftext|> hi <|ENDOFTEXT|>", "日本語 123 ½ ¼x", "\x1c\x1d a\x85b\xa0c", "a" * 5000, "'" * 50, "Σας ΣΑΣ", "it's " * 300_000]


def check(df, length=4096):
    library = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.packed(df, length=length).collect()
    want = {}
    for r in df.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            want.setdefault((r.doc_id, k, start, len(part), zlib.crc32(part.tobytes())), []).append(1)
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted((k for k, n in want.items() for _ in n), key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    return bins, sum(r.length for r in rows)


def test_documents(spark):
    bins, total = check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert len(bins) <= 1.02 * total / 4096 + 2
    check(spark.read.parquet(f"{SMALL}/documents.parquet"), 100)


def test_awkward_rows(awkward, nothing):
    check(awkward)
    assert check(nothing) == ({}, 0)


def test_ids_are_the_library_s():
    mine, library = packing.WordTokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab'st lr ve\n\t1é日!.dm ½²'S\xa0\x85\x1cİ") for _ in range(r.randint(0, 300))) for _ in range(2000)]
    for text, ids in zip(texts, mine.many(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_picks_the_least_sum():
    """Each placement against all choices, by the definition."""
    r = random.Random(4)
    lengths = np.array([r.randint(1, 30) for _ in range(200)])
    bins, offsets = packing.sum_of_squares(lengths, 30)
    fill, seen = {}, 0
    score = lambda f: sum(n * n for g, n in zip(*np.unique([30 - x for x in f.values()], return_counts=True), strict=True) if g)
    for i in np.argsort(-lengths, kind="stable"):
        size = lengths[i]
        choices = {b: score(fill | {b: x + size}) for b, x in fill.items() if x + size <= 30}
        new = score(fill | {-1: size})
        least = min([*choices.values(), new])
        took = score(fill | {bins[i]: fill.get(bins[i], 0) + size})
        assert took == least and offsets[i] == fill.get(bins[i], 0)
        fill[bins[i]] = fill.get(bins[i], 0) + size
        seen += 1
    assert seen == 200


def test_groups_are_even_and_lose_little(spark):
    """Many groups, a third of the rows without an id and a third with one: even groups, few sequences more than needed."""
    r = random.Random(7)
    rows = [((None, 5, i)[i % 3], 0, 0, r.choice([4096, r.randint(1, 4096), r.randint(1, 600), r.randint(1, 600)]), 9) for i in range(9000)]
    pieces = packing.written(spark.createDataFrame(rows, packing.PIECES).repartition(5), "test-pieces")
    found = packing.pack(pieces, len(rows), group=500).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.length) for x in found) == sorted((x[0] is None, x[0] or 0, x[3]) for x in rows)
    groups, fill = {}, {}
    for x in found:
        groups[x.sequence_id >> 32] = groups.get(x.sequence_id >> 32, 0) + 1
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert len(groups) == 18 and max(groups.values()) < 650
    for held in fill.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096
    assert len(fill) <= 1.02 * sum(x[3] for x in rows) / 4096 + 18
