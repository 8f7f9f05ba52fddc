import random

import numpy as np
from tokenizers import Tokenizer

from timberline.llm import counting
from tests.conftest import SMALL

ODD = ["", "  ", "a's 'S DON'T  it's''s", "\n\n x\t\ty  ", "<|endoftext|> hi <|ENDOFTEXT|><|endoftext|>", "日本語 123 ½ ¼x é", "\x1c\x1d a\x85b\xa0c", "a" * 5000, "'" * 700, "Σας ΣΑΣ", " " * 3000, "\n" * 999 + "x", "x'll've're'd'm 'll \n'll ''ll", "1234567890" * 200, "'sfoo 'tbar"]


def check(df):
    library = Tokenizer.from_file(counting.vocabulary_path())
    want = []
    for r in df.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert sorted((tuple(r) for r in counting.count_tokens(df).collect()), key=str) == sorted(want, key=str)


def test_documents(spark):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_awkward_rows(awkward, nothing):
    check(awkward)
    assert counting.count_tokens(nothing).count() == 0


def test_random_texts(monkeypatch):
    library = Tokenizer.from_file(counting.vocabulary_path())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab'st lr ve\n\t1é日!.dm ") for _ in range(r.randint(0, 900))) for _ in range(1000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for chunk, kept in ((256, 1_000_000), (7, 100), (1, 1_000_000)):  # chunks shorter than words compose; a full machine forgets
        monkeypatch.setattr(counting, "CHUNK", chunk)
        monkeypatch.setattr(counting, "KEPT", kept)
        counter = counting.Counter(counting.vocabulary_path())
        some = texts if chunk > 1 else texts[:100]
        assert counter.counts(some) == want[: len(some)] and counter.counts(some) == want[: len(some)]


def test_long_words():
    """Words of a million letters without any border, of many kinds, and in time that grows as their length."""
    import time

    library = Tokenizer.from_file(counting.vocabulary_path())
    r = random.Random(2)
    texts = ["a" * 1_000_000, "ACGT" * 100_000, "".join(r.choice("acgt") for _ in range(1_000_000)), "=" * 300_000, "x" + "-" * 100_001, "".join(r.choice("etaoinsh") for _ in range(200_000)), "word " + "日本" * 100_000]
    counter = counting.Counter(counting.vocabulary_path())
    for text in texts:
        assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    times = []
    for n in (500_000, 4_000_000):
        start = time.monotonic()
        counter.counts(["".join(r.choice("acgt") for _ in range(n))])
        times.append(time.monotonic() - start)
    assert times[1] < 16 * times[0] + 2


def test_states_are_forgotten_on_the_way(monkeypatch):
    monkeypatch.setattr(counting, "KEPT", 200)
    library = Tokenizer.from_file(counting.vocabulary_path())
    r = random.Random(6)
    texts = ["".join(r.choice("etaoinsh") for _ in range(20_000)), "aab" * 5_000, " ".join("".join(r.choice("abc-1") for _ in range(r.randint(1, 900))) for _ in range(30))]
    assert counting.Counter(counting.vocabulary_path()).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_maps_are_composed():
    r = random.Random(3)
    for _ in range(50):
        n, k = r.randint(1, 40), r.randint(1, 4)
        maps = [[r.randrange(k) for _ in range(k)] for _ in range(n)]
        chunk, entry = (x.ravel() for x in np.mgrid[0:n, 0:k])
        ends = np.array(maps).ravel()
        taken = counting.composed(chunk, entry, ends, (chunk == 0) & (entry == 0), chunk < n - 1)
        now, want = 0, []
        for m in maps:
            want.append(now)
            now = m[now]
        assert entry[taken].tolist() == want and chunk[taken].tolist() == list(range(n))
