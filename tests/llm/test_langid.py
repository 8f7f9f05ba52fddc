import zlib

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import langid
from tests.conftest import SMALL

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs)
    rows = docs.join(langid.predicted(docs, model), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    labelled = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in labelled) > 0.98 * len(labelled)
    assert sum(r.accepted for r in rows) > 0.99 * len(rows)
    names, score, accepted = model.predict(["日本語のテキスト", "привет мир", "1 2 3", "", None])
    assert not accepted.any() and names[2:] == ["und"] * 3 and score[2:].tolist() == [0, 0, 0]
    assert langid.accepted_documents(docs, model).count() == sum(r.accepted for r in rows)


def test_predictions_follow_the_text_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")).withColumn("doc_id", F.col("doc_id") + 10_000)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()}
    b = {r.doc_id - 10_000: (r.lang_pred, r.score) for r in langid.predicted(other, model).collect()}
    assert a == b


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.fit(docs).languages


def test_awkward_rows(awkward, nothing):
    model = langid.fit(awkward)
    rows = langid.predicted(awkward, model).collect()
    assert len(rows) == awkward.count() and {r.lang_pred for r in rows} <= {"en", "und"}
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in awkward.collect() if r.doc_id is not None}
    assert all((r.lang_pred == "und") != letters[r.doc_id] for r in rows if r.doc_id is not None)
    empty = langid.fit(nothing)
    assert empty.languages == [] and langid.predicted(nothing, empty).count() == 0
    assert {r.lang_pred for r in langid.predicted(awkward, empty).collect()} == {"und"}


def test_long_texts_are_read_whole():
    text = ("the of and with " * 100_000) + "zxq"
    whole = [b for t in langid._blocks(text) for b in [t]]
    assert "".join(whole) == text and len(whole) == 2
    n = sum(len(langid.subwords([b])[0]) for b in whole)
    assert n == len(langid.subwords([text])[0])


def test_rejection_is_calibrated(spark):
    """Shares of clean documents rejected and of strangers accepted, on texts that calibration did not see."""
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs)
    held = [r.text for r in docs.where(langid.held_out()).where("text is not null").collect()]
    assert 0 < model.least < 1 and model.measured[0] <= 0.02 and model.measured[1] <= 0.05
    assert model.predict(held)[2].mean() >= 0.99
    strange = [t for t in (langid.stranger(t, 99 + i) for i, t in enumerate(held)) if len(t) > 40]
    assert model.predict(strange)[2].mean() <= 0.05


def test_every_language_is_learned(spark):
    """A rare language has its turn in a sample that is cut short by many languages."""
    rows = [(i, f"w{'abcdefgh'[i % 8]} {'abcdefgh'[i % 8] * 3} x{i}", f"l{i % 8}") for i in range(800)] + [(9000 + i, f"zz yy {i}", "rare") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~langid.held_out())
    assert set(langid.fit(docs, per_language=50, most=27).languages) == {*[f"l{k}" for k in range(8)], "rare"}


def test_rows_are_accepted_by_their_texts(spark, awkward):
    model = langid.fit(awkward)
    kept = langid.accepted_documents(awkward, model)
    want = [r.text for r in awkward.collect() if r.text and model.predict([r.text])[2][0]]
    assert kept.columns == awkward.columns
    assert {r.text for r in kept.collect()} == set(want)


def test_the_whole_of_a_long_text_is_learnt(spark):
    """What tells two languages apart stands behind 30,000 characters that they share."""
    same = "ab cd ef gh " * 2500
    rows = [(i, same + ("qqx qxq " if i % 2 else "zzv vzv ") * 5000, "q" if i % 2 else "z") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.predict([r[1] for r in rows])[0] == [r[2] for r in rows]


def test_logits_are_averages_over_subwords(spark):
    """The model against a plain loop over each text's subwords, one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(15).collect() if r.text] + ["a", "Ünïcode ſtraße!", "x1y2"]

    def pieces(text):
        out = []
        chars = [" "] + [c if c.isalpha() else " " for c in text.lower()] + [" "]
        for n in langid.SIZES:
            for i in range(len(chars) - n + 1):
                part = chars[i : i + n]
                inner = part[1:-1]
                if all(c != " " for c in inner) and (n > 2 or part != [" ", " "]):
                    out.append("".join(part))
        return out

    logits, seen, _ = model.averages(texts)
    for text, row, share in zip(texts, logits, seen, strict=True):
        kinds, of = langid.counted(text)
        assert abs(float(of.sum()) - 1) < 1e-4
        buckets = langid.subwords([text])[0]
        plain = np.array([model.logits[b] for b in buckets], float).mean(0) + model.bias
        assert np.allclose(row, plain, atol=1e-4) and np.allclose(model.averages_of([(kinds, of)])[0][0], plain, atol=1e-4)
        assert abs(share - np.mean([float(model.seen[b]) for b in buckets])) < 1e-5
        assert len(buckets) == len(pieces(text))
        e = np.exp((plain - plain.max()) / model.heat)
        name, score, _ = model.predict([text])
        assert name == [model.languages[int(plain.argmax())]]
        assert abs(score[0] - min(1, e.max() / e.sum() * min(1, share / model.usual))) < 1e-4


def test_strangers_are_as_long_as_their_texts():
    for seed in range(12):
        text = "Der Fluß fließt, und the river flows. " * 50
        odd = langid.stranger(text, seed)
        assert len(odd) == len(text.lower()) and odd != text.lower()
    assert langid.stranger("", 1) == "" and len(langid.stranger("1 2", 5)) == 3
