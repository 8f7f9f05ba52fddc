"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are runs of two to four characters within a word and its borders, hashed to ``BUCKETS`` rows of an
embedding. A text's embedding is the average over all its subwords. Embeddings and softmax are trained by
stochastic gradient descent in one task, on a sample whose number of rows is bounded by parameters. Its texts are
counted whole where they lie, and the task gets their counts of subwords, no more than ``BUCKETS`` a text. The model,
a few megabytes whatever the input, is broadcast. Prediction reads every whole text where it lies. What is done is the
same for tables and texts of any size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import small, table, written
from timberline.llm.exact import kept_documents, mark
from timberline.llm.frugal import frugal

BUCKETS, DIMENSIONS = 1 << 15, 16
SIZES = (2, 3, 4)
#: Bound of the training sample: documents for each language, and in all.
PER_LANGUAGE, MOST = 600, 6_000
EPOCHS, BATCH, RATE = 6, 16, 4.0
#: Of so many documents of a language in the sample, the last is kept for calibration.
KEPT = 5
#: Share of texts told right that calibration may reject, and share of strangers that it should.
REJECTED, REFUSED = 0.001, 0.99
#: Where between the two the level lies if there is room, from the strangers' side.
MARGIN = 0.25
#: Code points handled at once; a text longer than ``BLOCK`` is cut at a blank.
HELD, BLOCK = 250_000, 1_000_000
UNKNOWN = "und"

_odd = np.random.default_rng(23).integers(1, 1 << 31, 4).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, the text of each, and whether each text has a letter."""
    joined = "\n".join(["", *texts, ""]).lower()
    if len(joined) != sum(map(len, texts)) + len(texts) + 1:  # lower case can be longer
        texts = [t.lower() for t in texts]
        joined = "\n".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = is_letter()[points]
    owner = np.repeat(np.arange(-1, len(texts)), [1, *[len(t) + 1 for t in texts]])
    points = np.where(letter, points, 0).astype(np.uint32)
    buckets, owners = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        valid = letter[:m] | letter[n - 1 :] if n == 2 else letter[1 : m + 1].copy()
        for i in range(2, n - 1):
            valid &= letter[i : m + i]
        at = np.flatnonzero(valid)
        mixed = np.full(len(at), n, np.uint32)
        for i in range(n):
            mixed = (mixed + points[at + i]) * _odd[i]
            mixed ^= mixed >> np.uint32(15)
        buckets.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        owners.append(owner[at + (letter[at + 1] if n == 2 else 1)])  # the text of its letters, not of the border before them
    has = np.bincount(owner[1:], letter[1:], len(texts)) > 0 if len(texts) else np.zeros(0, bool)
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), has
    return np.concatenate(buckets), np.concatenate(owners), has


def _blocks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > BLOCK:
        cut = text.find(" ", at + BLOCK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def stranger(text: str, seed: int) -> str:
    """A text as long as ``text`` in no language that was learnt: its letters exchanged for others throughout, as in a
    cipher; all its characters in random order; or as many random letters of it and blanks."""
    random = np.random.default_rng(seed)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).copy()
    letters = np.unique(points[is_letter()[points]])
    kind = random.integers(3)
    if kind == 0 and len(letters):
        at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
        points = np.where(letters[at] == points, random.permutation(letters)[at], points)
    elif kind == 1:
        points = random.permutation(points)
    elif kind == 2:
        points = random.choice(np.concatenate([letters, np.array([32, 32], np.uint32)]), len(points))
    return points.astype(np.uint32).tobytes().decode("utf-32-le", "replace")


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's subwords, each once, and the share of the subwords that each has."""
    total = np.zeros(BUCKETS)
    for block in _blocks(text):
        total += np.bincount(subwords([block])[0], minlength=BUCKETS)
    kinds = np.flatnonzero(total)
    return kinds.astype(np.uint16), (total[kinds] / max(total.sum(), 1)).astype(np.float32)


#: A document of the sample: its buckets and their shares.
Counts = tuple[np.ndarray, np.ndarray]


class Model:
    """What training leaves: for each bucket its share of every language's logit, and whether it was seen."""

    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray, seen: np.ndarray) -> None:
        self.languages, self.logits, self.bias, self.seen = languages, logits, bias, seen
        self.heat, self.usual, self.least = 1.0, 1.0, 0.0
        self.measured: tuple[float, float] | None = None

    def averages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Average logits, the share of subwords that training saw, and whether there is a letter, of each text."""
        k = len(self.languages)
        total, has = np.zeros((len(texts), k + 2)), np.zeros(len(texts), bool)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            buckets, owner, letter = subwords(held)
            place = np.array(owners, np.int64)
            for j in range(k):
                total[:, j] += np.bincount(place[owner], self.logits[buckets, j], len(texts))
            total[:, k] += np.bincount(place[owner], self.seen[buckets], len(texts))
            total[:, k + 1] += np.bincount(place[owner], minlength=len(texts))
            has[place[letter]] = True
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for block in _blocks(text):
                held.append(block)
                owners.append(i)
                size += len(block)
                if size > HELD:
                    flush()
                    size = 0
        if held:
            flush()
        n = np.maximum(total[:, -1], 1)
        return total[:, :k] / n[:, None] + self.bias, total[:, k] / n, has

    def averages_of(self, documents: list[Counts]) -> tuple[np.ndarray, np.ndarray]:
        """The same logits and shares from counts."""
        logits = np.array([share @ self.logits[kinds] for kinds, share in documents], float).reshape(len(documents), len(self.languages))
        return logits + self.bias, np.array([float(share @ self.seen[kinds]) for kinds, share in documents])

    def _softmax(self, logits: np.ndarray) -> np.ndarray:
        e = np.exp((logits - logits.max(1, keepdims=True)) / self.heat)
        return e / e.sum(1, keepdims=True)

    def calibrate(self, documents: list[Counts], labels: np.ndarray, strange: list[Counts]) -> None:
        """Fit the softmax's temperature, what share of seen subwords is usual, and how much of it a text needs.

        A text is rejected for what no language explains, not for being in two: so the level is one of the share of its
        subwords that training saw, against the usual share, and not of the score, which is low for a mixed text too.
        The level rejects ``REFUSED`` of strangers (see ``stranger``), but never more than ``REJECTED`` of the texts whose
        language is told right; where both leave room, it lies nearer to the strangers, by ``MARGIN``. Every other text
        sets the level; on the rest ``measured`` has the shares of right texts rejected and of strangers accepted.
        Without documents all stays as it is, and nothing is rejected.
        """
        if not documents:
            return
        logits, seen = self.averages_of(documents)
        losses = []
        for self.heat in np.geomspace(0.05, 10, 40):
            losses.append((-np.log(self._softmax(logits)[np.arange(len(labels)), labels] + 1e-12).mean(), self.heat))
        self.heat = min(losses)[1]
        self.usual = max(float(np.quantile(seen, 0.02)), 1e-6)
        right = self._known(seen)[logits.argmax(1) == labels]
        strange_ = self._known(self.averages_of(strange)[1])
        if len(right) and len(strange_):
            most, enough = float(np.quantile(right[::2], REJECTED)), float(np.quantile(strange_[::2], REFUSED))
            self.least = min(most, enough + MARGIN * max(0.0, most - enough))
            self.measured = float(np.mean([*(right[1::2] < self.least), 0])), float(np.mean([*(strange_[1::2] >= self.least), 0]))

    def _known(self, seen: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, seen / self.usual)

    def _scored(self, logits: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self._softmax(logits)
        return p.argmax(1), p.max(1) * self._known(seen)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text; ``und``, 0 and False for null or a text without a letter."""
        if not len(texts):
            return [], np.zeros(0), np.zeros(0, bool)
        logits, seen, has = self.averages([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best, score = self._scored(logits, seen)
        score = np.where(has, np.clip(score, 0, 1), 0.0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, score, has & (self._known(seen) >= self.least)


def train(documents: list[Counts], langs: list[str], turns: list[int], strange: list[Counts], seed: int = 1) -> Model:
    """Train on counted, labelled documents in their given order; any number of languages.

    ``turns`` number the documents of a language from 1; of every ``KEPT`` the last is kept for calibration, as are
    its counts as a stranger.
    """
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(BUCKETS))
    labels = np.searchsorted(languages, langs)
    random = np.random.default_rng(seed)
    fit = [i for i, turn in enumerate(turns) if turn % KEPT]
    held = [i for i, turn in enumerate(turns) if turn % KEPT == 0]
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    weights += random.normal(0, 0.1, weights.shape)
    bias = np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        random.shuffle(fit)
        for low in range(0, len(fit), BATCH):
            some = fit[low : low + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            kinds = np.concatenate([documents[i][0] for i in some])
            share = np.concatenate([documents[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(documents[i][0]) for i in some])
            average = np.zeros((len(some), DIMENSIONS), np.float32)
            np.add.at(average, row, embedding[kinds] * share[:, None])
            logits = average @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            back = p @ weights.T
            weights -= rate / len(some) * average.T @ p
            bias -= 0.1 * rate / len(some) * p.sum(0)
            # A bucket's gradient is its share of the text; scaled up, for shares are small.
            np.add.at(embedding, kinds, -rate * 10 / len(some) * share[:, None] * back[row])
    seen = np.zeros(BUCKETS)
    for i in fit:
        seen[documents[i][0]] += 1
    # A subword is the better known the more documents have it.
    model = Model(languages, (embedding @ weights).astype(np.float32), bias, (seen / (seen + 1)).astype(np.float32))
    model.calibrate([documents[i] for i in held], labels[held], [strange[i] for i in held if len(strange[i][0])])
    return model


def held_out():
    """Documents that no model may learn from; a row without an id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """A model of the labelled, not held out rows of ``docs`` (``doc_id, text, lang``), from a sample in the order of a hash.

    The sample has about ``per_language`` rows of each language and never more than ``most``, of which every language
    has its share: they are taken in turns. Their texts are learnt whole. Training runs in one task on an executor.
    Without labelled rows the model knows no language and calls every text ``und``; a language with fewer than
    ``KEPT`` rows in the sample has none for calibration.
    """
    known = docs.where("text is not null and lang is not null").where(~held_out()).select("text", F.col("lang").alias("_lang"), F.xxhash64("doc_id", "text").alias("_hash"))
    counts = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.col("_hash"), F.lit(1_000_003)) / 1_000_003.0
    drawn = known.join(small(counts, counts.count()), "_lang").where(part < per_language / F.col("_n")).select("text", "_lang", "_hash")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, lang, hash_ = (c[i].as_py() for c in batch.columns)
                kinds, share = counted(text)
                odd, odd_share = counted(stranger(text, hash_ & (2**63 - 1)))
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([hash_]), *[pa.array([c.tobytes()]) for c in (kinds, share, odd, odd_share)]], names=["_lang", "_hash", *COUNTS])

    sample = written(drawn.mapInArrow(frugal(count), "_lang string, _hash long, " + ", ".join(f"{c} binary" for c in COUNTS)).withColumn("_row", F.monotonically_increasing_id()), "langid-sample")
    order = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_hash"), "_row"))  # over the sample's numbers
    turns = sample.select("_lang", "_hash", "_row").withColumn("_turn", order).orderBy("_turn", F.xxhash64("_hash"), "_lang").limit(most).select("_row", "_turn")
    kept = F.col("_turn") % KEPT == 0
    sample = sample.join(F.broadcast(turns), "_row").withColumns({c: F.when(kept, F.col(c)).otherwise(F.lit(b"")) for c in COUNTS[2:]}).drop("_row")  # ``most`` numbers at most

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({c: [] for c in ("_lang", "_hash", "_turn", *COUNTS)}), *batches]).sort_values(["_hash", "_lang", "_turn"])
        found = [[(np.frombuffer(a, np.uint16), np.frombuffer(b, np.float32)) for a, b in zip(rows[k], rows[v], strict=True)] for k, v in (COUNTS[:2], COUNTS[2:])]
        yield pd.DataFrame({"model": [pickle.dumps(train(found[0], rows["_lang"].tolist(), rows["_turn"].astype(int).tolist(), found[1]))]})

    found = sample.coalesce(1).mapInPandas(frugal(work), "model binary").first()
    return pickle.loads(found[0]) if found else train([], [], [], [])  # a table without files has no task


#: Columns of a sampled document: buckets and shares of its own, and of it as a stranger.
COUNTS = ("kinds", "share", "odd", "odd_share")


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, held_out, lang_pred, score, accepted``.

    Null and texts without a letter are ``und`` with score 0 and are not accepted. Texts of any length are averaged
    whole, in blocks of ``BLOCK`` code points. Of languages with equal logits the first by name is predicted. Repeated
    rows are each predicted; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                names, score, accepted = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(frugal(work), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def decided(docs: DataFrame, model: Model) -> DataFrame:
    """Which rows of ``docs`` (``doc_id, text``) ``model`` accepts, as ``exact.kept_documents`` takes it: ``doc_id, mark, kept``.

    Null, empty and other texts without a letter are rejected, as are those of whose subwords too few are known (``model.least``). A
    decision depends on the text alone, so repeated rows go or stay together; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.predict(part.column(2).to_pylist())[2], pa.bool_())], ["doc_id", "mark", "kept"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text")).alias("mark"), "text")
    return docs.mapInArrow(frugal(work), "doc_id long, mark binary, kept boolean")


def accepted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``model`` accepts, as they are, all columns: see ``decided``. Rejected ones are few, and
    are left out by a join of the texts where they lie; repeated rows that are accepted all stay.
    """
    return kept_documents(docs, written(decided(docs, model), "accepted"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
