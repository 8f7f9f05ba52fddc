"""Substring deduplication by sparse suffix arrays.

Of all suffixes of the word sequences only those stay that start at a minimiser: the least hash of ``GRAM`` words
in some window. Windows are as wide as a repeat of ``LEAST`` words has grams, so every such repeat holds one. Those
whose gram occurs once go. The rest are sorted by gram and following words over all tasks, each is compared with
its neighbours in that order, and the agreement is extended to the right and to the left of the minimiser. A stranger
that shares more words to the right may part two suffixes that share words on both sides, so within a gram's rows the
runs of ``LEAST`` words around the minimiser are sorted as well, for each place that it can have in them. Range
partitioning orders copies by document at last, so a passage that a third of all documents share spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import spread, table, written
from timberline.llm.frugal import frugal
from timberline.llm.shingles import batches, mixed, word_hashes

LEAST, GRAM = 50, 8
#: Rows that are compared at a time; a gram's rows stay together up to this number, and windows join them beyond it.
PART = 8192
#: Rows that a task of the sort is meant to hold, of some 420 bytes each.
TASK = 25 * PART
_steps = np.random.default_rng(31).integers(1, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)
#: One row for each kept suffix: words before it (backwards) and from it on, four bytes each.
SUFFIX = "key long, ahead binary, doc_id long, position int, words int, behind binary"


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by the first of them."""
    step = np.minimum if least else np.maximum
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    fill = np.iinfo(x.dtype).max if least else 0
    rows = np.full(-(-len(x) // width) * width, fill, x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    front = step.accumulate(rows, axis=1).ravel()
    back = step.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return step(back[:n], front[width - 1 : width - 1 + n])


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j : j + n] * _steps[j]
    return mixed(out) | np.uint64(1)


def minimisers(hashes: np.ndarray, owner: np.ndarray, window: int, whole: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some ``window`` grams of one text; ``whole``: grams within one text."""
    hashes = np.where(whole, hashes, np.uint64(0))
    low = sliding(hashes, window, True)
    inside = owner[: len(low)] == owner[window - 1 : window - 1 + len(low)]
    low = np.where(inside, low, np.uint64(0))  # a window over two texts chooses nothing
    padded = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    best = sliding(padded, window, False)[: len(hashes)]
    return np.flatnonzero((best == hashes[: len(best)]) & (best > 0))


def anchored(words: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers among the words of a batch of texts, which begin at ``first``: text, place in its words, gram hash."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = grams(words, gram)
    whole = owner[: len(hashes)] == owner[gram - 1 : gram - 1 + len(hashes)]
    # A gram that runs into the next text belongs to none: give it an owner of its own.
    at = minimisers(hashes, np.where(whole, owner[: len(hashes)], -1 - np.arange(len(hashes))), window, whole)
    return owner[at], at - first[owner[at]], hashes[at].astype(np.int64)


def anchors(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """Rows ``key, doc_id, position`` of all minimisers of ``docs`` (``doc_id, text``)."""

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"")
            for low in range(0, len(ids), 1024):
                for start, some in batches(texts.slice(low, 1024).to_pylist()):
                    words, _, first = word_hashes(some)
                    owner, place, keys = anchored(words, first, gram, window)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), ids.slice(low + start, len(some)).take(pa.array(owner)), pa.array(place.astype(np.int32))], ["key", "doc_id", "position"])

    return docs.mapInArrow(frugal(made), "key long, doc_id long, position int")


def repeated(found: DataFrame) -> DataFrame:
    """Rows of ``found`` whose key occurs twice or more."""
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return found.join(spread(keys), "key", "left_semi")


def suffixes(docs: DataFrame, places: DataFrame, least: int, gram: int, window: int) -> DataFrame:
    """The suffixes at ``places`` (``doc_id, position``) with the words around them; columns as in ``SUFFIX``."""
    ahead, behind = least, window

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, wanted = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist(), batch.column(2).to_pylist()
            ids = batch.column(0).to_pylist()
            for start, some in batches(texts):
                words, _, first = word_hashes(some)
                around = np.concatenate([np.zeros(behind, np.uint64), words, np.zeros(ahead, np.uint64)])
                around = (around >> np.uint64(32)).astype(">u4")
                counts = np.diff(first)
                owner = np.concatenate([np.full(len(p), i) for i, p in enumerate(wanted[start : start + len(some)])]).astype(np.int64)
                place = np.concatenate([np.array(p, np.int64) for p in wanted[start : start + len(some)]])
                fits = place + gram <= counts[owner]  # another row of the same id may be shorter
                owner, place = owner[fits], place[fits]
                keys = grams(words, gram)[first[owner] + place].astype(np.int64)
                right = around[(first[owner] + place + behind)[:, None] + np.arange(ahead)]
                left = around[(first[owner] + place + behind - 1)[:, None] - np.arange(behind)]
                names = [f.name for f in schema]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([r.tobytes() for r in right], pa.binary()), pa.array([ids[start + i] for i in owner], pa.int64()), pa.array(place.astype(np.int32)), pa.array(counts[owner].astype(np.int32)), pa.array([r.tobytes() for r in left], pa.binary())], names)

    schema = pa.schema([("key", pa.int64()), ("ahead", pa.binary()), ("doc_id", pa.int64()), ("position", pa.int32()), ("words", pa.int32()), ("behind", pa.binary())])
    wanted = places.groupBy("doc_id").agg(F.array_distinct(F.collect_list("position")).alias("positions"))
    wanted = wanted.withColumnRenamed("doc_id", "_id")
    return docs.join(wanted, docs["doc_id"] == wanted["_id"]).select("doc_id", "text", "positions").mapInArrow(frugal(made), SUFFIX)


class _Rows:
    """Rows in suffix order as arrays."""

    def __init__(self, rows: pa.Table) -> None:
        self.n = n = rows.num_rows
        self.key, self.position, self.words, self.doc = (rows.column(c).to_numpy() for c in ("key", "position", "words", "doc_id"))
        self.ahead, self.behind = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32).reshape(n, -1) for c in ("ahead", "behind"))

    def agree(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words rows ``i`` and ``j`` share before and from the suffix on; none if their grams differ."""

        def same(x: np.ndarray, most: np.ndarray) -> np.ndarray:
            differs = np.concatenate([x[i] != x[j], np.ones((len(i), 1), bool)], axis=1)
            return np.where(self.key[i] == self.key[j], np.minimum(differs.argmax(1), most), 0)

        left = same(self.behind, np.minimum(self.position[i], self.position[j]))
        return left, same(self.ahead, np.minimum((self.words - self.position)[i], (self.words - self.position)[j]))

    def windows(self, rows: np.ndarray, least: int, salt: int) -> np.ndarray:
        """Hashes of the ``least`` words around the suffixes of ``rows``, one for each number of words before the start; 0 beyond the text."""
        wide = np.concatenate([self.behind[rows][:, ::-1], self.ahead[rows]], axis=1).astype(np.uint64)
        steps = np.random.default_rng(salt).integers(1, 1 << 63, wide.shape[1], np.uint64) << np.uint64(1) | np.uint64(1)
        sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(wide * steps, axis=1, dtype=np.uint64)], axis=1)
        before = np.arange(min(self.behind.shape[1], least))
        begin = self.behind.shape[1] - before
        hashes = mixed(sums[:, begin + least] - sums[:, begin] + self.key[rows].astype(np.uint64)[:, None])
        hashes = mixed(hashes + before.astype(np.uint64)) | np.uint64(1)
        inside = (before <= self.position[rows][:, None]) & (least - before <= (self.words - self.position)[rows][:, None])
        return np.where(inside, hashes, np.uint64(0))

    def around(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that share ``least`` words with the suffix's start among them, by hashes, which only nominate.

        Each row is paired with the first one, by document and place, that has the same words around its start.
        """
        order = np.lexsort((self.position, self.doc))
        hashes = self.windows(order, least, 37)
        row, hashes = order[np.nonzero(hashes)[0]], hashes[hashes > 0]
        by = np.argsort(hashes, kind="stable")
        row, hashes = row[by], hashes[by]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(row) else np.zeros(0, bool)
        first = row[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
        pairs = np.unique(first[~new] * np.int64(self.n) + row[~new])
        return pairs // self.n, pairs % self.n

    def open_windows(self, least: int, first: bool, last: bool) -> list[np.ndarray]:
        """All different windows of the first or last gram's rows: document, begin, two hashes. The earliest row speaks for others."""
        some = np.zeros(self.n, bool)
        some |= first & (self.key == self.key[0])
        some |= last & (self.key == self.key[-1])
        order = np.lexsort((self.position, self.doc))
        order = order[some[order]]
        hashes, checks = self.windows(order, least, 37), self.windows(order, least, 41)
        at, before = np.nonzero(hashes)
        hashes, place = np.unique(hashes[at, before], return_index=True)
        at, before = at[place], before[place]
        return [self.doc[order[at]], self.position[order[at]] - before, hashes.astype(np.int64), checks[at, before].astype(np.int64)]

    def spans(self, mine: np.ndarray, other: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """What rows ``mine`` share with ``other``: one span a row for earlier rows and one for later ones.

        All spans of a row hold its suffix's start, so several are one. That for later rows is left out where
        the one for earlier rows covers it.
        """
        later = (self.doc[other] < self.doc[mine]) | (self.doc[other] == self.doc[mine]) & (self.position[other] < self.position[mine])
        code = 2 * mine + later
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        if not len(first):
            return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        row, gone = code[order][first] // 2, code[order][first] % 2 == 1
        begin = np.minimum.reduceat((self.position[mine] - left)[order], first)
        end = np.maximum.reduceat((self.position[mine] + right)[order], first)
        least = np.minimum.reduceat(self.doc[other][order], first)
        low, high = np.full(self.n, np.iinfo(np.int64).max), np.full(self.n, -1)
        low[row[gone]], high[row[gone]] = begin[gone], end[gone]
        told = gone | (begin < low[row]) | (end > high[row])
        return [self.doc[row][told], begin[told], end[told], least[told], gone[told]]


def _compare(x: _Rows, least: int) -> list[np.ndarray]:
    """Repeats among rows in suffix order: each is compared with its neighbours and with the row that ``around`` finds."""
    at = np.arange(x.n - 1)
    i, j = x.around(least)
    i, j = np.concatenate([at, i]), np.concatenate([at + 1, j])
    left, right = x.agree(i, j)
    good = (left + right >= least) & ~((x.doc[i] == x.doc[j]) & (x.position[i] == x.position[j]))
    i, j, left, right = i[good], j[good], left[good], right[good]
    return x.spans(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([left, left]), np.concatenate([right, right]))


MATCH = "doc_id long, begin int, end int, other_id long, later boolean, window long, check long"


def matches(ordered: DataFrame, least: int) -> DataFrame:
    """Repeats found in ``ordered`` within each part of a task; and what comparing across parts needs.

    That is the different windows of grams whose rows may go on in another part: rows with ``window`` and ``check``.
    """

    def parts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
        """The rows in order, cut where the gram changes unless one gram has more rows than ``PART``; is the first, the last gram open?"""
        rest, begun = None, True
        for batch in rows:
            for low in range(0, batch.num_rows, PART):
                part = pa.Table.from_batches([batch.slice(low, PART)])
                part = part if rest is None else pa.concat_tables([rest, part])
                new = np.flatnonzero(np.diff(part.column("key").to_numpy())) + 1
                within = not len(new) and part.num_rows >= PART
                cut = int(new[-1]) if len(new) else part.num_rows if within else 0
                if cut:
                    yield part.slice(0, cut), begun, within
                    begun = within
                rest = part.slice(cut) if cut < part.num_rows else None
        if rest is not None:
            yield rest, begun, True

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, first, last in parts(rows):
            x = _Rows(part)
            found = [pa.array(c, t) for c, t in zip(_compare(x, least), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*found, *[pa.nulls(len(found[0]), pa.int64())] * 2], names)
            if first or last:
                doc, begin, window, check = x.open_windows(least, first, last)
                n = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin, pa.int32()), pa.array(begin + least, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(window), pa.array(check)], names)

    names = [f.split(" ")[0] for f in MATCH.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
    return ordered.mapInArrow(frugal(made), MATCH)


def across_parts(found: DataFrame) -> DataFrame:
    """Repeats between parts: windows (128 bits) that several parts hold, each against the earliest document and place.

    A part names a window once, so a window that very many documents share comes once for each ``PART`` of them.
    """
    rows = found.where("window is not null").select("window", "check", "doc_id", "begin", "end")
    place = F.struct("doc_id", "begin", "end")
    firsts = rows.groupBy("window", "check").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    pairs = rows.join(firsts, ["window", "check"]).where(place != F.col("_first"))

    def span(x: str, other: str, later: bool):
        return F.struct(F.col(f"{x}doc_id").alias("doc_id"), F.col(f"{x}begin").alias("begin"), F.col(f"{x}end").alias("end"), F.col(f"{other}doc_id").alias("other_id"), F.lit(later).alias("later"))

    both = pairs.select(F.explode(F.array(span("", "_first.", True), span("_first.", "", False))).alias("s")).select("s.*")
    return both.groupBy("doc_id", "begin", "end", "later").agg(F.min("other_id").alias("other_id"))


def united(spans: DataFrame) -> DataFrame:
    """Rows ``doc_id, begin, end, other_id`` with overlapping spans of a document joined; ``other_id`` is the least."""
    order = Window.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("begin") <= reach, 0).otherwise(1))
    spans = spans.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("other_id").alias("other_id")).drop("_island")


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Passages of ``least`` words or more that occur again: ``doc_id, begin, end, n_words, other_id, kept``.

    Spans are in words (runs of non-white bytes, A-Z as a-z) from 0, the end exclusive. Rows with ``kept`` false
    are passages that occur earlier (in a smaller doc_id, then place) as well: these can be cut out. Rows with
    ``kept`` true are all that is repeated in one place, if some of it occurs later only; so they can hold rows of
    the other kind. Spans do not depend on partitions; ``other_id`` is the least document that was compared and
    shares one. Repeats within one document count. Null and empty texts, and
    those of fewer than ``least`` words, have none; rows that repeat a doc_id are searched, their spans joined;
    rows without a doc_id are left out; an empty table gives no rows; other columns are not read.
    """
    spark, window = docs.sparkSession, least - gram + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    places = repeated(written(anchors(docs, gram, window), "anchors"))
    kept = written(suffixes(docs, places, least, gram, window), "suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // TASK))
    order = ["key", "ahead", "doc_id", "position"]
    found = written(matches(kept.repartitionByRange(parts, *order).sortWithinPartitions(*order), least), "matches")
    spans = written(found.where("window is null").drop("window", "check").unionByName(across_parts(found)), "spans")
    gone, all_ = united(spans.where("later").drop("later")), united(spans.drop("later"))
    told = gone.select("doc_id", "begin", "end")
    first = all_.join(told, told.columns, "left_anti")
    both = gone.withColumn("kept", F.lit(False)).unionByName(first.withColumn("kept", F.lit(True)))
    return both.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "other_id", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
