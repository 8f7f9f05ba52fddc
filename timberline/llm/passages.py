"""Substring deduplication of paragraphs by MinHash banding, clustered by components.

Two kinds of units are compared. Paragraphs (lines of ``LEAST`` words or more, and shorter neighbouring lines joined to
as many) are near-duplicates where the exact Jaccard similarity of their five-word shingles is high enough; bands are tuned so that such a pair collides in one
with a set recall, and keys that hold several components are searched for links between them. Passages within running
text do not keep a paragraph's borders: these are found by stretches of ``LEAST`` words that start at minimisers, of
which every passage of ``PASSAGE`` words holds one, under a single band, the stretch itself, and extended both ways to
the borders of what documents share, word by word. Classes of equal units are formed before anything is dealt out by
key; under a key they are tied to one hub. Components of paragraphs decide which document keeps them; stretches that
stand together in some document are of one component as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.borders import extended, stretch_keys
from timberline.llm.common import done, small, spread, table, written
from timberline.llm.components import components
from timberline.llm.frugal import frugal
from timberline.llm.minhash import SETS, Bands, connected, set_columns, signatures
from timberline.llm.shingles import batches, sets_between, word_hashes
from timberline.llm.suffixes import anchored

WIDTH, PERCENT, LEAST, PASSAGE = 5, 80, 25, 51
RECALL = 0.999
#: Words of a gram whose hash selects minimisers.
GRAM = 5
#: One in so many short lines may begin a paragraph within a run of them.
OPENS = 3


def tuned(percent: int = PERCENT, rows: int = Bands.rows, recall: float = RECALL) -> int:
    """The fewest bands of ``rows`` symbols in which a pair at the threshold collides with at least this recall."""
    miss, bands = 1 - (percent / 100) ** rows, 1
    while 1 - miss**bands < recall:
        bands += 1
    return bands


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"")
    for low in range(0, len(ids), 1024):
        for start, some in batches(texts.slice(low, 1024).to_pylist()):
            yield ids.slice(low + start, len(some)).to_pylist(), some


def _lines(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch of texts, the first word of each text, and text, first and last word of the paragraphs."""
    words, starts, first = word_hashes(texts)
    breaks = np.flatnonzero(np.frombuffer(b" ".join([*texts, b""]), np.uint8) == 10)
    # A line feed is white, so no word holds one: lines end where the count of line feeds before a word changes, or the text.
    new = np.zeros(len(words), bool)
    new[first[:-1][first[:-1] < len(words)]] = True
    new[1:] |= np.diff(np.searchsorted(breaks, starts)) > 0
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(words)) if len(begin) else begin
    return words, first, *_paragraphs(words, np.searchsorted(first, begin, "right") - 1, begin, end, least)


def _paragraphs(words: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last word of the lines of ``least`` words and of what shorter neighbours are joined to.

    A run of shorter lines is cut where ``least`` words are held, as many are left, and the line's first word selects it:
    so copies of a run in other surroundings fall into step. A run with fewer words in all is no paragraph.
    """
    size = end - begin
    short = size < least
    opens = ~(short & np.roll(short, 1) & (text == np.roll(text, 1)))
    opens[:1] = True
    heads = np.flatnonzero(opens)
    held = np.add.reduceat(size, heads) if len(heads) else size
    run = np.cumsum(opens) - 1
    first, left = np.full(len(heads), -1), held.copy()
    for i in np.flatnonzero(short & (held[run] >= 2 * least)).tolist():
        r = run[i]
        first[r] = max(first[r], begin[i] if opens[i] else -1)
        if begin[i] - first[r] >= least and left[r] >= least and words[begin[i]] % np.uint64(OPENS) == 0:
            opens[i], first[r] = True, begin[i]
        left[r] -= size[i]
    whole = held[run] >= least
    text, begin, end, opens = (x[whole] for x in (text, begin, end, opens))
    return text[opens], begin[opens], end[np.append(opens[1:], True)] if len(opens) else end


def _node(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


UNITS = "node long, doc_id long, begin int, words int, symbols binary"


def units(docs: DataFrame, least: int, width: int, passage: int, index: Bands) -> DataFrame:
    """Both kinds of units from one pass over the texts, columns as in ``UNITS``.

    Paragraphs, with the hash of their set of shingles as ``node``, their number of words, and their signature;
    and the ``least`` words from every minimiser on, with their hash, which have no words and no signature.
    """
    window = passage - least + 1

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for ids, texts in _texts(batch):
                words, first, owner, begin, end = _lines(texts, least)
                sets = sets_between(words, begin, end, width)
                text, place, _ = anchored(words, first, GRAM, window)
                whole = place + least <= np.diff(first)[text]
                text, place = text[whole], place[whole]
                keys = stretch_keys(words, least, first[text] + place)
                n, m = len(owner), len(text)
                columns = [
                    pa.array(np.concatenate([np.array([_node(s) for s in sets], np.int64), keys])),
                    pa.array(ids, pa.int64()).take(pa.array(np.concatenate([owner, text]))),
                    pa.array(np.concatenate([begin - first[owner], place]).astype(np.int32)),
                    pa.array(np.concatenate([end - begin, np.zeros(m, np.int64)]).astype(np.int32), mask=np.arange(n + m) >= n),
                    pa.array([*[s.tobytes() for s in signatures(sets, index)], *[None] * m], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", "begin", "words", "symbols"])

    return docs.mapInArrow(frugal(made), UNITS)


def paragraph_sets(docs: DataFrame, least: int, width: int, index: Bands) -> DataFrame:
    """The paragraphs' sets, columns as in ``SETS`` with the hash of a set as its id."""

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, texts in _texts(batch):
                words, _, _, begin, end = _lines(texts, least)
                sets = sets_between(words, begin, end, width)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), *set_columns(sets, index)], ["doc_id", "n", "signature", "sketch", "items"])

    return docs.mapInArrow(frugal(made), SETS)


def _islands(spans: DataFrame, *by: str) -> DataFrame:
    """``spans`` with the number (``_island``) of the run of overlapping ones that each is in, among those alike in ``by``."""
    order = Window.partitionBy(*by).orderBy("begin", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("begin") <= far, 0).otherwise(1))
    return spans.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def shared_spans(spans: DataFrame, passage: int) -> DataFrame:
    """``spans`` (``doc_id, begin, end, keep_id, node``) joined where they overlap and one document keeps them, with their
    ``component``: the least stretch (``node``) reached from theirs through documents in which stretches overlap.

    Where all that overlaps in a document, whoever keeps it, itself included, comes to fewer words than ``passage``, it goes.
    """
    island = Window.partitionBy("doc_id", "_island")
    spans = _islands(spans, "doc_id").withColumn("_size", F.max("end").over(island) - F.min("begin").over(island))
    spans = spans.withColumn("head", F.min("node").over(island)).where(F.col("_size") >= passage).drop("_island", "_size")
    spans = written(spans, "spans")
    roots = written(components(spans.select(F.col("node").alias("a"), F.col("head").alias("b"))), "passages")
    joined = _islands(spans, "doc_id", "keep_id").groupBy("doc_id", "keep_id", "_island")
    joined = joined.agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("head").alias("node")).drop("_island")
    return joined.join(small(roots, roots.count()), "node", "left").withColumn("component", F.coalesce("root", "node")).drop("node", "root")


def repeated_passages(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """Passages that occur in several documents: ``doc_id, kind, begin, end, component, keep_id, kept``.

    ``begin`` and ``end`` count words (runs of non-white bytes, A-Z as a-z) of the text from 0, the end exclusive;
    ``kind`` is ``paragraph`` (a line, or shorter ones joined) or ``stretch``. Of a component of paragraphs the smallest
    doc_id keeps its passages, the others can cut them. Stretches that overlap in some document are of one component. Stretches reach to the borders of the longest agreement: those not kept are shared with the
    smaller doc_id ``keep_id``, which has each of their words in a run of ``least`` of them or more; where larger ones agree
    further, the document has a kept row as well. Rows of one document and keeper are joined where they overlap; rows of several keepers can overlap.
    Stretches that come to fewer than ``passage`` words with all that they overlap are left out. Repeats within one
    document alone do not count. Null, empty and short texts have none; rows that repeat a doc_id count as one document;
    rows without a doc_id are left out; an empty table gives no rows; other columns are not read. A very long text is
    read whole, by one task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    index = Bands(tuned(percent))
    found = written(units(docs, least, width, passage, index), "units")
    lines = found.where("symbols is not null")
    classes = written(lines.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("symbols").alias("symbols")), "classes")

    def sets_of(involved: DataFrame) -> DataFrame:
        involved = involved.withColumnRenamed("doc_id", "node")
        homes = written(classes.join(involved, "node", "left_semi").select(F.col("low").alias("doc_id")).distinct(), "homes")
        at_home = docs.join(small(homes, homes.count()), "doc_id", "left_semi")
        sets = paragraph_sets(at_home, least, width, index)
        return sets.join(involved.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    roots = connected(classes.select(F.col("node").alias("doc_id"), F.col("symbols").alias("signature")), sets_of, index, percent)
    named = classes.join(roots, "node", "left").select("node", "low", "high", F.coalesce("root", "node").alias("component"))
    clusters = named.groupBy("component").agg(F.min("low").alias("keep_id"), F.max("high").alias("last")).where("keep_id <> last")
    named = written(named.join(clusters, "component").select("node", "component", "keep_id"), "repeated-paragraphs")
    done(classes, roots)
    near = lines.join(named, "node").select("doc_id", F.lit("paragraph").alias("kind"), "begin", (F.col("begin") + F.col("words")).alias("end"), "component", "keep_id")

    pieces = found.where("symbols is null").select("node", "doc_id", "begin")
    many = pieces.groupBy("node").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")).where("keep_id <> last").drop("last")
    pieces = written(pieces.join(spread(many), "node").select("doc_id", "begin", (F.col("begin") + least).alias("end"), "keep_id", "node"), "repeated-stretches")
    joined = shared_spans(extended(docs, pieces, least, passage - least), passage)
    joined = joined.select("doc_id", F.lit("stretch").alias("kind"), "begin", "end", "component", "keep_id")
    return near.unionByName(joined).withColumn("kept", F.col("doc_id") == F.col("keep_id"))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
