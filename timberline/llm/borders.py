"""Real borders of repeated stretches: how far the words around a stretch agree with those of other documents.

The words before (backwards) or behind a stretch are its context. Stretches with one key and one context are one class;
classes are sorted over all tasks, so that those that share their first words stand together. Chunks of that order are
worked on alone; what chunks share at their ends is put together in blocks of them, and blocks of blocks. So a stretch that
a third of all documents share spreads over tasks, and each agreement is the longest with any earlier (or later) document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.common import done, small, spread, written
from timberline.llm.frugal import frugal
from timberline.llm.shingles import batches, word_hashes
from timberline.llm.suffixes import grams

#: Bits of ``ask``: contexts to look at (before, behind), and whether the place's own agreement is wanted.
BEFORE, BEHIND, TELL_BEFORE, TELL_BEHIND = 1, 2, 4, 8
CONTEXT = "class long, node long, behind boolean, around binary, low long, high long, begin int"
CHUNK = 8192
#: Records that are joined at once.
BLOCKED = 4096
LEVELS = "class long, low long, high long, gone int, later int, size int, head int, tail int, who long, chunk string, edge binary"
RECORD = "chunk string, node long, behind boolean, around binary, last_node long, last_behind boolean, last_around binary, first_low array<long>, first_high array<long>, last_low array<long>, last_high array<long>"
BLOCK = RECORD + ", block string, first_head int, first_tail int, last_head int, last_tail int"


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def stretch_keys(words: np.ndarray, least: int, at: np.ndarray) -> np.ndarray:
    """Key of the ``least`` words from each place ``at`` on."""
    return grams(words, least)[at].astype(np.int64)


def asked(pieces: DataFrame, least: int, reach: int) -> DataFrame:
    """Rows ``doc_id, begin, node, ask`` of ``pieces`` (``doc_id, begin, end, node, keep_id``) whose contexts are needed.

    Within what neighbouring stretches cover nothing can be gained, so only keys with a place near a border of it are
    looked at, but these in all their places.
    """
    part = ["doc_id", F.col("doc_id") == F.col("keep_id")]
    order = Window.partitionBy(*part).orderBy("begin", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = pieces.withColumn("_new", F.when(F.col("begin") <= far, 0).otherwise(1))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*part, "_island")
    islands = islands.withColumn("_from", F.min("begin").over(island)).withColumn("_to", F.max("end").over(island))
    before = F.col("_from") > F.greatest(F.col("begin") - reach, F.lit(0))
    behind = F.col("_to") < F.col("begin") + least + reach
    own = islands.select("doc_id", "begin", "node", before.alias("_before"), behind.alias("_behind"))
    own = written(own, "places")
    keys = own.groupBy("node").agg(F.max("_before").alias("_some_before"), F.max("_behind").alias("_some_behind")).where("_some_before or _some_behind")
    ask = sum((F.when(F.col(c), bit).otherwise(0) for c, bit in (("_some_before", BEFORE), ("_some_behind", BEHIND), ("_before", TELL_BEFORE), ("_behind", TELL_BEHIND))), F.lit(0))
    out = written(own.join(spread(keys), "node").select("doc_id", "begin", "node", ask.alias("ask")), "asked")
    done(own)
    return out


def contexts(docs: DataFrame, places: DataFrame, least: int, reach: int) -> DataFrame:
    """The up to ``reach`` words around the stretches at ``places``, four bytes each; columns as in ``CONTEXT``.

    Two kinds of rows: a class of stretches with one context once for some texts, with the least and greatest document
    there; and the places that ask to be told, with their class and key, and the document in ``low``, and without the context.
    """

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            for start, some in batches(texts):
                lists = batch.column(2).slice(start, len(some))
                wanted = lists.flatten()
                owner = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
                place, node, ask = (wanted.field(c).to_numpy().astype(np.int64) for c in range(3))
                words, _, first = word_hashes(some)
                fits = place + least <= np.diff(first)[owner]  # another row of the same id may be shorter, or differ
                owner, place, node, ask = (x[fits] for x in (owner, place, node, ask))
                at = first[owner] + place
                same = stretch_keys(words, least, at) == node
                owner, place, node, ask, at = (x[same] for x in (owner, place, node, ask, at))
                ahead = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                ahead = ahead.astype(">u4")
                back = ahead[::-1].tobytes()
                ahead, n = ahead.tobytes(), len(words)
                for behind, look, tell in ((False, BEFORE, TELL_BEFORE), (True, BEHIND, TELL_BEHIND)):
                    which = np.flatnonzero(ask & look)
                    if behind:
                        low = at[which] + least
                        high = np.minimum(low + reach, first[owner[which] + 1])
                    else:
                        low = n - at[which]
                        high = np.minimum(low + reach, n - first[owner[which]])
                    source = ahead if behind else back
                    around = [source[4 * a : 4 * b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    keys = node[which].astype("<i8").tobytes()
                    known = pa.array([keys[8 * i : 8 * i + 8] + a for i, a in enumerate(around)], pa.binary()).dictionary_encode()
                    each, distinct = known.indices.to_numpy(), known.dictionary.to_pylist()
                    docs_of = ids[start + owner[which]]
                    least_doc, most_doc = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
                    np.minimum.at(least_doc, each, docs_of)
                    np.maximum.at(most_doc, each, docs_of)
                    prints = np.array([int.from_bytes(hashlib.blake2b(d, digest_size=8, person=bytes([behind])).digest(), "little", signed=True) for d in distinct], np.int64)
                    asks = (ask[which] & tell) > 0
                    n, m = len(distinct), int(asks.sum())
                    columns = [
                        pa.array(np.concatenate([prints, prints[each[asks]]])),
                        pa.array(np.concatenate([np.frombuffer(b"".join(d[:8] for d in distinct), np.int64), node[which][asks]])),
                        pa.array(np.full(n + m, behind)),
                        pa.array([*[d[8:] for d in distinct], *[None] * m], pa.binary()),
                        pa.array(np.concatenate([least_doc, docs_of[asks]])),
                        pa.array(np.concatenate([most_doc, docs_of[asks]])),
                        pa.array(np.concatenate([np.zeros(n, np.int32), place[which][asks].astype(np.int32)])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = [f.split(" ")[0] for f in CONTEXT.split(", ")]
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "node", "ask")).alias("places")).withColumnRenamed("doc_id", "_id")
    return docs.join(wanted, docs["doc_id"] == wanted["_id"]).select("doc_id", "text", "places").mapInArrow(frugal(made), CONTEXT)


def _padded(around: list[bytes], reach: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(a) // 4 for a in around], np.int64)
    out = np.zeros((len(around), reach), np.uint32)
    out[np.arange(reach) < size[:, None]] = np.frombuffer(b"".join(around), np.uint32)
    return out, size


def _chunk(rows: pa.RecordBatch, reach: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each class of a chunk the most words that it shares with an earlier document than its first and a later one
    than its last (-1: no such document), its size, what it shares with the chunk's ends, and that earlier document; and
    for the ends the least and greatest document by number of shared words."""
    low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
    node, behind = rows.column("node").to_numpy(), rows.column("behind").to_numpy(zero_copy_only=False)
    words, size = _padded(rows.column("around").to_pylist(), reach)
    differs = np.concatenate([words[1:] != words[:-1], np.ones((len(words) - 1, 1), bool)], axis=1)
    shared = np.where((node[1:] == node[:-1]) & (behind[1:] == behind[:-1]), differs.argmax(1), -1)
    gone, later, ends = np.full(len(low), -1), np.full(len(low), -1), np.zeros((4, reach + 1), np.int64)
    who = low.copy()
    for level in range(reach + 1):
        starts = np.flatnonzero(np.concatenate([[True], shared < level]))
        count = np.diff(np.append(starts, len(low)))
        least, most = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        first = np.repeat(least, count)
        gone[first < low] = level
        who = np.where(first < low, first, who)
        later[np.repeat(most, count) > high] = level
        ends[:, level] = least[0], most[0], least[-1], most[-1]
    head = np.minimum.accumulate(np.append(reach, shared))
    tail = np.minimum.accumulate(np.append(reach, shared[::-1]))[::-1]
    return [gone, later, size, head, tail, who], ends


def _levels(ordered: DataFrame, reach: int) -> DataFrame:
    """Columns as in ``LEVELS``: the classes, and one row a chunk with what is known of its ends in ``edge``."""

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                name, (columns, ends) = uuid.uuid4().hex, _chunk(part, reach)
                counts = [*[pa.array(c.astype(np.int32)) for c in columns[:-1]], pa.array(columns[-1])]
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("low"), part.column("high"), *counts, pa.array([name] * part.num_rows), pa.nulls(part.num_rows, pa.binary())], names)
                sink = pa.BufferOutputStream()
                borders = pa.Table.from_batches([part.slice(0, 1), part.slice(part.num_rows - 1, 1)]).select(["node", "behind", "around"])
                with pa.ipc.new_stream(sink, borders.schema.with_metadata({b"ends": ends.tobytes()})) as out:
                    out.write_table(borders.replace_schema_metadata({b"ends": ends.tobytes()}))
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (pa.int64(),) * 3 + (pa.int32(),) * 5 + (pa.int64(),)], pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names)

    names = _names(LEVELS)
    return ordered.mapInArrow(frugal(made), LEVELS)


def _records(levels: DataFrame) -> DataFrame:
    """What is known of the ends of chunks, columns as in ``RECORD``."""

    def made(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for name, edge in zip(batch["chunk"], batch["edge"], strict=True):
                with pa.ipc.open_stream(bytes(edge)) as stream:
                    t = stream.read_all()
                first, last = ((r["node"], r["behind"], r["around"]) for r in t.to_pylist())
                out.append((name, *first, *last, *np.frombuffer(t.schema.metadata[b"ends"], np.int64).reshape(4, -1)))
            yield pd.DataFrame(out, columns=_names(RECORD))

    return levels.where("edge is not null").select("chunk", "edge").mapInPandas(made, RECORD)


def _common(x: tuple, y: tuple, reach: int) -> int:
    """Words that two borders (stretch, side, context) share, -1 where the stretch or side is another."""
    if x[:2] != y[:2]:
        return -1
    differs = np.flatnonzero(np.diff(_padded([x[2], y[2]], reach)[0].astype(np.int64), axis=0)[0])
    return int(differs[0]) if len(differs) else reach


def _joined(rows: pd.DataFrame, reach: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Neighbouring records in order: the least and greatest document by number of shared words, of the first and last
    ends of all of them together, and what each end shares with the first and with the last one of all."""
    first, last = (list(zip(*(rows[f"{end}{c}"] for c in ("node", "behind", "around")), strict=True)) for end in ("", "last_"))
    line = [border for pair in zip(first, last, strict=True) for border in pair]
    shared = np.array([_common(x, y, reach) for x, y in zip(line[:-1], line[1:], strict=True)], int)
    values = []
    for column, join in (("low", np.minimum), ("high", np.maximum)):
        ends = np.stack([np.stack(rows[f"{end}_{column}"].to_numpy()) for end in ("first", "last")], 1).reshape(len(line), reach + 1)
        for level in range(reach + 1):
            starts = np.flatnonzero(np.concatenate([[True], shared < level]))
            ends[:, level] = np.repeat(join.reduceat(ends[:, level], starts), np.diff(np.append(starts, len(line))))
        values.append(ends)
    head = np.minimum.accumulate(np.append(reach, shared))
    tail = np.minimum.accumulate(np.append(reach, shared[::-1]))[::-1]
    return values, head, tail


def _blocks(ordered: DataFrame, reach: int) -> DataFrame:
    """Columns as in ``BLOCK``: each record joined with those of its block of neighbours, and one record for each block."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        (low, high), head, tail = _joined(rows, reach)
        inside = rows.assign(block=(name := uuid.uuid4().hex), first_low=list(low[::2]), first_high=list(high[::2]), last_low=list(low[1::2]), last_high=list(high[1::2]), first_head=head[::2], first_tail=tail[::2], last_head=head[1::2], last_tail=tail[1::2])
        whole = inside.iloc[:1].assign(chunk=name, block=None, **{f"last_{c}": rows[f"last_{c}"].iloc[-1:].to_numpy() for c in ("node", "behind", "around")}, last_low=[low[-1]], last_high=[high[-1]])
        return pd.concat([inside, whole])[_names(BLOCK)]

    def made(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in rows:
            held = batch if held is None else pd.concat([held, batch])
            while len(held) >= BLOCKED:
                yield block(held.iloc[:BLOCKED])
                held = held.iloc[BLOCKED:]
        if held is not None and len(held):
            yield block(held)

    return ordered.mapInPandas(made, BLOCK)


def _ends(records: DataFrame, reach: int) -> DataFrame:
    """``records`` with the least and greatest documents of their ends in all chunks.

    Blocks of neighbouring records are joined first, then what the blocks are in turn, until one block holds all; so no
    task and not the driver sees more than some blocks' records.
    """
    n, order = records.count(), ["node", "behind", "around"]
    parts = 1 if n <= BLOCKED else -(-n // (4 * BLOCKED)) + 1
    dealt = records.repartition(1) if parts == 1 else records.repartitionByRange(parts, *order)
    found = written(_blocks(dealt.sortWithinPartitions(*order), reach), "blocks")
    inside = found.where("block is not null")
    if n > BLOCKED:
        ends = [f"{end}_{column}" for end in ("first", "last") for column in ("low", "high")]
        whole = _ends(found.where("block is null").select(*_names(RECORD)), reach)
        whole = whole.select(F.col("chunk").alias("block"), *[F.col(c).alias(f"_{c}") for c in ends])

        def joined(end: str, column: str) -> Column:
            least = (lambda x, y: F.least(x, y)) if column == "low" else (lambda x, y: F.greatest(x, y))
            reached = lambda other, shared: F.transform(other, lambda x, at: F.when(at <= F.col(shared), x))
            head, tail = reached(f"_first_{column}", f"{end}_head"), reached(f"_last_{column}", f"{end}_tail")
            return F.zip_with(F.zip_with(f"{end}_{column}", head, least), tail, least)

        inside = inside.join(whole, "block").select(*_names(RECORD)[:7], *[joined(*c.split("_")).alias(c) for c in ends])
    return inside.select(*_names(RECORD))


def agreements(found: DataFrame, reach: int) -> DataFrame:
    """Rows ``doc_id, begin, node, behind, gone, who, later`` of the places of ``found`` (as in ``CONTEXT``) that ask to be told:
    words shared at most with an earlier document, which that is, and words shared at most with a later one; -1 if the
    stretch is in none."""
    spark = found.sparkSession
    found = written(found, "contexts")
    classes = found.where("around is not null").groupBy("node", "behind", "around").agg(F.first("class").alias("class"), F.min("low").alias("low"), F.max("high").alias("high"))
    classes = written(classes, "context-classes")
    order = ["node", "behind", "around"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    levels = written(_levels(classes.repartitionByRange(parts, *order).sortWithinPartitions(*order), reach), "levels")
    found_levels = levels
    ends = written(_ends(_records(levels), reach).select("chunk", "first_low", "first_high", "last_low", "last_high"), "ends")

    def most(column: str, shared: str, test) -> Column:
        return F.when(F.col(shared) >= 0, F.size(F.filter(F.slice(column, F.lit(1), F.col(shared) + 1), test)) - 1).otherwise(-1)

    def earlier(column: str, shared: str) -> Column:
        words = most(column, shared, lambda x: x < F.col("low"))
        return F.struct(words.alias("gone"), F.bitwise_not(F.get(column, F.greatest(words, F.lit(0)))).alias("who"))

    levels = levels.where("edge is null").join(small(ends, ends.count(), 4 * 8 * (reach + 1) + 64), "chunk")
    # Of several that share as many words the least document: bitwise not turns the order around, for every number.
    gone = F.greatest(F.struct("gone", F.bitwise_not("who").alias("who")), earlier("first_low", "head"), earlier("last_low", "tail"))
    after = [most(f"{end}_high", shared, lambda x: x > F.col("high")) for end, shared in (("first", "head"), ("last", "tail"))]
    levels = levels.select("class", "low", "high", "size", gone.alias("_gone"), F.greatest("later", *after).alias("_later"))
    told = found.where("around is null").select("class", "node", F.col("low").alias("doc_id"), "begin", "behind").join(spread(levels.withColumnRenamed("low", "first")), "class")
    behind_first = F.col("doc_id") > F.col("first")
    gone = F.when(behind_first, F.col("size")).otherwise(F.col("_gone.gone"))
    who = F.when(behind_first, F.col("first")).otherwise(F.bitwise_not(F.col("_gone.who")))
    later = F.when(F.col("doc_id") < F.col("high"), F.col("size")).otherwise(F.col("_later"))
    out = written(told.select("doc_id", "begin", "node", "behind", gone.alias("gone"), who.alias("who"), later.alias("later")), "agreements")
    done(found, classes, found_levels, ends)
    return out


def extended(docs: DataFrame, pieces: DataFrame, least: int, reach: int) -> DataFrame:
    """``pieces`` (``doc_id, begin, end, node, keep_id``) and what extends them: spans ``doc_id, begin, end, keep_id, node``.

    A piece of another document than its keeper is extended as far as an earlier document agrees: that document keeps
    the words of such a span, so that what is cut stays there. Where a later document agrees further, a span that the
    document itself keeps is added.
    """
    places = asked(pieces, least, reach)
    told = agreements(contexts(docs, places, least, reach), reach)
    done(places)
    span = lambda n: [F.when(F.col("behind"), F.col("begin")).otherwise(F.col("begin") - n).alias("begin"), F.when(F.col("behind"), F.col("begin") + least + n).otherwise(F.col("begin") + least).alias("end")]
    gone = told.where("gone > 0").select("doc_id", *span(F.col("gone")), F.col("who").alias("keep_id"), "node")
    kept = told.where("later > gone and later > 0").select("doc_id", *span(F.col("later")), F.col("doc_id").alias("keep_id"), "node")
    return pieces.select("doc_id", "begin", "end", "keep_id", "node").unionByName(gone).unionByName(kept)
