"""Near-duplicates by MinHash and a multi-index join under Hamming distance.

A signature has ``SYMBOLS`` b-bit MinHash symbols (b = 16) in chunks of ``CHUNK``. Two signatures that differ in
at most ``2 * chunks - 1`` symbols have, by the pigeonhole principle, a chunk with at most one error; so each
chunk is indexed once for every symbol that may be the wrong one, and all pairs within that distance share a key.
Sets with a Jaccard similarity of 0.8 exceed it with a probability of 3e-6.

Documents with one shingle set are one class from the start. Under a key the classes are tied to one hub, never
to each other; each tie is confirmed on the full sets, best ties first, and only ties between components that are
still apart are looked at further. At last, keys that still hold several components are searched for likely pairs:
what is outside a key's largest component is cut into blocks, and all members of the key are streamed past them. What
likely pairs connect is compared on the full sets in the same way, and only links that join components leave a task.
So no link between components is lost, and pairs are never written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import done, small, spread, table, written
from timberline.llm.components import components
from timberline.llm.exact import mark
from timberline.llm.frugal import frugal
from timberline.llm.shingles import batches, minhashes, shingle_sets

SYMBOLS, CHUNK = 48, 4
#: Symbols of one byte in the sketch that rules pairs out before sets are compared.
SKETCH = 256
#: Members of a key in a block, in a part of the stream that passes it, and rows of the stream that are held at once.
BLOCK, PART, STREAM = 4096, 65_536, 256
#: The same for members of a cluster, by the bytes of their sets.
BLOCK_BYTES, PART_BYTES = 8_000_000, 256_000_000
WIDTH, PERCENT = 4, 80

SIGNED = "doc_id long, mark binary, n_shingles long, set_id binary, signature binary"
SETS = "doc_id long, n long, signature binary, sketch binary, items binary"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).fill_null(b"")
    for low in range(0, len(ids), 1024):
        part = texts.slice(low, 1024).to_pylist()
        for start, some in batches(part):
            yield ids.slice(low + start, len(some)), some


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    return (minhashes(sets, SKETCH, seed=8) >> np.uint64(56)).astype(np.uint8)


class MultiIndex:
    """Keys of a signature for the Hamming join: each chunk without one of its symbols, for every one of them."""

    symbols = keys = SYMBOLS

    def of(self, signatures: np.ndarray) -> np.ndarray:
        chunks = signatures.astype(np.int64).reshape(len(signatures), -1, CHUNK)
        out = np.empty((len(signatures), self.keys), np.int64)
        for k in range(self.keys):
            a, b, d = (chunks[:, k // CHUNK, i] for i in range(CHUNK) if i != k % CHUNK)
            out[:, k] = k << 48 | a << 32 | b << 16 | d
        return out


class Bands:
    """Keys of a signature for banding: its place and the three symbols of each band."""

    rows = 3

    def __init__(self, bands: int) -> None:
        self.keys, self.symbols = bands, bands * self.rows

    def of(self, signatures: np.ndarray) -> np.ndarray:
        s = signatures.astype(np.int64).reshape(-1, self.keys, self.rows)
        return np.arange(self.keys) << 48 | s[:, :, 0] << 32 | s[:, :, 1] << 16 | s[:, :, 2]


Index = MultiIndex | Bands


def signatures(sets: list[np.ndarray], index: Index) -> np.ndarray:
    return (minhashes(sets, index.symbols) >> np.uint64(48)).astype(np.uint16)


def most_errors(n: int, percent: int, deviations: float = 5.0) -> int:
    """Symbols of ``n`` that two sets at the threshold may differ in, up to that many standard deviations."""
    p = 1 - percent / 100
    return int(n * p + deviations * (n * p * (1 - p)) ** 0.5)


def signed(docs: DataFrame, width: int, index: Index) -> DataFrame:
    """Number of shingles, hash of the set and signature of each row of ``docs`` (``doc_id, text, mark``)."""

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            low = 0
            for ids, texts in _texts(batch):
                sets = shingle_sets(texts, width)
                n = [len(s) for s in sets]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(low, len(ids)), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in signatures(sets, index)], pa.binary())], ["doc_id", "mark", "n_shingles", "set_id", "signature"])
                low += len(ids)

    return docs.select("doc_id", "text", "mark").mapInArrow(frugal(made), SIGNED)


def set_columns(sets: list[np.ndarray], index: Index) -> list[pa.Array]:
    """``n, signature, sketch, items`` of the sets."""
    columns = [[s.tobytes() for s in x] for x in (signatures(sets, index), _sketches(sets), sets)]
    return [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]]


def full_sets(docs: DataFrame, width: int, index: Index) -> DataFrame:
    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for ids, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([ids, *set_columns(shingle_sets(texts, width), index)], ["doc_id", "n", "signature", "sketch", "items"])

    return docs.mapInArrow(frugal(made), SETS)


def keyed(signed: DataFrame, index: Index) -> DataFrame:
    """Rows ``key, doc_id`` of rows ``doc_id, signature``."""

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                found = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, index.symbols)
                yield pa.RecordBatch.from_arrays([pa.array(index.of(found).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), index.keys))], ["key", "doc_id"])

    return signed.select("doc_id", "signature").mapInArrow(frugal(made), "key long, doc_id long")


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    left = sets.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = sets.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(left, "a").join(right, "b")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, errors`` of the pairs whose sizes and sketches allow the similarity."""
    most = most_errors(SKETCH, percent)

    def kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("a_sketch", "b_sketch"))
            errors = (a != b).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(errors.astype(np.int64))], ["a", "b", "errors"]).filter(pa.array(errors <= most))

    joined = _both(pairs, sets, "n", "sketch").where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    return joined.select("a", "b", "a_sketch", "b_sketch").mapInArrow(frugal(kept), "a long, b long, errors long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            good = []
            for a, b in zip(batch.column("a_items"), batch.column("b_items"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _both(pairs.select("a", "b"), sets, "items").select("a", "b", "a_items", "b_items").mapInArrow(frugal(kept), "a long, b long")


def _dealt(members: DataFrame, group: str, weight: Column, block: int, stream: int, *columns: str) -> DataFrame:
    """Members of each group (``doc_id, root``) so dealt that every two of different components meet in one unit.

    The members of a group's largest component never meet each other. The others are cut into blocks of about ``block``
    (by ``weight``), and all members are a stream that passes every block, in parts of about ``stream``: a unit is a
    block and a part. So a member has a row for each block and, if it is in one, for each part; their numbers grow with
    what is outside the largest component, not with pairs. Rows of a unit stand together, those of the block first.
    """
    sized = members.withColumn("_weight", weight)
    inside = sized.groupBy(group, "root").agg(F.count(F.lit(1)).alias("_n"), F.sum("_weight").alias("_w"))
    top = F.max(F.struct("_n", "_w", "root"))
    known = inside.groupBy(group).agg(top.alias("_top"), F.sum("_w").alias("_all")).where("_all is not null")
    known = known.select(group, F.col("_top.root").alias("_largest"), F.greatest(F.lit(1), F.ceil((F.col("_all") - F.col("_top._w")) / block)).cast("int").alias("_blocks"), F.greatest(F.lit(1), F.ceil(F.col("_all") / stream)).cast("int").alias("_parts"))
    dealt = sized.join(spread(known), group).withColumn("big", F.col("root") == F.col("_largest"))
    own = F.pmod(F.xxhash64("doc_id"), "_blocks").cast("int")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), "_parts").cast("int")
    units = lambda blocks, parts, streams: F.transform(blocks, lambda b: F.transform(parts, lambda p: F.struct(b.alias("block"), p.alias("part"), F.lit(streams).alias("streams"))))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = F.when(F.col("big"), F.array().cast("array<struct<block:int,part:int,streams:boolean>>")).otherwise(F.flatten(units(F.array(own), every("_parts"), False)))
    dealt = dealt.withColumn("_unit", F.explode(F.concat(held, F.flatten(units(every("_blocks"), F.array(part), True)))))
    dealt = dealt.select(group, "_unit.block", "_unit.part", "_unit.streams", "big", *columns)
    return dealt.repartition(group, "block", "part").sortWithinPartitions(group, "block", "part", "streams")


class _Side:
    """Rows of a block, or some of a stream, as arrays."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows
        self.doc, self.root, self.n = (rows.column(c).to_numpy() for c in ("doc_id", "root", "n"))
        self.big = rows.column("big").to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, bool)
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, SKETCH)

    def near(self, other: _Side, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs with ``other``, of a stream: in different components, of like size, each pair once."""
        n, m = self.n[:, None], other.n
        near = (self.root[:, None] != other.root) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        return np.nonzero(near & (other.big | (self.doc[:, None] < other.doc)))

    def alike(self, other: _Side, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
        """Which of the pairs have sketches that allow the similarity."""
        step = 20_000
        return np.concatenate([np.zeros(0, bool), *[(self.sketch[left[at : at + step]] != other.sketch[right[at : at + step]]).sum(1) <= most for at in range(0, len(left), step)]])


def _by_unit(dealt: DataFrame, group: str, opened: Callable[[pa.Table], Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Pairs ``a, b`` found where the blocks of ``dealt`` meet their streams, of which a task holds ``STREAM`` rows at once.

    ``opened`` gets the rows of a block, and returns what finds pairs between it and rows of the stream.
    """
    names = (group, "block", "part")

    def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, meet = None, [], None
        for batch in rows:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            columns = [whole.column(c).to_numpy(zero_copy_only=False) for c in (*names, "streams")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(whole)], strict=True):
                part, name = whole.slice(low, high - low), tuple(x[low] for x in columns[:3])
                if name != unit:
                    unit, held, meet = name, [], None
                if not columns[3][low]:
                    held.append(part)
                    continue
                if meet is None:
                    meet = opened(pa.concat_tables(held)) if held else lambda _: (np.zeros(0, np.int64),) * 2
                    held = []
                for at in range(0, part.num_rows, STREAM):
                    a, b = meet(part.slice(at, STREAM))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(frugal(made), "a long, b long")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member that each of ``n`` reaches by the pairs."""
    least = np.arange(n)
    while len(left):
        before = least.copy()
        np.minimum.at(least, left, least[right])
        np.minimum.at(least, right, least[left])
        least = least[least]
        if (least == before).all():
            break
    return least


def across(members: DataFrame, index: Index, percent: int) -> DataFrame:
    """Ties ``a, b`` that connect what likely pairs of different components under one key connect.

    ``members``: ``key, doc_id, root, n, signature, sketch``. Of what a block and some of its stream have in common at
    most one tie for each member comes out. Each pair is looked at under its first common key only.
    """
    most = most_errors(SKETCH, percent)

    def opened(rows: pa.Table) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
        symbols = lambda t: index.of(np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(t.num_rows, -1))
        block, mine, place = _Side(rows), symbols(rows), int(rows.column("key")[0].as_py()) >> 48

        def meet(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            stream, theirs = _Side(some), symbols(some)
            left, right = block.near(stream, percent)
            for k in range(place):
                first = mine[left, k] != theirs[right, k]
                left, right = left[first], right[first]
            alike = block.alike(stream, left, right, most)
            left, right = left[alike], right[alike] + len(block.doc)
            docs = np.concatenate([block.doc, stream.doc])
            least = _forest(len(docs), left, right)
            tied = np.flatnonzero(least != np.arange(len(least)))
            return docs[tied], docs[least[tied]]

        return meet

    return _by_unit(_dealt(members, "key", F.lit(1), BLOCK, PART, "doc_id", "root", "n", "signature", "sketch"), "key", opened)


def within(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join components, confirmed on the full sets: at most one for each component and unit.

    ``members``: ``cluster, doc_id, root, n, sketch, items``. A unit's block is bounded by the bytes of its sets.
    """
    most = most_errors(SKETCH, percent)

    def opened(rows: pa.Table) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
        block = _Side(rows)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("items")]
        starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        items, place = np.unique(np.concatenate(sets), return_inverse=True)
        mark, parent = np.zeros(len(items), bool), {}

        def top(r: int) -> int:
            while parent.get(r, r) != r:
                parent[r] = parent.get(parent[r], parent[r])
                r = parent[r]
            return r

        def meet(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            stream = _Side(some)
            left, right = block.near(stream, percent)
            alike = block.alike(stream, left, right, most)
            left, right = left[alike], right[alike]
            found = []
            order = np.argsort(right, kind="stable")
            left, right = left[order], right[order]
            cuts = np.flatnonzero(np.diff(right)) + 1
            for mine, j in zip(np.split(left, cuts), right[np.append(0, cuts)] if len(right) else [], strict=False):
                theirs = np.frombuffer(some.column("items")[int(j)].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(items, theirs), len(items) - 1)
                hit = at[items[at] == theirs]
                mark[hit] = True
                for i in mine.tolist():
                    a, b = top(int(block.root[i])), top(int(stream.root[j]))
                    if a == b:
                        continue
                    both = int(mark[place[starts[i] : starts[i] + len(sets[i])]].sum())
                    if 100 * both >= percent * (block.n[i] + stream.n[j] - both):
                        parent[max(a, b)] = min(a, b)
                        found.append((block.doc[i], stream.doc[j]))
                mark[hit] = False
            return tuple(np.array([f[k] for f in found], np.int64) for k in range(2))

        return meet

    return _by_unit(_dealt(members, "cluster", F.col("n") * 8 + 300, BLOCK_BYTES, PART_BYTES, "doc_id", "root", "n", "sketch", "items"), "cluster", opened)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after joining components by ``links`` between their members; both tables are done with then."""
    named = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    found = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    found = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = written(roots.join(found, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    done(roots, links)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    named = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    return named.where("ra <> rb").drop("ra", "rb")


def connected(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], index: Index, percent: int) -> DataFrame:
    """Components of similar classes: ``node, root`` for every class that shares a key with another.

    ``classes``: ``doc_id, signature``, ids distinct and not null. ``sets_of`` gives the rows of ``SETS`` for the
    ids in a table ``doc_id``.
    """
    keys = keyed(classes, index)
    # Masked by the key, a class that is the least under one key is not so under another: hubs differ.
    hubs = keys.groupBy("key").agg((F.min(F.col("doc_id").bitwiseXOR(F.col("key")))).alias("masked"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = written(hubs.select("key", F.col("masked").bitwiseXOR(F.col("key")).alias("hub")), "hubs")
    tied = written(keys.join(hubs, "key").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "ties")
    involved = written(tied.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
    sets = written(sets_of(involved), "sets")
    ties = written(likely(tied, sets, percent), "likely-ties")
    best = ties.groupBy("a").agg(F.min(F.struct("errors", "b"))["b"].alias("b"))
    roots = written(involved.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root")), "roots")
    done(tied, involved)
    roots = _merged(roots, written(confirmed(best, sets, percent), "links"))
    roots = _merged(roots, written(confirmed(_apart(ties, roots), sets, percent), "links"))
    named = roots.withColumnRenamed("node", "doc_id")
    held = written(keyed(sets, index).join(hubs.select("key"), "key").join(named, "doc_id"), "members")
    done(ties, hubs)
    mixed = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    members = held.join(spread(mixed), "key", "left_semi").join(sets.select("doc_id", "n", "signature", "sketch"), "doc_id")
    likely_ones = written(across(members, index, percent), "likely-pairs")
    done(held)
    clusters = components(likely_ones).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    clusters = written(clusters, "clusters")
    members = clusters.join(named, "doc_id").join(sets.select("doc_id", "n", "sketch", "items"), "doc_id")
    links = written(within(members, percent), "links")
    done(likely_ones, clusters, sets)
    return _merged(roots, links)


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of ``docs`` (``doc_id, text``) by themselves: ``row, doc_id, mark, n_shingles, component``.

    ``component`` is null where a text has no shingle; ``mark`` names the text of a row. Rows with one set of shingles
    are one class, and are compared with others once.
    """
    docs, index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", mark(F.col("text")).alias("mark")), MultiIndex()
    marks = written(signed(docs, width, index).withColumn("row", F.monotonically_increasing_id()), "signatures")
    home = F.min(F.struct("doc_id", "mark")).alias("home")
    classes = marks.where("n_shingles > 0").groupBy("set_id").agg(home, F.first("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    again = bool(marks.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1))

    def sets_of(involved: DataFrame) -> DataFrame:
        homes = classes.select("node", F.col("home.doc_id").alias("_id"), F.col("home.mark").alias("_mark"))
        homes = written(homes.join(involved.withColumnRenamed("doc_id", "node"), "node", "left_semi"), "homes")
        found = docs.join(small(homes, homes.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "text")
        return full_sets(found.dropDuplicates(["node"]) if again else found, width, index)

    roots = connected(classes.select(F.col("node").alias("doc_id"), "signature"), sets_of, index, percent)
    named = classes.join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("component"))
    return marks.join(named, "set_id", "left").select("row", "doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``.

    Words are runs of non-white bytes with A-Z in lower case; a text with fewer words than ``width`` is one shingle,
    a null or empty one has none and is linked with nothing. Documents are linked where ``100 * intersection >=
    percent * union``; a component is named by its smallest doc_id. Rows that repeat a doc_id are documents of their
    own, linked by their texts. A null doc_id is linked with nothing: its component is null, and it is kept. An empty
    table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(grouped(docs.where("doc_id is not null"), width, percent), "grouped")
    names = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = found.join(spread(names), "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = signed(docs.where("doc_id is null").withColumn("mark", F.lit(b"")), width, MultiIndex()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def decided(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Which rows of ``docs`` stay, as ``exact.kept_documents`` takes it: ``doc_id, mark, kept``, one row for each.

    Of a component the row with the smallest doc_id stays, a null one last, and one alone: rows that repeat a doc_id,
    have none, or are equal throughout, are compared by their texts like all others. Rows without a word all stay.
    """
    found = written(grouped(docs.select("doc_id", "text"), width, percent), "grouped")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row"))["row"]
    first = found.where("component is not null").groupBy("component").agg(best.alias("_first"))
    found = found.join(spread(first), "component", "left")
    return found.select("doc_id", "mark", F.coalesce(F.col("row") == F.col("_first"), F.lit(True)).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
