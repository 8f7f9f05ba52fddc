"""Packing tokenised documents into sequences by the sum-of-squares rule.

Texts are tokenised where they lie; only narrow rows, one per piece, are dealt out by a hash into groups of a
bounded number of pieces. Each group is packed in one task, so that no task grows with the input.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table, written
from timberline.llm.frugal import frugal
from timberline.llm.hashing import Multilinear, Numbering

LENGTH = 4096
END = 1
#: Pieces in a group, on average.
GROUP = 20_000
#: Distinct words that a worker remembers.
REMEMBERED = 600_000
#: Code points that are cut at white space and handled at once.
BLOCK = 1 << 18

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Outside of these, normalisation and lower case need the library itself.
_PLAIN = re.compile(r"[\x00-\u012f\u0131-\u017f]*")
_BREAK = re.compile(r"[ \t-\r]")
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


def _kinds() -> np.ndarray:
    """Kinds of the code points below U+0180, by their general category."""
    out = np.full(0x180, _OTHER, np.uint8)
    for c in range(0x180):
        category = unicodedata.category(chr(c))[0]
        out[c] = _SPACE if category == "Z" or c in (9, 10, 11, 12, 13, 0x85) else {"L": _LETTER, "N": _NUMBER}.get(category, _OTHER)
    return out


_KINDS = _kinds()
_BLANK = "".join(chr(c) for c in np.flatnonzero(_KINDS == _SPACE))


def word_starts(points: np.ndarray) -> np.ndarray:
    """Whether the vocabulary's splitting rule starts a word at each place of a lower-case plain text.

    Words are runs of letters, single numbers, runs of other characters, and 's 't 'm 'd 're 've 'll.
    """
    kinds = _KINDS[points]
    before = np.concatenate([[_SPACE], kinds[:-1]])
    starts = (kinds != _SPACE) & ((kinds != before) | (kinds == _NUMBER))
    quote = np.flatnonzero((points == 39) & (before != _OTHER))
    if len(quote):
        far = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = far[quote + 1], far[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        ends = ends[ends < len(points)]
        starts[ends[kinds[ends] != _SPACE]] = True
    return starts


def _grown(old: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``old`` with ``more`` from place ``used`` on, in a larger array if need be."""
    if used + len(more) > len(old):
        old = np.concatenate([old, np.zeros(used + 2 * len(more), old.dtype)])
    old[used : used + len(more)] = more
    return old


class WordTokenizer:
    """Token ids as the library gives them; the ids of a word are looked up once, by its 64-bit hash.

    The vocabulary's pre-tokenizer drops white space and its merges never cross a word, so a text's ids are
    those of its words in a row. Texts with code points from U+0180 on, with U+0130, or with a special token's
    string, go to the library as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.library.get_vocab_size(), bool)  # ids that end a word
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.hash = Multilinear(0x180)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.used = Numbering(), 0
        self.count, self.begin, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Ask the library for new words, some hundred of them in a line; each ends with an id of its own kind."""
        lines = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        for low in range(0, len(lines), 100):
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch(lines[low : low + 100], add_special_tokens=False)])
            counts = np.diff(np.flatnonzero(self.last[ids]), prepend=-1).astype(np.int32)
            part = keys[low * 200 : (low + 100) * 200]
            if len(counts) != len(part):
                raise ValueError("the vocabulary does not end each word with an id of its own kind")
            known = self.numbers.used
            self.numbers.add(part)
            self.begin = _grown(self.begin, known, self.used + np.cumsum(counts, dtype=np.int64) - counts)
            self.count = _grown(self.count, known, counts)
            self.flat = _grown(self.flat, self.used, ids)
            self.used += len(ids)

    def _gather(self, blocks: list[str]) -> list[np.ndarray]:
        """The ids of each block of lower-case plain text."""
        text = "\n".join(blocks)
        points = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        starts = np.flatnonzero(word_starts(points))
        keys = self.hash.hashes(points, starts, _KINDS[points] == _SPACE)
        at = self.numbers.find(keys)
        if (at < 0).any():
            new, first = np.unique(keys[at < 0], return_index=True)
            places = np.flatnonzero(at < 0)[first]
            ends = np.append(starts, len(text))[places + 1]
            self._learn(new, [text[a:b].strip(_BLANK) for a, b in zip(starts[places].tolist(), ends.tolist(), strict=True)])
            at = self.numbers.find(keys)
        n = self.count[at]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.flat[np.repeat(self.begin[at] - ends[:-1], n) + np.arange(ends[-1])]
        if self.numbers.used > REMEMBERED:
            self.forget()
        borders = np.cumsum([len(b) + 1 for b in blocks[:-1]])
        return np.split(ids, ends[np.searchsorted(starts, borders)])

    def many(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        owners: list[int] = []
        blocks: list[str] = []
        queued = 0

        def flush() -> None:
            for i, ids in zip(owners, self._gather(blocks) if blocks else [], strict=True):
                out[i].append(ids)
            owners.clear()
            blocks.clear()

        for i, text in enumerate(texts):
            if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
                out[i].append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            text, at = text.lower(), 0
            while at < len(text):
                m = _BREAK.search(text, at + BLOCK) if len(text) - at > BLOCK else None
                end = m.start() if m else len(text)
                owners.append(i)
                blocks.append(text[at:end])
                queued, at = queued + end - at, end
                if queued > BLOCK:
                    flush()
                    queued = 0
        flush()
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.uint32), *p]) for p in out]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


_loaded: dict[str, WordTokenizer] = {}


def cut(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Tokens of every text with the end id behind them, in pieces of ``length``; only the last may be shorter.

    Columns as in ``PIECES``; with ``with_ids`` also ``ids``. Null counts as empty: one piece, the end id alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordTokenizer(path)
        known = _loaded[path]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, len(ids), 512):
                rows: list[tuple] = []
                found = known.many([t or "" for t in texts.slice(low, 512).to_pylist()])
                for i, tokens in zip(ids.slice(low, 512).to_pylist(), found, strict=True):
                    tokens = np.append(tokens, np.uint32(END)).astype("<u4")
                    for k, start in enumerate(range(0, len(tokens), length)):
                        part = tokens[start : start + length]
                        rows.append((i, k, start, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: len(columns)])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(frugal(pieces), PIECES + (", ids array<long>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items are taken from the longest to the shortest, in the given order among equals.

    Each goes where the sum over gaps of (open bins with that gap) squared becomes smallest: into a bin with
    one of the gaps, or into a new bin. Full bins have no gap. Among equal choices the smallest gap wins.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, top = 0, 0  # top: no open bin has a larger gap
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        best, gap = (2 * n[capacity - s] + 1 if s < capacity else 0), capacity
        if s <= top:
            have = n[s : top + 1]
            left = n[: top + 1 - s].copy()
            left[0] = 0
            change = 2 * (left - have) + 2
            change[0] -= 1
            change[have == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if have[k] and change[k] <= best:
                gap = s + k
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i], rest = b, capacity - gap, gap - s
        if rest:
            open_bins[rest].append(b)
            n[rest] += 1
            top = max(top, rest)
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written table as of ``cut``, at most ``length`` long) with ``sequence_id`` and ``offset``, gapless from 0.

    Groups are even whatever the ids are, and each is packed by itself.
    """
    groups = max(1, -(-n_pieces // group))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[PACKED.replace(" long", "").replace(" int", "").split(", ")]

    # The number of a row tells rows with one doc_id, or none, apart; which group a piece is in is all that it decides.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(one, PACKED)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """All of ``docs`` (``doc_id, text``) cut and packed; columns as in ``PACKED``.

    A null or empty text is a piece of one id; repeated rows are packed each; an empty table gives no rows; a
    null doc_id stays null; other columns are not read.
    """
    pieces = written(cut(docs, path or tokenizer_path(), length), "pieces")
    return pack(pieces, pieces.count(), length)
