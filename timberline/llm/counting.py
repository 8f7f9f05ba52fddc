"""Token counts by finite-state transducers.

A byte-level merge vocabulary is compiled into a deterministic transducer: its states hold what later bytes of
a word can still depend on, and each transition carries by how much the word's token count changes. States are
made when a text first reaches them. Splitting into words depends on a few neighbouring characters only, so it
is done for all positions at once. Texts are cut into chunks of equal size that run side by side: behind its
first word start a chunk's state map is constant; for what lies before it, maps from the entry states that can
occur to exit state and count are made, and composed over all chunks by a parallel prefix scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.frugal import frugal

LIMIT = 1024
#: Bytes in a chunk, and of text handled at once.
CHUNK, BATCH = 256, 6_000_000
#: Transitions a worker keeps before it forgets all but the states that it is in.
KEPT = 1_000_000

#: Odd multiplier that spreads keys over a hash table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)

LETTER, NUMBER, OTHER, SPACE, OUTSIDE, UNKNOWN = range(6)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Characters:
    """Classes of code points, as the library's own pre-tokenizer tells them apart; asked once for each."""

    def __init__(self, splitter) -> None:
        self.splitter, self.known = splitter, np.full(0x110000, UNKNOWN, np.uint8)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        out = self.known[points]
        if (out == UNKNOWN).any():
            new = np.unique(points[out == UNKNOWN])
            self.known[new] = SPACE
            for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                text = "".join(f"\n{lead}{chr(c)}" for c in new)
                starts = np.array([s for _, (s, _) in self.splitter.pre_tokenize_str(text)])
                self.known[new[~np.isin(3 * np.arange(len(new)) + 2, starts)]] = kind
            out = self.known[points]
        return out


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a word (pre-token) starts at each position; positions of kind OUTSIDE part texts."""
    n = len(points)
    before = np.concatenate([[OUTSIDE], kinds[:-1]])
    after = np.concatenate([kinds[1:], [OUTSIDE]])
    blank = np.concatenate([[False], points[:-1] == 32])
    space = kinds == SPACE
    starts = np.where(space, (before != SPACE) | (after < SPACE), (kinds != before) & ~blank)
    quote = np.flatnonzero((points == 39) & (before != OTHER) & ~blank)
    if len(quote):
        far = np.concatenate([points, [0, 0, 0]])
        far[np.flatnonzero(kinds == OUTSIDE)] = 0
        one, two = far[quote + 1], far[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        starts[ends[ends < n]] = True
    return starts


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: visible Latin-1 ones as they are, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Trail:
    """State and count behind each byte that a run has passed, -1 elsewhere."""

    def __init__(self, n: int) -> None:
        self.state, self.count = np.full(n, -1, np.int32), np.zeros(n, np.int32)


def composed(chunk: np.ndarray, entry: np.ndarray, ends: np.ndarray, certain: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Which entries of the chunks' state maps are those of the text.

    Each is a pair of ``chunk`` and ``entry``; where ``on``, it leads to the next chunk's entry that it ends in. The maps
    are composed with themselves, 1, 2, 4 chunks on, so that after as many rounds as the number of chunks has bits
    all entries that follow from the ``certain`` ones are known.
    """
    codes = chunk << 32 | entry
    order = np.argsort(codes)
    after = np.arange(len(codes))
    after[on] = order[np.searchsorted(codes[order], (chunk[on] + 1) << 32 | ends[on])]
    reached = certain.copy()
    while True:
        reached[after[reached]] = True
        further = after[after]
        if (further == after).all():
            return reached
        after = further


class Transducer:
    """Counts tokens of words. A state lists, for each earlier cut from which a token may still grow, the place in
    the trie of tokens that the bytes since then reach, the last token before the cut, and the tokens since.

    A list of tokens is the encoding of its bytes just if each neighbouring pair is that of its own bytes, so the
    last token of every prefix of a word is the only one that fits the last token of the prefix before it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = ab
            self.parts[ab] = a, b
        self.sound: set[int] = {i for t, i in vocab.items() if len(t) == 1}
        for token in sorted(self.parts):
            a, b = self.parts[token]
            if a in self.sound and b in self.sound and self._apart(a, b, token):
                self.sound.add(token)
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.grows: list[bool] = [False]
        for word, token in vocab.items():
            if token not in self.sound:
                continue
            node = 0
            for byte in map(letters.__getitem__, word):
                self.grows[node] = True
                at = node << 8 | byte
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = self.child[at]
            self.token[node] = token
        self.fits = lru_cache(1 << 20)(self._apart)
        self.forget()

    def _apart(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether no merge made before ``limit`` joins ``a`` and ``b`` across their border. Ids are in order of merges."""
        while True:
            joined = self.rank.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b and a in self.parts or b not in self.parts:
                if a not in self.parts:
                    return True
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]  # equal merges are made from the left

    def forget(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.bits = 16
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.more = np.zeros(1 << self.bits, np.int16)
        self.used = 0

    def _compile(self, key: int) -> tuple[int, int]:
        """The state behind ``key`` (state and byte) and the change of the count."""
        byte, cuts, grown, last, since = key & 255, self.states[key >> 8], [], -1, 0
        for node, before, made in cuts:
            there = self.child.get(node << 8 | byte)
            if there is None:
                continue
            token = self.token[there]
            if token >= 0 and last < 0 and (before < 0 or self.fits(before, token)):
                last, since = token, made
            if self.grows[there]:
                grown.append((there, before, made))
        change = 1 - since
        state = tuple([*((node, before, made + change) for node, before, made in grown), (0, last, 0)])
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        return to, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where in the table of transitions each key is, or the free place for it."""
        mask = (1 << self.bits) - 1
        at = (keys.astype(np.uint64) * SPREAD >> np.uint64(32)).astype(np.int64) & mask
        there = self.keys[at]
        odd = np.flatnonzero((there != keys) & (there >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & mask
            there = self.keys[at[odd]]
            odd = odd[(there != keys[odd]) & (there >= 0)]
        return at

    def _add(self, keys: list[int]) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            kept = self.keys[old], self.to[old], self.more[old]
            while 2 * (self.used + len(keys)) > (1 << self.bits):
                self.bits += 2
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.to, self.more = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)
            self._put(*kept)
        found = [self._compile(k) for k in keys]
        self._put(np.array(keys, np.int64), np.array([f[0] for f in found], np.int32), np.array([f[1] for f in found], np.int16))
        self.used += len(keys)

    def _put(self, keys: np.ndarray, to: np.ndarray, more: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            at = self._slots(keys[left])
            self.keys[at] = keys[left]  # of several for one place the last one stays
            won = self.keys[at] == keys[left]
            self.to[at[won]], self.more[at[won]] = to[left[won]], more[left[won]]
            left = left[~won]

    def _shrink(self, live: list[np.ndarray], trail: Trail | None) -> None:
        """Forget all states but those in ``live``, which are numbered anew in place; a trail loses the others."""
        used = np.unique(np.concatenate([np.zeros(1, np.int64), *live]))
        number = np.full(len(self.states), -1, np.int64)
        number[used] = np.arange(len(used))
        states = [self.states[i] for i in used.tolist()]
        self.forget()
        self.states, self.number = states, {s: i for i, s in enumerate(states)}
        for held in live:
            held[:] = number[held]
        if trail is not None:
            trail.state[:] = np.where(trail.state >= 0, number[trail.state], -1)

    def _step(self, data: np.ndarray, place: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind the bytes at ``place``, and the changes of the counts."""
        keys = state << 8 | data[place]
        at = self._slots(keys)
        if len(new := np.flatnonzero(self.keys[at] < 0)):
            self._add(np.unique(keys[new]).tolist())
            at = self._slots(keys)
        return self.to[at], self.more[at]

    def run(self, data: np.ndarray, starts: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, trail: Trail | None = None, held: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """Run stretches of ``data`` side by side from the given states: their exit states and counts.

        A ``trail`` takes down the state and count behind every byte. ``held``: arrays of states that are still needed.
        """
        order = np.argsort(-length, kind="stable")
        begin, length, now = begin[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, "left"))
            p = begin[:m] + t
            now[:m], more = self._step(data, p, np.where(starts[p], 0, now[:m]))
            count[:m] += more
            if trail is not None:
                trail.state[p], trail.count[p] = now[:m], count[:m]
            if self.used > KEPT:
                self._shrink([now, *held], trail)
        out, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        out[order], counts[order] = now, count
        return out, counts

    def follow(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray, trail: Trail, ends: np.ndarray, counts: np.ndarray, held: tuple) -> tuple[np.ndarray, np.ndarray]:
        """As ``run`` within words, from other states than ``trail`` began with: a run that meets it has its end and rest."""
        now, count = state.astype(np.int64), np.zeros(len(begin), np.int64)
        ends = ends.copy()
        left, t = np.arange(len(begin)), 0
        while len(left):
            p = begin[left] + t
            now[left], more = self._step(data, p, now[left])
            count[left] += more
            met = trail.state[p] == now[left]
            count[left[met]] += (counts[left] - trail.count[p])[met]
            now[left[met]] = ends[left[met]]
            t += 1
            left = left[~met & (t < length[left])]
            if self.used > KEPT:
                self._shrink([now, ends, *held], trail)
        return now, count

    def stretches(self, data: np.ndarray, starts: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens in each stretch of ``data``; each starts with a word.

        Behind its first word start a chunk does not depend on the chunk before. What lies before it is the chunk's
        head, whose state map is made for the entry states that can occur: those in which maps of the chunk before
        end, at first the state of a new word. Runs from different states soon meet, so that two rounds over all
        heads at once close the maps of most texts; a run of one character takes as many as its tokens have phases.
        """
        chunks = -(-length // CHUNK)
        owner = np.repeat(np.arange(len(begin)), chunks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        low = begin[owner] + inner * CHUNK
        high = np.minimum(low + CHUNK, begin[owner] + length[owner])
        marks = np.flatnonzero(starts)
        first = np.minimum(np.concatenate([marks, [len(starts)]])[np.searchsorted(marks, low)], high)
        exits, counts = self.run(data, starts, first, high - first, np.zeros(len(low), np.int64))
        headed, whole = first > low, first == high
        heads = np.flatnonzero(headed)
        if len(heads):
            trail, place = Trail(len(data)), np.zeros(len(low), np.int64)
            place[heads] = np.arange(len(heads))
            chunk, entry = heads, np.where(whole[heads - 1], 0, exits[heads - 1])
            ends, tokens = self.run(data, starts, low[heads], (first - low)[heads], entry, trail, (entry,))
            base, new = tokens.copy(), slice(0, None)
            while True:
                on = whole[chunk[new]] & headed[np.minimum(chunk[new] + 1, len(low) - 1)] & (chunk[new] + 1 < len(low))
                codes = np.unique((chunk[new][on] + 1) << 32 | ends[new][on])
                codes = codes[~np.isin(codes, chunk << 32 | entry)]
                if not len(codes):
                    break
                more, state = codes >> 32, codes & 0xFFFFFFFF
                at = place[more]
                held = (entry, ends, state)
                out, n = self.follow(data, low[more], (first - low)[more], state, trail, ends[at], base[at], held)
                new = slice(len(chunk), None)
                chunk, entry, ends, tokens = (np.concatenate(x) for x in ((chunk, more), (entry, state), (ends, out), (tokens, n)))
            taken = composed(chunk, entry, ends, ~whole[chunk - 1], whole[chunk] & headed[np.minimum(chunk + 1, len(low) - 1)] & (chunk + 1 < len(low)))
            counts[chunk[taken]] += tokens[taken]
        return np.bincount(owner, counts, len(begin)).astype(np.int64)


class Counter:
    """Counts the tokens of texts as the library does, special strings included."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.machine, self.characters = Transducer(path), Characters(library.pre_tokenizer)

    def _parts(self, text: str) -> tuple[list[str], int]:
        parts, found = [text], 0
        for token in self.special:
            if token in text:
                parts = [q for p in parts for q in p.split(token)]
                found += text.count(token)
        return parts, found

    def counts(self, texts: list[str]) -> list[int]:
        if self.machine.used > KEPT:
            self.machine.forget()
        split = [self._parts(t) for t in texts]
        segments = [p for parts, _ in split for p in parts]
        joined = "\n".join([*segments, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        kinds = self.characters.kinds(points)
        chars = np.array([len(s) for s in segments])
        ends = np.cumsum(chars + 1) - 1
        kinds[ends] = OUTSIDE
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(wide)])
        starts = np.zeros(len(data), bool)
        starts[place[:-1]] = word_starts(points, kinds)
        begin = place[np.concatenate([[0], ends[:-1] + 1])]
        tokens = self.machine.stretches(data, starts, begin, place[ends] - begin)
        owner = np.repeat(np.arange(len(texts)), [len(parts) for parts, _ in split])
        return (np.bincount(owner, tokens, len(texts)).astype(np.int64) + [n for _, n in split]).tolist()


_loaded: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_bytes, n_tokens, over_limit``.

    Null counts as empty, with no bytes and no tokens; repeated rows are each counted; an empty table gives no
    rows; other columns are not read. No rows move between tasks; a text of any length is cut into chunks.
    """
    path = path or vocabulary_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
            low = 0
            while low < len(ids):
                high, held = low, 0
                while high < len(ids) and (high == low or held + sizes[high] <= BATCH):
                    held += sizes[high]
                    high += 1
                n = _loaded[path].counts([t or "" for t in texts.slice(low, high - low).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(sizes[low:high], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
                low = high

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(frugal(counted), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
