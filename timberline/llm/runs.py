"""Periodic runs of words, by Main and Lorentz's divide and conquer on interned word ids.

A run crosses the middle of exactly one of the nested halves of its text in which it lies whole. There, for each period
p, it shows in the agreement of the words around the middle with those p words to the left, or to the right: the
values of the four Z-functions at the middle, two looking forward and two back. Here all middles of one level of all
texts of a batch are looked at at once. Most periods fail on the first few words of that agreement; for the others the
Z-values are found by halving steps on hashes of stretches. What they give is extended over the ends of its half,
compared word by word, made distinct, and keeps its smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.frugal import frugal

#: A run has this many periods, and words, at least.
EXPONENT, LEAST = 4, 6
#: Words handled at once (a longer text by itself), periods tried at once, and first words of an agreement that are compared directly.
WORDS, PERIODS, DIRECT = 1 << 19, 1 << 20, 3
#: Prime moduli of the two hashes of a stretch, and the seed of their bases.
PRIMES, SEED = (2147483647, 2147483629), 13

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Stretches:
    """Whether stretches of one array of ids agree, by two polynomial hashes; ``agreeing`` finds how far they do."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n, self.sums, self.powers = len(ids), [], []
        random = np.random.default_rng(SEED)
        for prime in PRIMES:
            p = np.uint64(prime)
            value = random.integers(1, prime, int(ids.max(initial=0)) + 1, np.uint64)[ids]
            base = int(random.integers(1 << 20, prime))
            power, step = np.ones(self.n + 1, np.uint64), 1
            while step <= self.n:
                part = power[: min(step, self.n + 1 - step)]
                power[step : step + len(part)] = part * np.uint64(pow(base, step, prime)) % p
                step *= 2
            # Terms are below 2 ** 31, so 2 ** 33 of them can be summed.
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: self.n] % p)]) % p)
            self.powers.append(power)

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` ids from ``a`` on are those from ``b`` on, where ``a <= b``."""
        out = np.ones(len(a), bool)
        for prime, sums, power in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            left = (sums[a + length] + p - sums[a]) % p
            out &= left * power[b - a] % p == (sums[b + length] + p - sums[b]) % p
        return out

    def agreeing(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """For how many ids, ``most`` at most, stretches that begin at ``a`` and ``b`` (``back``: end before them) agree."""
        found = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            more = found + (1 << bit)
            some = np.flatnonzero(more <= most)
            shift = more[some] if back else -found[some]
            fits = self.same(a[some] - shift, b[some] - shift, np.full(len(some), 1 << bit))
            found[some[fits]] = more[some[fits]]
        return found


def _likely(ids: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs of places can agree for ``need`` ids in all, from them on and before them: by the longer side's first ones."""
    side = np.minimum((need + 1) // 2, DIRECT)
    ahead = behind = np.ones(len(a), bool)
    for j in range(DIRECT):
        asked = j >= side
        ahead = ahead & (asked | ((b + j < last) & (ids[np.minimum(a + j, len(ids) - 1)] == ids[np.minimum(b + j, len(ids) - 1)])))
        behind = behind & (asked | ((a - 1 - j >= first) & (ids[np.maximum(a - 1 - j, 0)] == ids[np.maximum(b - 1 - j, 0)])))
    return ahead | behind


def _crossing(ids: np.ndarray, stretches: list[Stretches], low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Repetitions ``begin, end, period`` around the middles of halves ``low`` to ``high`` of texts ``first`` to ``last``.

    For each period the middle is compared with the place a period to the left, and to the right.
    """
    middle, most = (low + high) // 2, (high - low) // EXPONENT
    each = np.repeat(np.arange(len(low)), most)
    period = np.arange(len(each)) - np.repeat(np.cumsum(most) - most, most) + 1
    need = np.maximum(LEAST, EXPONENT * period) - period
    found = []
    for right in (False, True):
        a = middle[each] - (0 if right else period)
        b = a + period
        inside = np.flatnonzero((a >= low[each]) & (b < high[each]))
        some = inside[_likely(ids, a[inside], b[inside], first[each[inside]], last[each[inside]], need[inside])]
        if not len(some):
            continue
        if not stretches:
            stretches.append(Stretches(ids))
        a, b, text = a[some], b[some], each[some]
        ahead = stretches[0].agreeing(a, b, last[text] - b)
        behind = stretches[0].agreeing(a, b, a - first[text], back=True)
        enough = ahead + behind >= need[some]
        found.append(np.stack([(a - behind)[enough], (b + ahead)[enough], period[some][enough]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """All runs ``text, start, length, period`` of texts whose ids begin at ``begins`` (the last one is the end), sorted.

    ``start`` counts from the text's first word. A text's periods at a level are a quarter of its words, so effort and
    memory for a batch are its words times the levels, and the logarithm of a run's length where there are runs.
    """
    first, last = begins[:-1], begins[1:]
    low, high, text = first, last, np.arange(len(first))
    stretches: list[Stretches] = []
    found = []
    while True:
        some = high - low >= LEAST
        low, high, text = low[some], high[some], text[some]
        if not len(low):
            break
        tried = np.cumsum((high - low) // EXPONENT)
        cuts = np.searchsorted(tried, np.arange(PERIODS, int(tried[-1]) + 1, PERIODS), "right")
        for part in np.split(np.arange(len(low)), np.unique(cuts)):
            if len(part):
                at = text[part]
                found.append(_crossing(ids, stretches, low[part], high[part], first[at], last[at]))
        middle = (low + high) // 2
        low, high, text = np.concatenate([low, middle]), np.concatenate([middle, high]), np.concatenate([text, text])
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    every = every[np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)])[: len(every)]]  # the smallest period of a stretch
    for begin, end, period in every.tolist():
        if not np.array_equal(ids[begin : end - period], ids[begin + period : end]):
            raise ArithmeticError("different words have one hash")
    at = np.searchsorted(begins, every[:, 0], "right") - 1
    return np.stack([at, every[:, 0] - begins[at], every[:, 1] - every[:, 0], every[:, 2]], 1)


def repeated(words: list[bytes], number: int) -> list[bytes]:
    """Words with a tail that repeats a part of them, where a tenth of ``number`` says so: the test rows of the query."""
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def described(words: list[bytes], found: np.ndarray) -> tuple:
    """The columns of a text behind its id, for its ``start, length, period`` rows."""
    rows = found.tolist()
    kept = words
    if rows:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in rows:
            drop[start + period] += 1
            drop[start + length] -= 1
        stay = np.cumsum(drop[:-1]) == 0
        kept = [words[i] for i in np.flatnonzero(stay)]
    best: tuple = (None,) * 4
    if rows:
        top = rows[0]
        for row in rows[1:]:  # in order of start and period, so the first of equals stays
            if row[1] * top[2] > top[1] * row[2]:
                top = row
        best = (*top, 1000 * top[1] // top[2])
    told = "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    return len(rows), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _batches(ids: list, texts: list[bytes | None], changed: bool) -> Iterator[list[tuple]]:
    """Texts as words, about ``WORDS`` together."""
    held, n = [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        words = (text or b"").split()  # at ASCII white space: the bytes of other characters are none of it
        if changed and doc_id is not None:
            words = repeated(words, zlib.crc32(str(doc_id).encode()))
        if held and n + len(words) > WORDS:
            yield held
            held, n = [], 0
        held.append((doc_id, words))
        n += len(words)
    if held:
        yield held


def collapsed(docs: DataFrame, changed: bool = False) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): its number of runs, its best one, and hashes of all of them and of
    the words that stay when each run keeps its first period.

    The best run has the greatest length over period; of equals that of the smallest start, then of the smallest
    period. Null and empty texts, and those of white space, have no run. A text is handled whole within one task,
    whatever its length, with memory in proportion to it. ``changed`` puts repetitions into a tenth of the rows by
    their id, as the query wants; rows without an id stay as they are. Rows that repeat an id are taken one by one; an
    empty table gives no rows; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in _batches(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), changed):
                number: dict[bytes, int] = {}
                flat = np.fromiter((number.setdefault(w, len(number)) for _, words in held for w in words), np.int64)
                begins = np.cumsum([0, *[len(words) for _, words in held]])
                found = runs(flat, begins)
                ends = np.searchsorted(found[:, 0], np.arange(len(held) + 1))
                rows = [(doc_id, *described(words, found[ends[i] : ends[i + 1], 1:])) for i, (doc_id, words) in enumerate(held)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns)], names=NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(frugal(work), SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "documents"), changed=True)
