"""Shingle sets and MinHash over batches of texts in numpy. Hashes have 64 bits and count as the shingles themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from timberline.llm.hashing import Multilinear

#: Bytes of text handled at once.
BATCH = 1_000_000


def _is_white() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


WHITE = _is_white()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_words = Multilinear(256, seed=3)
_steps = np.random.default_rng(5).integers(1, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def batches(texts: list[bytes], size: int = BATCH) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes, each with the place of its first text."""
    low = held = 0
    for high, text in enumerate(texts):
        if held and held + len(text) > size:
            yield low, texts[low:high]
            low, held = high, 0
        held += len(text) + 1
    if low < len(texts):
        yield low, texts[low:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-white bytes, A-Z as a-z), where each begins, and each text's first word."""
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    hashes = mixed(_words.hashes(data, starts, white))
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return hashes, starts, np.searchsorted(starts, begin)


def sets_between(words: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each stretch of words from ``first`` to before ``last``; of one
    with fewer words than ``width``, of its words as one; empty without words."""
    n = len(words) - width + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        joined += words[j : j + n] * _steps[j]
    joined = mixed(joined)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _steps[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle sets of whole texts."""
    words, _, first = word_hashes(texts)
    return sets_between(words, first[:-1], first[1:], width)


def minhashes(sets: list[np.ndarray], n: int, seed: int = 7) -> np.ndarray:
    """``n`` MinHash values of each set, spread over 64 bits; zeros for an empty set."""
    out = np.zeros((len(sets), n), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
        odd = np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)
        for j in range(n):
            out[full, j] = np.minimum.reduceat(flat * odd[j], starts)
    return mixed(out)
