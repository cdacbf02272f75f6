"""Vectorised words and shingles of many texts at once, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[0:48] = _WORD[58:97] = _WORD[123:128] = False
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    got = _powers.get(base, np.ones(1, np.uint64))
    while len(got) < n:
        got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
    _powers[base] = got
    return got[:n]


def batches(sizes, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of up to ``limit`` bytes; a larger row is a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a zero byte, and where each text starts."""
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return np.frombuffer(b"\0".join(raw) + b"\0", np.uint8), starts


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word number of each text with the total at the end).

    A word is a run of digits, letters a-z (A-Z count as a-z) and bytes of other code points.
    """
    data, starts = joined(raw)
    data = _LOWER[data]
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_STEP, len(data)), out=sums[1:])
    found = mix((sums[end] - sums[begin]) * powers(_BACK, len(data))[begin])
    return found, np.searchsorted(begin, starts)


def shingles(raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``width`` words; a text of fewer words, but not none, is one run."""
    words, first = word_hashes(raw)
    count = np.diff(first)
    text = np.repeat(np.arange(len(raw)), count)
    short = np.flatnonzero((count > 0) & (count < width))
    n = len(words) - width + 1
    if n > 0:
        acc = np.zeros(n, np.uint64)
        for k in range(width):
            acc = acc * np.uint64(_STEP) + words[k : n + k]
        whole = text[:n] == text[width - 1 :]
        text, acc = text[:n][whole], mix(acc[whole])
    else:
        text, acc = text[:0], words[:0]
    if len(short):
        few = [np.uint64(0)] * len(short)
        with np.errstate(over="ignore"):
            for i, t in enumerate(short):
                for w in words[first[t] : first[t + 1]]:
                    few[i] = few[i] * np.uint64(_STEP) + w
        text, acc = np.concatenate([text, short]), np.concatenate([acc, mix(np.array(few, np.uint64) + np.uint64(1))])
    return text, acc
