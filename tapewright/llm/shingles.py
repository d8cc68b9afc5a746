"""Word shingles of whole texts as sorted arrays of 62-bit hashes (numpy, per batch)."""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 20  # bytes hashed at once
_BASE = 0x9E3779B97F4A7C15 | 1
_P = np.uint64(_BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, WINDOW + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            made.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = made
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin.

    Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[buf]
    hashes, begins, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(buf):
        end = min(at + WINDOW, len(buf))
        if end < len(buf):
            back = int(np.argmax(space[at:end][::-1]))
            if space[end - 1 - back]:
                end -= back
            else:  # one word fills the window
                end += int(np.argmax(space[end:])) + 1
        part, sp = _LOWER[buf[at:end]], space[at:end]
        turns = np.diff((~sp).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        power, inverse = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        hashes.append(mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48))))
        begins.append(starts + at)
        at = end
    words, begin = np.concatenate(hashes), np.concatenate(begins)
    return words, np.searchsorted(begin, offsets)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Per text, its distinct k-word shingles as ascending int64 of 62 bits.

    A text of fewer words has its whole word sequence as its only shingle; one
    without words has none.
    """
    words, first = word_hashes(texts)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = h * _P + words[j : len(words) - k + 1 + j]
        rolled = (mix(h) >> np.uint64(2)).astype(np.int64)
    else:
        rolled = np.zeros(0, np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * _P + w)
            out.append((h >> np.uint64(2)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
