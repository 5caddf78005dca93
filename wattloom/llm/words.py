"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)

# bytes that belong to words: all but ASCII white space; or letters, digits and everything beyond ASCII
NO_SPACE = np.ones(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.array([chr(i).isalnum() or i > 127 for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


KEPT = 1 << 21  # powers that a worker keeps; longer runs are rare and make their own
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _kept.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, KEPT), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= KEPT:
            _kept[base] = have
    return have[:n]


class Sums:
    """Polynomial hashes of any stretch of numbers, from running sums."""

    def __init__(self, values: np.ndarray):
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, len(values) + 1)[:-1], out=self.total[1:])
        self.undo = _powers(_INVERSE, len(values) + 1)

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[begin]) * self.undo[begin]


def _pieces(data: bytes):
    """A long text in pieces that end at a space."""
    at = 0
    while len(data) - at > 2 * PIECE:
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list, keep: np.ndarray = NO_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry at the end). `lower` lower-cases A-Z."""
    hashes, count = [], np.zeros(len(texts) + 1, np.int64)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"\n".join(d for _, d in held) + b"\n", np.uint8)
        if lower:
            data = _LOWER[data]
        word = keep[data]
        edge = np.flatnonzero(np.diff(word, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        h = Sums(np.where(word, data.astype(np.uint64) + np.uint64(1), np.uint64(0))).between(starts, ends)
        hashes.append(mix(h + (ends - starts).astype(np.uint64) * _STEP))
        piece = np.searchsorted(np.cumsum([len(d) + 1 for _, d in held]), starts, side="right")
        np.add(count, np.bincount(np.array([i for i, _ in held])[piece] + 1, minlength=len(count)), out=count)

    for i, t in enumerate(texts):
        for d in _pieces((t or "").encode("utf-8", "surrogatepass")):
            held.append((i, d))
            size += len(d)
            if size >= PIECE:
                flush()
                held, size = [], 0
    if held:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(count)


def text_of(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one text, and the place of each run's first word among all words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = text_of(first)
    g = np.full(m, n, np.uint64)
    for k in range(n):
        g = (g + h[k : k + m]) * _STEP
        g ^= g >> np.uint64(29)
    at = np.flatnonzero(own[:m] == own[n - 1 :])
    return mix(g[at]), at


def slices(texts: list, most: int = 1 << 20):
    """Runs of text numbers whose texts have about `most` characters together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
