"""The words of many texts at once, as arrays: their places, documents and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text that are worked on together.
BATCH_BYTES = 4 << 20
#: Powers that a worker keeps; longer texts make their own.
KEPT_POWERS = 3 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, KEPT_POWERS), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) == KEPT_POWERS:
            _powers[name] = have
    return have[:n]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, a line feed behind each
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # the text of each word, ascending
    hash: np.ndarray
    n_docs: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words_of(texts: list[bytes]) -> Words:
    """Words are runs of bytes other than space and 9 to 13; equal words have equal hashes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    # a hash of bytes s..e: their sum weighted by powers of a base, moved back to place 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), dtype=np.uint64)])
    own = (total[end] - total[start]) * _power("down", _INVERSE, len(data) + 1)[start]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Words(data, start, end, np.searchsorted(ends, start, side="right"), mix(own + (end - start).astype(np.uint64)), len(texts))


def batched(texts: list[bytes], most: int = BATCH_BYTES):
    """Slices of a list that hold about ``most`` bytes each, longer texts alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > most:
            yield slice(at, k)
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield slice(at, len(texts))


def shingle_hashes(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``width`` words; a shorter document's words are one run."""
    n = words.counts()
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    runs = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    doc = np.repeat(np.arange(words.n_docs), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[doc]
    out = np.full(len(doc), 0x51ED270B, np.uint64)
    for k in range(width):
        inside = at + k < first[doc] + n[doc]
        got = words.hash[np.minimum(at + k, max(0, len(words.hash) - 1))] if len(words.hash) else np.zeros(len(doc), np.uint64)
        out = np.where(inside, mix(out * np.uint64(0x2545F4914F6CDD1D) + got), out)
    return doc, out
