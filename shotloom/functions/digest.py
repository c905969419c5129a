"""The first 32 bits of md5 of many short texts at once, on numpy arrays: what ``resample.draw`` says of one row.

A text is a prefix that all share and a label of its own. Labels of one length are words of a matrix, and the 64 steps of
the digest run over tiles of them; steps that meet the prefix alone are single numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sin

import numpy as np

#: Labels that are digested at once: the arrays of a step stay in a core's cache.
TILE = 1 << 15
_K = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ALL = 0xFFFFFFFF
Word = int | np.ndarray


class Tile:
    """Labels of one length, as bytes, with the words that they make behind prefixes of any length."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.size = labels, len(labels)
        self.length = labels.shape[1]
        self.placed: dict[int, list[np.ndarray]] = {}
        self.room = [np.empty(self.size, np.uint32) for _ in range(6)]

    def words(self, shift: int) -> list[np.ndarray]:
        """Little-endian words of the labels behind ``shift`` zero bytes, with the closing bit."""
        if shift not in self.placed:
            width = -(-(shift + self.length + 1) // 4) * 4
            raw = np.zeros((self.size, width), np.uint8)
            raw[:, shift : shift + self.length] = self.labels
            raw[:, shift + self.length] = 0x80
            self.placed[shift] = list(np.ascontiguousarray(raw.view("<u4").T))
        return self.placed[shift]


def number_tiles(first: int, last: int) -> Iterator[tuple[int, Tile]]:
    """The numbers from ``first`` up to ``last``, without it, as decimal texts: (the tile's first number, the tile)."""
    while first < last:
        digits = len(str(first))
        stop = min(last, first + TILE, 10**digits)
        x = np.arange(first, stop)
        yield first, Tile((x[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48).astype(np.uint8))
        first = stop


def text_tiles(lengths: np.ndarray, joined: bytes) -> Iterator[tuple[np.ndarray, Tile]]:
    """Any texts, as their lengths in bytes and all of them joined: (which ones, the tile)."""
    starts, letters = np.cumsum(lengths) - lengths, np.frombuffer(joined, np.uint8)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        for start in range(0, len(own), TILE):
            at = own[start : start + TILE]
            yield at, Tile(letters[starts[at][:, None] + np.arange(length)])


def first_bits(prefix: bytes, tile: Tile) -> np.ndarray:
    """The number that the first eight hexadecimal digits of md5(prefix + label) are, of every label."""
    total = len(prefix) + tile.length
    blocks = (total + 8) // 64 + 1
    words: list[Word] = [0] * (16 * blocks)
    for i in range(0, len(prefix), 4):
        words[i // 4] = int.from_bytes(prefix[i : i + 4], "little")
    for i, w in enumerate(tile.words(len(prefix) % 4), len(prefix) // 4):
        words[i] = w if not words[i] else w | np.uint32(words[i])
    words[-2], words[-1] = total * 8 & _ALL, total * 8 >> 32
    state: tuple[Word, ...] = _START
    for k in range(blocks):
        state = _block(words[16 * k : 16 * k + 16], state, tile, last=k == blocks - 1)
    return state[0].byteswap(inplace=True) if isinstance(state[0], np.ndarray) else np.full(tile.size, int.from_bytes(state[0].to_bytes(4, "little"), "big"), np.uint32)


def _sum(*parts: Word, out: np.ndarray | None = None) -> Word:
    """The sum modulo 2^32, numbers first."""
    known = sum(p for p in parts if isinstance(p, int)) & _ALL
    arrays = [p for p in parts if not isinstance(p, int)]
    if not arrays:
        return known
    total = np.add(arrays[0], np.uint32(known), out=out)
    for a in arrays[1:]:
        np.add(total, a, out=total)
    return total


def _mix(turn: int, b: Word, c: Word, d: Word) -> int:
    return ((b & c) | (~b & d), (d & b) | (~d & c), b ^ c ^ d, c ^ (b | (~d & _ALL)))[turn] & _ALL


def _block(words: list[Word], state: tuple[Word, ...], tile: Tile, last: bool) -> tuple[Word, ...]:
    a, b, c, d = state
    number = lambda x: isinstance(x, int)
    f, low, *free = tile.room
    array = lambda x: np.uint32(x) if number(x) else x
    for i in range(61 if last else 64):  # the last three steps don't change the first word
        turn, rotate = i // 16, _TURN[i // 16][i % 4]
        word = words[_WORD[turn](i)]
        if number(b) and number(c) and number(d):
            mixed: Word = _mix(turn, b, c, d)
        else:
            x, y, z = array(b), array(c), array(d)
            if turn == 0:
                np.bitwise_xor(y, z, out=f), np.bitwise_and(f, x, out=f), np.bitwise_xor(f, z, out=f)
            elif turn == 1:
                np.bitwise_xor(x, y, out=f), np.bitwise_and(f, z, out=f), np.bitwise_xor(f, y, out=f)
            elif turn == 2:
                np.bitwise_xor(x, y, out=f), np.bitwise_xor(f, z, out=f)
            else:
                np.invert(z, out=f), np.bitwise_or(f, x, out=f), np.bitwise_xor(f, y, out=f)
            mixed = f
        if number(mixed) and number(a) and number(word):
            t = (mixed + a + word + _K[i]) & _ALL
            new: Word = _sum(((t << rotate) | (t >> (32 - rotate))) & _ALL, b)
        else:
            spare = next(r for r in free if r is not b and r is not c and r is not d)
            t = _sum(a, mixed, word, _K[i], out=spare)  # a is in place where its array is the spare one
            np.right_shift(t, np.uint32(32 - rotate), out=low)
            np.left_shift(t, np.uint32(rotate), out=t)
            np.bitwise_or(t, low, out=t)
            new = np.add(t, array(b), out=t)
        a, d, c, b = d, c, b, new
    if last:  # after 61 steps the first word has been made, and stands in b
        return (_sum(state[0], b) if not number(b) else (state[0] + b) & _ALL,)
    return tuple(_sum(x, y) if number(x) and number(y) else np.array(_sum(x, y)) for x, y in zip(state, (a, b, c, d), strict=True))
