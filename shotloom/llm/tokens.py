"""Whole texts to token ids with a tokenizers file, encoding each distinct chunk of text once per worker.

A chunk is a stretch of text that no token crosses. For byte-level files it is one space or line break and the run behind
it; for files that drop white space it is a word between ASCII white space. Chunks that are not in a worker's cache are
encoded by the tokenizers library's own model, so ids are the library's.
"""

from __future__ import annotations

import ctypes
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import batched, words_of

_LIBC = ctypes.CDLL(None)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = r"[^\S\x1c-\x1f]"
_CHUNK = re.compile(rf" ?[\S\x1c-\x1f]+|{_SPACE}+(?![\S\x1c-\x1f])|{_SPACE}+")
#: Chunks that a worker remembers (about 150 bytes each); then it starts anew.
CACHE_CHUNKS = 400_000
#: Chunks in the table of arrays (about 50 bytes each), likewise.
TABLE_CHUNKS = 600_000
#: Where none of these is in a text, its white space is single spaces and line breaks between other characters.
_ODD = tuple(x.encode() for x in ("  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x85\xa0\u1680\u205f\u3000")) + (b"\xe2\x80",)
#: Printable ASCII and Latin letters whose NFC form is themselves and whose lower case is one character.
_PLAIN = re.compile("[ !-~\u00c0-\u012f\u0131-\u017e]+")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's visible character for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


class Encoder:
    """Encodes texts with one tokenizers file; ``as_text``: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = as_text
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.added = [] if as_text else [x["content"] for x in spec.get("added_tokens", [])]
        self.added_bytes = [x.encode() for x in self.added]
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
            self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+| +").findall
        elif steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0].get("invert"):
            self.kind = "word"
            self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ {_LETTERS}0-9]+").findall
        self.size = self.tok.get_vocab_size()
        self.alphabet = byte_alphabet()
        # in byte-level vocabularies a character of a token is a byte
        suffix = (spec.get("model") or {}).get("end_of_word_suffix") or ""
        self.token_bytes = np.zeros(self.size, np.int64)
        for token, k in self.tok.get_vocab().items():
            self.token_bytes[k] = len(token.removesuffix(suffix) if suffix else token)
        self.first = _Cache(lambda x: self.encode_chunk(x.decode()))
        self.known = _Cache(self._later if self.kind == "byte" else self.first.make)
        self.pieces = _Cache(self._piece)
        self._clear_table()

    def _clear_table(self) -> None:
        """The table behind ``many``: sorted hashes of chunks, and the place of each one's ids in one array."""
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add the ids of new chunks, whose hashes are sorted, to the table."""
        n, stop = len(self.sizes), self.used + len(ids)
        while stop > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : stop] = ids
        self.begins = np.concatenate([self.begins, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = stop
        at = np.searchsorted(self.hashes, keys)
        self.hashes, self.slots = np.insert(self.hashes, at, keys), np.insert(self.slots, at, np.arange(n, n + len(keys)))

    def _regular(self, data: bytes) -> bool:
        """Whether the text's chunks are its words with the one white space before each."""
        if any(a in data for a in self.added_bytes):
            return False
        return self.kind == "word" or not (any(x in data for x in _ODD) or data[:1] in b" \n" or data[-1:] in b" \n")

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as ``ids`` has them: words are hashed as arrays (64 bits), and each distinct one of a
        batch is looked up once."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        raw, regular = [(t or "").encode() for t in texts], []
        for k, data in enumerate(raw):
            if self.kind != "whole" and data and self._regular(data):
                regular.append(k)
            elif data:
                out[k] = np.frombuffer(self.ids(texts[k]), np.uint32)
        own = [raw[k].lower() if self.kind == "word" else raw[k] for k in regular]
        for part in batched(own, 1 << 20):
            for k, ids in zip(regular[part], self._regular_ids(own[part]), strict=True):
                out[k] = ids
        return out

    def _regular_ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.sizes) >= TABLE_CHUNKS:
            self._clear_table()
        words = words_of(texts)
        ends = np.searchsorted(words.doc, np.arange(len(texts) + 1))
        key = words.hash
        if self.kind == "byte":  # a word is another chunk after a space, after a line break, and at a text's start
            before = words.data[np.maximum(words.start - 1, 0)].astype(np.uint64)
            before[ends[:-1][ends[:-1] < ends[1:]]] = 0
            key = key ^ (before * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
        inverse = np.empty(len(key), np.int64)
        inverse[order] = np.cumsum(new) - 1
        distinct, at = ranked[new], order[new]
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        missing = self.hashes[place] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if missing.any():
            data, where = words.data.tobytes(), at[missing]
            chunks = [data[i:j] for i, j in zip(words.start[where].tolist(), words.end[where].tolist(), strict=True)]
            lone = np.zeros(len(chunks), bool)
            if self.kind == "byte":
                lone = before[where] == 0
                chunks = [chr(b).encode() + c if b else c for b, c in zip(before[where].tolist(), chunks, strict=True)]
            self._learn(distinct[missing], *self.encode_chunks(chunks, lone))
            place = np.searchsorted(self.hashes, distinct)
        slot = self.slots[place][inverse]
        size = self.sizes[slot]
        stop = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.begins[slot] - stop[:-1], size) + np.arange(stop[-1])]
        cuts = stop[ends].tolist()
        return [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _later(self, part: bytes) -> bytes:
        return self.encode_chunk((part if part[:1] == b"\n" else b" " + part).decode())

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_chunks(self, chunks: list[bytes], lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks of regular texts, and the number of each one's ids: many chunks to a call of the library.

        No token crosses a chunk, and a text's tokens hold all its bytes, so ids end where the chunks' lengths do. Chunks
        that are ``lone``, texts' first words without a space before, and those that the normaliser may change go alone.
        """
        if self.kind == "word":
            lone = lone | np.fromiter((_PLAIN.fullmatch(c.decode()) is None for c in chunks), bool, len(chunks))
        gap = b"" if self.kind == "byte" else b" "
        out: list[tuple[np.ndarray, np.ndarray]] = []
        joined = np.flatnonzero(~lone)
        for at in range(0, len(joined), 1024):
            some = joined[at : at + 1024].tolist()
            own = [chunks[k] for k in some]
            ids = np.array(self.tok.encode_batch_fast([gap.join(own).decode()], add_special_tokens=False)[0].ids, np.uint32)
            held, ends = np.cumsum(self.token_bytes[ids]), np.cumsum([len(c) for c in own])
            stop = np.searchsorted(held, ends) + 1
            if len(ids) and stop[-1] == len(ids) and np.array_equal(held[stop - 1], ends):
                out.append((ids, np.diff(np.concatenate([[0], stop]))))
            else:
                out.append(self._one_by_one(own))
        alone = np.flatnonzero(lone)
        out.append(self._one_by_one([chunks[k] for k in alone.tolist()]))
        flat, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
        if not len(alone):
            return flat, sizes
        # back into the chunks' order
        begins, order = np.cumsum(sizes) - sizes, np.argsort(np.concatenate([joined, alone]), kind="stable")
        sizes = sizes[order]
        stop = np.cumsum(sizes)
        return flat[np.repeat(begins[order] - (stop - sizes), sizes) + np.arange(len(flat))], sizes

    def _one_by_one(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode_chunk(c.decode()) for c in chunks]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of one chunk as unsigned 32-bit integers."""
        if self.kind == "whole" or any(a in chunk for a in self.added):
            return self._library(chunk)
        if _PLAIN.fullmatch(chunk):
            found = self.split(chunk.lower() if self.kind == "word" else chunk)
            if not chunk.isascii() or self.kind == "byte":
                found = [x.encode().decode("latin-1").translate(self.alphabet) for x in found]
        else:
            norm = self.tok.normalizer.normalize_str(chunk) if self.kind == "word" else chunk
            found = [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        if len(found) == 1:  # mostly words that are met once; their callers remember them
            return self._piece(found[0])
        return b"".join(map(self.pieces.__getitem__, found))

    def parts(self, text: str | None) -> list[bytes]:
        """A text's chunks in order, as ``encode_chunk`` takes them; the ids of a text are those of its parts."""
        if not text:
            return []
        data = text.encode()
        special = any(a in data for a in self.added_bytes)
        if self.kind == "word":
            return (data if special else data.lower()).split()
        if self.kind == "byte" and not special:
            return [x.encode() for x in _CHUNK.findall(text)]
        return [data]

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text as unsigned 32-bit integers in the machine's (little-endian) order; null is the empty text."""
        if not text:
            return b""
        for cache in (self.known, self.first, self.pieces):
            if len(cache) >= CACHE_CHUNKS:
                cache.clear()
        if self.kind == "whole":
            return self._library(text)
        data = text.encode()
        special = any(a in data for a in self.added_bytes)
        if self.kind == "word":
            return b"".join(map(self.known.__getitem__, self.parts(text)))
        if special:
            return self._library(text)
        if any(x in data for x in _ODD) or data[:1] in b" \n" or data[-1:] in b" \n":
            return b"".join([self.first[x.encode()] for x in _CHUNK.findall(text)])
        parts = data.replace(b"\n", b" \n").split(b" ")
        return self.first[parts[0]] + b"".join(map(self.known.__getitem__, parts[1:]))

    def forget(self) -> None:
        """Empty the caches, where a task needs the memory."""
        for cache in (self.known, self.first, self.pieces):
            cache.clear()
        self._clear_table()


_encoders: list[Encoder] = []


@lru_cache(maxsize=4)
def encoder(path: str, as_text: bool = False) -> Encoder:
    """One encoder a worker and file, so that its cache serves all of the worker's tasks."""
    _encoders.append(Encoder(path, as_text))
    return _encoders[-1]


def encoded(enc: Encoder, batch: pa.RecordBatch, most: int = 1 << 20):
    """(id, token ids) of each row of a batch of (id, text), about ``most`` bytes of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        some = batch.slice(at, stop - at)
        yield from zip(some.column(0).to_pylist(), enc.many(some.column(1).to_pylist()), strict=True)
        at = stop


def forget_all() -> None:
    """Empty the caches of a worker whose tasks have gone on to another operator."""
    for enc in _encoders:
        enc.forget()
    release()


def release() -> None:
    """Give memory that earlier tasks of a worker have freed back to the system, which its allocators would keep."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc has it, other C libraries don't
        _LIBC.malloc_trim(0)
