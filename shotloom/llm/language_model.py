"""Scores of whole documents under a gated recurrent language model trained on the corpus.

Tokens are words (ASCII letters lower-cased, split at space and U+0009 to U+000D) and one end per document. Counts of all
words come from all training documents: each block of documents sends its words and their counts to the partition of the
word table that they belong to, which answers with the corpus's counts. Every word that occurs ``least_count`` times is a
symbol of its own, so that the vocabulary grows with the corpus, as the square root of its tokens; the others are symbols by their count, within which a word has the probability (c+1) / sum of (c+1); words that training has
not seen are one symbol. The model is a distribution over the words seen, the end and the unseen word, so its scores
compare with those of the add-one unigram model (``base_score``).

The network is a gated recurrent unit: a gate and a candidate, each from the symbol's own row and the state before it, and
the state moves from the old to the candidate by the gate. The next symbol's class has a softmax over the state, and a class of frequent
words another one over its members. Beyond 48 classes, the first softmax is over classes of classes and a second one over one's
classes, so that all three grow as the cube root of the vocabulary. Training is by
truncated backpropagation in numpy over all training documents, once: in each round tasks start from the same weights,
train on their documents, and their weights are averaged. The rounds grow as the fourth root of the training tokens, and the tasks of a round as the square root; a
task sends how far its weights moved, in half precision. A word's own
occurrence isn't evidence for itself, so in training a word counted once stands for the unseen word, one counted twice
for a word counted once, and so on. State is carried over windows, so a document is scored as a whole.

Defined cases: a null text is the empty text (its end alone); a null ``doc_id`` is learned from and not held out;
repeated rows count and return once each; without training documents all words are unseen and the score is that of the
initial weights; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, to_blocks, unsqueeze
from .storage import staged
from .tokens import forget_all
from .words import batched, words_of

#: The least numbers of words' symbols and of a class's members, for small corpora.
TOP, CLASS = 768, 24
#: A word is a symbol if it occurs LEAST times, and sqrt(tokens) / COUNT_SHARE times.
LEAST, COUNT_SHARE = 16, 20
#: Tokens for which one round would do.
ROUND_TOKENS = 1 << 20
HIDDEN, WINDOW, BATCH, ROUNDS = 32, 48, 192, 2
#: Counts from 2^23 on, which hardly any word outside the frequent ones has, share the last band.
BANDS = 26
RATE = 0.02
#: Where Adagrad's sums of squares start: rows that few windows meet have small gradients, and would hardly move from START.
START, START_SPARSE = 0.1, 0.0001
SYMBOLS = TOP + BANDS + 2
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail double, symbols binary"


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


#: Tokens whose classes are scored together, so that their odds stay in a core's cache.
TILE = 1024
#: Rows that are added up one by one; more of one symbol are summed at once.
FEW = 12
#: Tokens of a task's documents that are dealt to lanes together, so that few windows are short of lanes at the end.
CHUNK_TOKENS = 1 << 22
#: Bytes of text whose words are hashed together.
PIECE = 1 << 20


def _cut(text: bytes) -> Iterator[bytes]:
    """Pieces of a text of about PIECE bytes, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        stop = max(text.rfind(c, at + 1, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if stop < 0:
            found = [k for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (k := text.find(c, at + 1)) >= 0]
            stop = min(found, default=len(text))
        yield text[at:stop]
        at = stop
    yield text[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words, ASCII letters lower-cased, and the number of each text's words."""
    pieces, owner = [], []
    for k, t in enumerate(texts):
        data = (t or "").encode().lower()
        for piece in _cut(data):
            pieces.append(piece)
            owner.append(k)
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for part in batched(pieces, PIECE):
        words = words_of(pieces[part])
        found.append(words.hash)
        np.add.at(counts, owner[part.start : part.stop], words.counts())
    return np.concatenate(found), counts


def _places(hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The place of each hash in the ascending ``own``, which holds it: looked up by leading bits, then from there on."""
    bits = max(1, len(own)).bit_length() + 2
    shift = np.uint64(64 - bits)
    first = np.searchsorted(own >> shift, np.arange(1 << bits, dtype=np.uint64))
    place = first[hashes >> shift]
    late = np.flatnonzero(own[place] != hashes) if len(own) else place
    while len(late):
        place[late] += 1
        late = late[own[place[late]] != hashes[late]]
    return place


def _distinct(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by part of the word table and hash, and for each hash its place in them; also their parts."""
    ranked = np.sort(hashes)
    own = ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]]
    place = _places(hashes, own)
    if n == 1:
        return own, place, np.zeros(len(own), np.int64)
    part = ((own >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return own[order], rank[place], part[order]


def band(c: np.ndarray) -> np.ndarray:
    """Counts 1, 2 and 3 have bands of their own, larger ones by powers of two; count 0 has band 0."""
    return np.minimum(np.where(c < 4, c, 2 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)), BANDS - 1)


def least_count(tokens: int) -> int:
    """The count from which a word is a symbol of its own."""
    return max(LEAST, math.ceil(math.sqrt(tokens) / COUNT_SHARE))


def rounds_for(tokens: int) -> int:
    """Rounds grow as the fourth root of the tokens, and a round's tasks as the square root, so that the weights that tasks
    send, which grow as the square root themselves, stay near the size of the corpus."""
    return max(ROUNDS, round(2 * (tokens / ROUND_TOKENS) ** 0.25))


def tasks_for(tokens: int) -> int:
    """Tasks that train in a round."""
    return max(1, math.ceil(math.sqrt(tokens / ROUND_TOKENS)))


def class_shape(words: int) -> tuple[int, int]:
    """Number and size of the classes of so many words."""
    size = max(CLASS, math.ceil(3 * words ** (1 / 3)))
    groups = max(TOP // CLASS, -(-words // size))
    return (groups if (of := middle(groups)) is None else math.prod(of)), size


def middle(groups: int) -> tuple[int, int] | None:
    """Number and size of the classes of so many classes, where they are too many for one softmax."""
    if groups <= 2 * CLASS:
        return None
    size = math.ceil(math.sqrt(groups))
    return -(-groups // size), size


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i8")


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.asarray(values, "<i8").tobytes(), 3)


@dataclass
class Table:
    """What a task must know of the corpus's counts."""

    tokens: int  # N, with ends
    distinct: int  # V, with the end
    ends: int
    top: list[tuple[int, int]]  # the hash and count of each word that is a symbol
    band_words: np.ndarray  # words of each band that aren't in top
    band_tokens: np.ndarray  # the sum of their counts

    @property
    def shape(self) -> tuple[int, int]:
        return class_shape(len(self.top))

    @property
    def bands_at(self) -> int:
        """The first band's symbol."""
        return math.prod(self.shape)


def count_words(blocks: DataFrame, n: int, top: int = TOP) -> tuple[DataFrame, Table]:
    """The blocks' words' counts, as rows (block, part, data), and the corpus's totals."""

    def ask(batches):
        forget_all()
        found: dict[int, list] = {}
        for batch in batches:
            for block, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs = list(unsqueeze(texts))
                hashes, counts = word_hashes([t for _, t in docs])
                own, place, _ = _distinct(hashes, 1)
                learned = np.repeat(np.array([not held_out(d) for d, _ in docs], float), counts)
                found.setdefault(block, []).append((own, np.bincount(place, learned, len(own)).astype(np.int64)))
        for block, parts in found.items():
            hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            own, place, part = _distinct(hashes, n)
            counts = np.bincount(place, counts, len(own)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(n + 1))
            for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
                i, j = ends[k], ends[k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([_squeezed(own[i:j].view(np.int64))], pa.binary()), pa.array([_squeezed(counts[i:j])], pa.binary())], names=["part", "block", "words", "counts"])

    def tell(rows: pa.Table) -> pa.Table:
        own = [_counts(x.as_py()).view(np.uint64) for x in rows.column("words")]
        every, place, _ = _distinct(np.concatenate(own), 1)
        total = np.bincount(place, np.concatenate([_counts(x.as_py()) for x in rows.column("counts")]), len(every)).astype(np.int64)
        out = {"block": [], "part": [], "word": [], "c": [], "data": []}

        def add(block, word, c, data):
            for k, v in zip(out, (block, rows.column("part")[0].as_py(), word, c, data), strict=True):
                out[k].append(v)

        at = 0
        for block, hashes in zip(rows.column("block").to_pylist(), own, strict=True):
            add(block, None, None, _squeezed(total[place[at : at + len(hashes)]]))
            at += len(hashes)
        order = np.lexsort((every, -total))
        for rank, k in enumerate(order.tolist()):
            if not total[k] or (rank >= top and total[k] < LEAST):
                break
            add(None, int(every[k].view(np.int64)), int(total[k]), None)
        where = band(total)
        for b in np.unique(where[total > 0]).tolist():
            add(int(b), None, int((where == b).sum()), _squeezed(np.array([total[where == b].sum()])))
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("word", pa.int64()), ("c", pa.int64()), ("data", pa.binary())]))

    asked = blocks.mapInArrow(ask, "part int, block int, words binary, counts binary").repartition(n, "part")
    told = staged(asked.groupBy("part").applyInArrow(tell, "block int, part int, word long, c long, data binary"), "lm-counts")
    words, tokens = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
    for r in told.where("c IS NOT NULL AND word IS NULL").toLocalIterator():  # some 30 rows of a few bytes for each partition of the table
        words[r["block"]] += r["c"]
        tokens[r["block"]] += int(_counts(r["data"])[0])
    all_words, all_tokens = int(words.sum()), int(tokens.sum())
    ranked = told.where("word IS NOT NULL").select("word", "c")
    rows = ranked.where(F.col("c") >= least_count(all_tokens)).collect()
    if len(rows) < top:
        rows = ranked.orderBy(F.desc("c"), "word").limit(top).collect()
    best = sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    at = band(np.array([c for _, c in best], np.int64)) if best else np.zeros(0, np.int64)
    for (_, c), b in zip(best, at.tolist(), strict=True):
        words[b] -= 1
        tokens[b] -= c
    return told.where("data IS NOT NULL AND c IS NULL").select("block", "part", "data"), Table(all_tokens, all_words, 0, best, words, tokens)


def to_symbols(blocks: DataFrame, answers: DataFrame, n: int, table: Table) -> DataFrame:
    """Per document: its counts, base score, the part of the score within symbols (``tail``), and its symbols."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def place(texts: pa.Table, told: pa.Table) -> pa.Table:
        forget_all()
        t = shared.value
        docs = [d for r in texts.column("texts").to_pylist() for d in unsqueeze(r)]
        hashes, counts = word_hashes([x for _, x in docs])
        own, at, part = _distinct(hashes, n)
        c = np.zeros(len(own) + 1, np.int64)
        c[-1] = t.ends
        for k, data in zip(told.column("part").to_pylist(), told.column("data").to_pylist(), strict=True):
            c[np.searchsorted(part, k) : np.searchsorted(part, k, side="right")] = _counts(data)
        base = np.log10((c + 1) / (t.tokens + t.distinct + 1))
        where = band(c)
        symbol = np.where(c > 0, t.bands_at + where, t.bands_at + BANDS).astype("<u4")
        share = (t.band_words + t.band_tokens).astype(float)
        tail = np.where(c > 0, np.log10((c + 1) / np.maximum(share[where], 1)), 0.0)
        symbol[-1], tail[-1] = t.bands_at + BANDS + 1, 0.0
        if t.top:
            best = np.array([w for w, _ in t.top], np.int64).view(np.uint64)
            order = np.argsort(best)
            found = np.minimum(np.searchsorted(best, own, sorter=order), len(best) - 1)
            is_top = np.flatnonzero(best[order[found]] == own)
            symbol[is_top], tail[is_top] = order[found[is_top]], 0.0
        # every document's words, then its end
        stops = np.cumsum(counts + 1)
        places = np.full(int(stops[-1]) if len(stops) else 0, len(own))
        inner = np.ones(len(places), bool)
        inner[stops - 1] = False
        places[inner] = at
        starts = stops - counts - 1
        sums = [np.add.reduceat(x[places], starts) if len(starts) else x[:0] for x in ((c > 0).astype(np.int64), base, tail)]
        symbols = symbol[places]
        data = [zstandard.compress(symbols[i:j].tobytes(), 1) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
        columns = [[d for d, _ in docs], [held_out(d) for d, _ in docs], counts + 1, *sums, data]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCORED.split(", ")])

    return blocks.groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(place, SCORED)


def class_of(shape: tuple[int, int] = (TOP // CLASS, CLASS)) -> np.ndarray:
    """The class of each symbol: as many frequent words as a class has members share one, every other symbol has its own."""
    groups, size = shape
    return np.concatenate([np.arange(groups * size) // size, np.arange(BANDS + 2) + groups])


def heads(kind: np.ndarray, groups: int) -> np.ndarray:
    """Each symbol's place in the first softmax: its class's class, or its class where those are few."""
    if (of := middle(groups)) is None:
        return kind
    return np.where(kind < groups, kind // of[1], kind - groups + of[0])


def in_training(bands_at: int = TOP) -> np.ndarray:
    """The symbol that an occurrence stands for in training, where it doesn't count for itself."""
    out = np.arange(bands_at + BANDS + 2, dtype=np.int32)
    out[bands_at + 1], out[bands_at + 2], out[bands_at + 3] = bands_at + BANDS, bands_at + 1, bands_at + 2
    return out


Weights = dict[str, np.ndarray]


def initial(table: Table, seed: int = 5) -> Weights:
    """Small random weights, and biases at which the model is the unigram model of symbols."""
    rng = np.random.default_rng(seed)
    (groups, size), top = table.shape, table.bands_at
    symbols = top + BANDS + 2
    count = np.zeros(symbols)
    count[: len(table.top)] = [c for _, c in table.top]
    count[top : top + BANDS] = table.band_tokens
    count[top + BANDS], count[top + 1], count[top + 2], count[top + 3] = count[top + 1], count[top + 2], count[top + 3], 0
    count[top + BANDS + 1] = table.ends
    count += 0.5
    kind, of = class_of(table.shape), middle(groups)
    head = heads(kind, groups)
    w = {
        "gate": rng.normal(0, 0.1, (symbols, HIDDEN)) - 2.0,
        "new": rng.normal(0, 0.5, (symbols, HIDDEN)),
        "state": rng.normal(0, 0.1, (HIDDEN, 2 * HIDDEN)),
        "out": rng.normal(0, 0.05, (HIDDEN, int(head[-1]) + 1)),
        "out_b": np.log(np.bincount(head, count) / count.sum()),
        "in": rng.normal(0, 0.05, (groups, HIDDEN, size)),
        "in_b": np.log(count[:top].reshape(-1, size)),
    }
    if of:
        w |= {"mid": rng.normal(0, 0.05, (of[0], HIDDEN, of[1])), "mid_b": np.log(count[:top].reshape(*of, size).sum(2))}
    return {k: v.astype(np.float32) for k, v in w.items()}


def packed(w: Weights) -> Weights:
    """The weights as windows read them: the biases as the last row of their weights."""
    out = {k: w[k] for k in ("gate", "new", "state")}
    for k in ("out", "mid", "in"):
        if k in w:
            out[k] = np.concatenate([w[k], w[f"{k}_b"][..., None, :]], axis=-2)
    return out


def unpacked(p: Weights) -> Weights:
    """Views of packed weights by their own names."""
    out = {k: p[k] for k in ("gate", "new", "state")}
    for k in ("out", "mid", "in"):
        if k in p:
            out |= {k: p[k][..., :HIDDEN, :], f"{k}_b": p[k][..., HIDDEN, :]}
    return out


def _odds(s: np.ndarray, weights: np.ndarray, of: np.ndarray, y: np.ndarray, score: np.ndarray, back: np.ndarray | None, by: float = 1.0) -> tuple | None:
    """Adds the log-probability of y in each row to ``score``; when ``back`` is given, adds the gradient of each row's state
    to it and returns the groups met and their weights' gradients, all of them times ``by``.

    Each row has a softmax over the weights of its group ``of``, which doesn't fall from row to row. A tile of rows takes a
    product for each of its groups and everything else at once. Logits are kept below 80, where a float's exponential and
    the sum of thousands are finite, rather than shifted.
    """
    n, size, learn = len(s), weights.shape[2], back is not None
    ends = np.searchsorted(of, np.arange(len(weights) + 1))
    met = np.flatnonzero(ends[1:] > ends[:-1])
    spans = [(k, g, i, j) for k, (g, i, j) in enumerate(zip(met.tolist(), ends[met].tolist(), ends[met + 1].tolist(), strict=True))]
    grads = np.empty((len(met), *weights.shape[1:]), s.dtype) if learn else None
    odds, ones, every, at = np.empty((min(TILE, n), size), s.dtype), np.ones(size, s.dtype), np.arange(min(TILE, n)), 0
    felt, turned = np.empty((min(TILE, n), HIDDEN), s.dtype), weights[:, :HIDDEN].transpose(0, 2, 1)
    for start in range(0, n, TILE):
        stop, own = min(start + TILE, n), []
        while at < len(spans) and spans[at][2] < stop:
            k, g, i, j = spans[at]
            own.append((k, g, max(i, start), min(j, stop), i < start))
            if j > stop:
                break
            at += 1
        z, each, target = odds[: stop - start], every[: stop - start], y[start:stop]
        for _, g, i, j, _ in own:
            np.matmul(s[i:j], weights[g], out=z[i - start : j - start])
        mine = z[each, target]
        np.exp(z, out=z)
        total = z @ ones
        if not total.max() < 1e30:
            for _, g, i, j, _ in own:
                np.matmul(s[i:j], weights[g], out=z[i - start : j - start])
            np.minimum(z, 80, out=z)
            mine = z[each, target]
            np.exp(z, out=z)
            total = z @ ones
        total = np.maximum(total, 1e-30)
        score[start:stop] += np.maximum(mine - np.log(total), -69.0)
        if learn:
            z *= (by / total)[:, None]
            z[each, target] -= by
            for k, g, i, j, more in own:
                q = z[i - start : j - start]
                if more:
                    grads[k] += s[i:j].T @ q
                else:
                    np.matmul(s[i:j].T, q, out=grads[k])
                np.matmul(q, turned[g], out=felt[i - start : j - start])
            back[start:stop] += felt[: stop - start]
    return (slice(None) if len(met) == len(weights) else met, grads) if learn else None


def _add_rows(at: np.ndarray, *many: np.ndarray) -> list[np.ndarray]:
    """The places that occur in ``at``, which ascends, and for each of ``many`` the sums of its rows at them."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(first, append=len(at))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    longer, sums = np.searchsorted(-count, -np.arange(FEW + 1)).tolist(), [at[first]]  # how many occur more often than that
    for values in many:
        out = values[first]
        for k, (i, n) in enumerate(zip(first[: longer[FEW]].tolist(), count.tolist(), strict=False)):
            values[i : i + n].sum(0, out=out[k])
        for r in range(1, FEW):
            out[longer[FEW] : longer[r]] += values[first[longer[FEW] : longer[r]] + r]
        sums.append(out)
    return sums


def _room(rooms: dict, name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array of any content in memory that windows use again, as fresh pages cost as much as what is done in them."""
    size = math.prod(shape)
    if name not in rooms or rooms[name].size < size:
        rooms[name] = np.empty(size, kind)
    return rooms[name][:size].reshape(shape)


def window(w: Weights, x: np.ndarray, lengths: np.ndarray, h: np.ndarray, kind: np.ndarray, learn: bool):
    """``sparse_window`` with gradients of the weights' own shapes."""
    p = packed(w)
    score, grads = sparse_window(p, x, lengths, h, kind, learn)
    out = {k: np.zeros_like(p[k]) for k in grads}
    for k, (rows, g) in grads.items():
        out[k][rows] = g
    return score, unpacked(out) if learn else out


def sparse_window(w: Weights, x: np.ndarray, lengths: np.ndarray, h: np.ndarray, kind: np.ndarray, learn: bool, owner: np.ndarray | None = None, fresh: np.ndarray | None = None, by: float = 1.0, rooms: dict | None = None):
    """One window of lanes of documents: natural log-likelihood per document, and gradients if learning; ``h`` moves on.

    Weights are ``packed``, and so are the gradients: pairs of rows and their values, as a window meets few of the symbols.

    x: symbols by (step, lane); lanes come in falling order of their lengths in this window, so that those alive at a step
    are the first ones and no step needs a mask. ``owner`` is the document of each place (the lane unless given);
    ``fresh`` says where a document begins, from the empty state. Gradients are multiplied by ``by``.
    """
    steps, n = x.shape
    alive = (lengths[None] > np.arange(steps)[:, None]).sum(1)
    # half of what the gate is a function of, so that the gate 1 / (1 + exp(-2a)) is (1 + tanh a) / 2
    flat, kinds = x.reshape(-1), w["new"].dtype
    rooms = {} if rooms is None else rooms
    both = _room(rooms, "both", (2, steps, n, HIDDEN), kinds)
    for rows, out in zip((w["gate"], w["new"]), both, strict=True):
        rows.take(flat, axis=0, out=out.reshape(-1, HIDDEN), mode="clip")
    both[0] *= 0.5
    turn = np.stack(np.hsplit(w["state"], 2))
    turn[0] *= 0.5
    states = _room(rooms, "states", (steps, n, HIDDEN + 1), kinds)
    states[..., HIDDEN] = 1
    begins = fresh.any(1).tolist() if fresh is not None else [False] * steps
    product, change, part = np.empty((2, n, HIDDEN), kinds), np.empty((n, HIDDEN), kinds), np.empty((n, HIDDEN), kinds)
    for t, k in enumerate(alive.tolist()):
        if begins[t]:
            h[fresh[t]] = 0
        states[t, :, :HIDDEN] = h
        now, own, moved = h[:k], both[:, t, :k], change[:k]
        own += np.matmul(now, turn, out=product[:, :k])
        np.tanh(own, out=own)
        np.subtract(own[1], now, out=moved)
        moved += np.multiply(own[0], moved, out=part[:k])
        moved *= 0.5
        now += moved
    # the symbol at t is foretold by the state before it; places come by symbol, and so by class
    y = flat
    short = y.astype(np.uint16) if len(kind) <= 1 << 16 else y
    if alive[-1] == n:
        at = np.argsort(short, kind="stable")
    else:
        at = np.flatnonzero((np.arange(n)[None] < alive[:, None]).reshape(-1))
        at = at[np.argsort(short[at], kind="stable")]
    s, y = _room(rooms, "s", (len(at), HIDDEN + 1), kinds), y[at]
    states.reshape(-1, HIDDEN + 1).take(at, axis=0, out=s, mode="clip")
    groups, _, size = w["in"].shape
    score, back, grads = np.zeros(len(at), kinds), _room(rooms, "back", (len(at), HIDDEN), kinds) if learn else None, {}
    if learn:
        back[...] = 0
    words = int(np.searchsorted(y, groups * size))  # the other symbols are their own classes
    c, back_words = kind[y[:words]], back[:words] if learn else None
    with np.errstate(over="ignore"):
        got = _odds(s, w["out"][None], np.zeros(len(at), np.int64), heads(kind, groups)[y], score, back, by)
        if learn:
            grads["out"] = slice(None), got[1][0]
        if "mid" in w:
            of = c // w["mid"].shape[2]
            grads["mid"] = _odds(s[:words], w["mid"], of, c - of * w["mid"].shape[2], score[:words], back_words, by)
        grads["in"] = _odds(s[:words], w["in"], c, y[:words] - c * size, score[:words], back_words, by)
    if learn:
        foretold = _room(rooms, "foretold", (steps * n, HIDDEN), kinds)
        if len(at) < len(foretold):
            foretold[...] = 0
        foretold[at] = back
        foretold = foretold.reshape(steps, n, HIDDEN)
        carry, back_turn = np.zeros((n, HIDDEN), kinds), np.ascontiguousarray(np.stack(np.hsplit(w["state"], 2)).transpose(0, 2, 1))
        # what a step's gradients are multiples of, for all steps at once; they take the place of what they are made from
        gate, new = both
        gate *= 0.5
        stay, now = (_room(rooms, k, gate.shape, kinds) for k in ("stay", "now"))
        np.subtract(0.5, gate, out=stay)
        np.subtract(new, states[..., :HIDDEN], out=now)
        now *= stay
        gate += 0.5
        now *= gate
        new *= new
        np.subtract(1, new, out=new)
        new *= gate
        gate[...] = now
        taken = [_room(rooms, k, (len(at), HIDDEN), kinds) for k in ("gate", "new")]
        for t in range(steps - 1, -1, -1):
            k = int(alive[t])
            own, moved = carry[:k], both[:, t, :k]
            moved *= own
            own *= stay[t, :k]
            np.matmul(moved, back_turn, out=product[:, :k])
            own += product[0, :k]
            own += product[1, :k]
            carry += foretold[t]
            if begins[t]:
                carry[fresh[t]] = 0
        for g, out in zip(both, taken, strict=True):
            g.reshape(-1, HIDDEN).take(at, axis=0, out=out, mode="clip")
        grads["state"] = slice(None), np.concatenate([s[:, :HIDDEN].T @ g for g in taken], axis=1)
        rows, gate, new = _add_rows(y, *taken)
        grads["gate"], grads["new"] = (rows, gate), (rows, new)
    return np.bincount(at % n if owner is None else owner.reshape(-1)[at], score, n if owner is None else 0), grads if learn else {}


def run_documents(w: Weights, docs: list[np.ndarray], learn: bool, state: dict | None = None) -> np.ndarray:
    """Natural log-likelihood of each document; when learning, ``w`` moves by Adagrad after every window."""
    out, kind = np.zeros(len(docs)), class_of((w["in"].shape[0], w["in"].shape[2]))
    if not docs:
        return out
    own = packed(w)
    # documents are dealt to lanes, the longest first to the shortest lane, so that windows are full
    many = min(BATCH if learn else 2 * BATCH, len(docs))
    heap, lanes = [(0, k) for k in range(many)], [[] for _ in range(many)]
    for d in np.argsort([-len(d) for d in docs], kind="stable").tolist():
        size, k = heap[0]
        lanes[k].append(d)
        heapq.heapreplace(heap, (size + len(docs[d]), k))
    lanes.sort(key=lambda own: -sum(len(docs[d]) for d in own))
    total = np.array([sum(len(docs[d]) for d in own) for own in lanes], np.int64)
    begin, dealt = np.cumsum(total) - total, [d for lane in lanes for d in lane]
    sizes = np.array([len(docs[d]) for d in dealt], np.int64)
    symbols, owners, starts = np.concatenate([docs[d] for d in dealt]), np.repeat(np.array(dealt, np.int32), sizes), np.zeros(int(total.sum()), bool)
    starts[np.cumsum(sizes) - sizes] = True
    h, rooms = np.zeros((len(lanes), HIDDEN), np.float32), {}
    for start in range(0, int(total.max(initial=0)), WINDOW):
        n = int((total > start).sum())
        h = h[:n]
        steps = int(min(WINDOW, total[0] - start))
        lengths = np.minimum(total[:n] - start, steps)
        place = begin[:n] + start + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < lengths
        place[~inside] = 0  # never looked at
        score, grads = sparse_window(own, symbols[place], lengths, h, kind, learn, owners[place], starts[place] & inside, np.float32(1 / np.sqrt(lengths.sum())), rooms)
        out[: len(score)] += score
        for k, (rows, g) in grads.items():
            if k not in state:
                state[k] = np.full_like(own[k], START if k in ("out", "state") else START_SPARSE)
            squares = g * g
            if isinstance(rows, slice):
                state[k] += squares
                np.sqrt(state[k], out=squares)
            else:
                squares += state[k][rows]
                state[k][rows] = squares
                np.sqrt(squares, out=squares)
            g *= np.float32(RATE)
            g /= squares
            own[k][rows] -= g
    if learn:
        for k, moved in unpacked(own).items():
            if w[k] is not moved:
                w[k][...] = moved
    return out


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    ends = np.cumsum([0] + [like[k].size for k in sorted(like)])
    return {k: flat[i:j].reshape(like[k].shape).astype(np.float32) for k, i, j in zip(sorted(like), ends[:-1], ends[1:], strict=True)}


def _symbols(column) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x), "<u4").astype(np.int32) for x in column.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in order, in tables that end with the row that brings them to CHUNK_TOKENS."""
    held, size = [], 0
    for batch in batches:
        ends, at, before = np.cumsum(batch.column("n_tokens").to_numpy()), 0, 0
        while at < batch.num_rows:
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + CHUNK_TOKENS - size)) + 1)
            held.append(batch.slice(at, stop - at))
            size, before, at = size + int(ends[stop - 1]) - before, int(ends[stop - 1]), stop
            if size >= CHUNK_TOKENS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _moved(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<f2" if len(data) == 2 * size else "<f4").astype(np.float64)


def train(streams: DataFrame, weights: Weights, rounds: int = ROUNDS, tasks: int = 1) -> Weights:
    """One pass over all training documents, in rounds after which the tasks' weights are averaged by their tokens."""
    spark, moved = streams.sparkSession, in_training(weights["in_b"].size)
    schema, size = "n long, data binary", sum(v.size for v in weights.values())

    def average(batches):
        n, total = 0, 0.0
        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, total = n + k, total + k * _moved(data, size)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["n", "data"])

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def local(batches, shared=shared):
            w, state, n = {k: v.copy() for k, v in shared.value.items()}, {}, 0
            for rows in _chunks(batches):
                docs = [moved[d] for d in _symbols(rows.column("symbols"))]
                run_documents(w, docs, True, state)
                n += sum(map(len, docs))
            if n:
                data = np.clip(_flat(w) - _flat(shared.value), -60000, 60000).astype("<f2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([data], pa.binary())], names=["n", "data"])

        own = streams.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(rounds)) == turn)).select("n_tokens", "symbols")
        parts = tasks
        found = own.coalesce(tasks).mapInArrow(local, schema)
        while parts > 1:  # averages of averages, so that one row reaches the driver
            parts = -(-parts // 16)
            found = found.repartition(parts).mapInArrow(average, schema)
        got = [(r["n"], _moved(r["data"], size)) for r in found.collect()]
        if got:
            weights = _shaped(_flat(weights) + sum(n * x for n, x in got) / sum(n for n, _ in got), weights)
    return weights


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    blocks, n = to_blocks(docs, block_bytes)
    answers, table = count_words(blocks, n)
    folded = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    table.ends = docs.where(folded).count()
    table.tokens, table.distinct = table.tokens + table.ends, table.distinct + (table.ends > 0)
    streams = staged(to_symbols(blocks, answers, n, table), "lm-symbols")
    weights = train(streams, initial(table), rounds_for(table.tokens), tasks_for(table.tokens))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for rows in _chunks(batches):
            score = run_documents(shared.value, _symbols(rows.column("symbols")), False) / np.log(10) + rows.column("tail").to_numpy()
            yield from pa.table([*rows.columns[:5], pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]).to_batches()

    out = streams.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(table.tokens).cast("long").alias("train_tokens"), "base_score", "score")
