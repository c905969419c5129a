"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Each word has a sparse random index vector, derived from its hash; its context vector is the sum of the index vectors of
the words around it in the fitting sample. Its sub-word vector is the sum of the index vectors of its first byte, its last
byte and its last two. The order of words is kept by binding: the products, place by place, of the index vectors of a word
and its successor, whose mean is near zero for words that change and positive for those that repeat. A document is the
means of its words' index, context and sub-word vectors and of its bindings. Scores see nothing but the text.

Fitting takes at most ``SAMPLE`` labelled documents (those with the smallest hash of their ids), which is what reaches
the driver, as vectors of fixed size; scoring reads every whole text in one pass without a shuffle.

Defined cases: a null text is the empty text, which gets the score of the zero vector; labels that are null are not
learned from; without a label of each kind every score is the share of label 1 (0.5 without labels); repeated rows give a
row each; a null ``doc_id`` stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import forget_all
from .words import Words, batched, mix, words_of

#: Labelled documents that fitting may take.
SAMPLE = 8000
BUCKETS = 1 << 14
DIM, NONZERO, HIDDEN = 48, 6, 32
CONTEXT = (1, 2)
THRESHOLD = 0.3
#: Seeds of the hashes of the three sub-word parts.
FIRST, LAST, LAST_TWO = 1, 2, 3
#: Words whose vectors are held at a time.
TILE = 1 << 13


def index_vectors() -> np.ndarray:
    """The index vector of each bucket: ``NONZERO`` places of 1 or -1."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(NONZERO):
        h = mix(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(NONZERO) + np.uint64(k + 1))
        out[np.arange(BUCKETS), (h >> np.uint64(8)) % np.uint64(DIM)] += np.where(h & np.uint64(1), 1, -1)
    return out


def word_rows(w: Words) -> np.ndarray:
    """The bucket of each word."""
    return (w.hash % np.uint64(BUCKETS)).astype(np.int64)


def part_rows(w: Words) -> Iterator[np.ndarray]:
    """The bucket of each word's first byte, last byte, and last two bytes (its only byte stands for both)."""
    first, last, before = (w.data[at].astype(np.uint64) for at in (w.start, w.end - 1, np.maximum(w.end - 2, w.start)))
    for seed, value in ((FIRST, first), (LAST, last), (LAST_TWO, before << np.uint64(8) | last)):
        yield (mix(value | np.uint64(seed << 32)) % np.uint64(BUCKETS)).astype(np.int64)


def _add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """out[at] += values, where ``at`` may repeat."""
    if len(at):
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(values[order], first, axis=0)


def _add_words(out: np.ndarray, doc: np.ndarray, values: Callable[[slice], np.ndarray]) -> None:
    """Adds the rows ``values(words)`` to those of ``out`` that the ascending ``doc`` names, some ``TILE`` words at a time.

    A document is summed in pieces that are counted from its own start, so its sum doesn't depend on what is beside it.
    """
    if not len(doc):
        return
    at = np.arange(len(doc))
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), at, 0))
    piece = np.flatnonzero((at - begin) % TILE == 0)
    tiles = np.split(piece, np.flatnonzero(np.diff(piece // TILE)) + 1)
    for tile, stop in zip(tiles, [*(t[0] for t in tiles[1:]), len(doc)], strict=True):
        np.add.at(out, doc[tile], np.add.reduceat(values(slice(tile[0], stop)), tile - tile[0], axis=0))


def context_sums(texts: list[bytes], index: np.ndarray) -> np.ndarray:
    """Per bucket the sum of the index vectors of its words' neighbours."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    for part in batched(texts, 1 << 19):
        w = words_of(texts[part])
        rows = word_rows(w)
        for k in CONTEXT:
            same = np.flatnonzero(w.doc[k:] == w.doc[:-k])
            _add_rows(out, rows[same], index[rows[same + k]])
            _add_rows(out, rows[same + k], index[rows[same]])
    return out


def word_vectors(index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Index vectors beside context vectors of length 1."""
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return np.concatenate([index, (context / np.maximum(length, 1e-6)).astype(np.float32)], axis=1)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row per text: the means of its words' vectors, sub-word vectors and bindings, and the logarithm of its length."""
    wide = vectors.shape[1]
    out = np.zeros((len(texts), wide + 2 * DIM + 1), np.float32)
    index = np.ascontiguousarray(vectors[:, :DIM])
    for part in batched(texts, 1 << 19):
        w = words_of(texts[part])
        rows, n, own = word_rows(w), w.counts(), np.zeros((w.n_docs, wide + 2 * DIM), np.float32)
        _add_words(own[:, :wide], w.doc, lambda k, rows=rows: vectors[rows[k]])
        for at in part_rows(w):
            _add_words(own[:, wide : wide + DIM], w.doc, lambda k, at=at: index[at[k]])
        same = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        left, right = rows[same], rows[same + 1]
        _add_words(own[:, wide + DIM :], w.doc[same], lambda k, a=left, b=right: index[a[k]] * index[b[k]])
        out[part, :-1] = own / np.maximum(n, 1)[:, None]
        out[part, -1] = np.log1p(n) / 4
    return out


@dataclass
class Model:
    vectors: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None
    temperature: float
    share: float
    scale: tuple[np.ndarray, np.ndarray] | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(logits(self.layers, (pooled(texts, self.vectors) - self.scale[0]) / self.scale[1]) / self.temperature, -60, 60)))


def logits(layers, x: np.ndarray) -> np.ndarray:
    a, b, c, d = layers
    return (np.tanh(x @ a + b) @ c + d)[:, 0].astype(np.float64)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> tuple:
    """Two layers by Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            own = order[k : k + batch]
            hidden = np.tanh(x[own] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3])[:, 0])) - y[own])[:, None] / len(own)
            back = (error @ layers[2].T) * (1 - hidden**2)
            grads = [x[own].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], error.sum(0)]
            step += 1
            for p, g, a, b in zip(layers, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def best_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which held-back logits have the least cross-entropy."""
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of an id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` of the labelled documents; the caller leaves out what may not be learned from."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # at most `sample` rows of two numbers: a proven bound
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", F.coalesce("text", F.lit("")).alias("text")).repartition(12, "id").persist()
    index = index_vectors()
    shared = spark.sparkContext.broadcast(index)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all()
        out = np.zeros((BUCKETS, DIM), np.float32)
        for b in batches:
            out += context_sums([t.encode() for t in b.column(0).to_pylist()], shared.value)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    context = np.zeros((BUCKETS, DIM), np.float32)
    for r in rows.select("text").mapInArrow(contexts, "sums binary").toLocalIterator():
        context += np.frombuffer(r["sums"], np.float32).reshape(BUCKETS, DIM)
    vectors = word_vectors(index, context)
    table = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled([t.encode() for t in b.column(2).to_pylist()], table.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    got = sorted(rows.mapInArrow(features, "id long, y int, x binary").collect())
    rows.unpersist()
    y = np.array([r["y"] for r in got], float)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or min(share, 1 - share) == 0:
        return Model(vectors, None, 1.0, share)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64)
    scale = x.mean(0), x.std(0) + 1e-6
    x = (x - scale[0]) / scale[1]
    held = np.arange(len(y)) % 6 == 0
    layers = train(x[~held], y[~held])
    return Model(vectors, layers, best_temperature(logits(layers, x[held]), y[held]), share, scale)


def score(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """The carried columns, then ``score`` (probability of label 1) and ``predicted``, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                s = shared.value.scores([t.encode() for t in some.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array(s, pa.float64())], names=["row", "score"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learnable(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labelled rows outside the held-out fold 0."""
    return labels.where(fold(F.col("doc_id"), folds) != 0)


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model predicts as label 1, with all their columns."""
    rows = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text"), model, "document")
    return rows.where("predicted = 1").select("document.*")
