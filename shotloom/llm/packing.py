"""Best-fit packing of token sequences, hierarchically and without a shuffle of the texts.

Every scan task cuts its documents, packs the pieces best-fit in falling order of length, and emits the bins that are
nearly full. What is underfull goes up a tree: in each round a node packs the bins of ``fan_in`` nodes as whole items,
again best-fit. A node passes at most ``carry`` bins up, the emptiest; the others are emitted as they are (no piece is
lost: a bin fuller than half can only take in a smaller one, of which a node leaves one at most). So each node
holds at most ``fan_in * carry`` bins of at most ``capacity`` pieces, whatever the size of the input.

Defined cases: a null or empty text is a document of its end id only; repeated rows are packed once each; a null
``doc_id`` stays null; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged
from .tokens import encoded, encoder, release, tokenizer_path

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BINS = f"done boolean, sequence_id long, fill int, members array<{_MEMBER}>"
_MEMBER_PA = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces; only the first may be shorter than the capacity."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    """A task's cut: batches of (doc_id, text) to batches of pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, ids in encoded(enc, batch):
                data, at = ids.tobytes() + end, 0
                for k, n in enumerate(_cut_lengths(len(data) // 4, capacity)):
                    own = data[4 * at : 4 * (at + n)]
                    for column, value in zip(out, (doc_id, k, at, n, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None), strict=True):
                        column.append(value)
                    at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)][: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def cut_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    return _id_and_text(docs).mapInArrow(_cut(path, capacity, end_id, with_ids), PIECES + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin, by position. Bins are found by their free room through a bit set."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(item)
        by_room[room - size].append(k)
        rooms |= 1 << (room - size)
    return bins


def _round(level: int, capacity: int, slack: int, carry: int, last: bool):
    """A task's round: items (bins or single pieces) to bins, of which the nearly full are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        if level:
            members = [m for b in batches for m in b.column(0).to_pylist()]
            sizes = np.array([sum(x["length"] for x in m) for m in members], np.int64)
        else:
            table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
            sizes = table.column("length").to_numpy() if table else np.zeros(0, np.int64)
        if not len(sizes):
            return
        bins = best_fit(sizes, capacity)
        fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        done = np.full(len(bins), True)
        if not last:
            emptiest = np.argsort(fill, kind="stable")[:carry]
            done[emptiest[fill[emptiest] < capacity - slack]] = False
        ids = (np.int64(level) << 56) + (np.int64(node) << 32) + np.arange(len(bins))
        for at in range(0, len(bins), 5000):
            some = bins[at : at + 5000]
            if level:
                lists = pa.array([[x for i in b for x in members[i]] for b in some], pa.list_(_MEMBER_PA))
            else:
                order = pa.array(np.concatenate([np.array(b, np.int64) for b in some]))
                flat = table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(order).combine_chunks()
                ends = np.cumsum([0] + [len(b) for b in some]).astype(np.int32)
                columns = [flat.column(k).chunk(0) for k in range(5)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_MEMBER_PA)))
            part = slice(at, at + len(some))
            yield pa.RecordBatch.from_arrays([pa.array(done[part]), pa.array(ids[part]), pa.array(fill[part].astype(np.int32)), lists], names=["done", "sequence_id", "fill", "members"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int | None = None, fan_in: int = 8, carry: int = 256) -> DataFrame:
    """Sequences of at most ``capacity``: a row per piece with its sequence_id and offset.

    ``slack``: a bin with no more free room than this is nearly full; a 64th of the capacity unless given.
    """
    slack = capacity // 64 if slack is None else slack
    first = _round(0, capacity, slack, carry, False)
    return _merge(pieces.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(first, _BINS), capacity, slack, fan_in, carry)


def _merge(packed: DataFrame, capacity: int, slack: int, fan_in: int, carry: int) -> DataFrame:
    """The tree above the scan tasks' bins."""
    bins = staged(packed, "pack")
    # a node leaves at most `carry` bins, so this number of nodes follows the number of scan tasks
    left = bins.where(~F.col("done"))
    nodes, level, done = max(1, -(-left.count() // carry)), 1, bins.where("done")
    while True:
        nodes, last = max(1, -(-nodes // fan_in)), nodes <= fan_in
        up = staged(left.select("members").repartition(nodes).mapInArrow(_round(level, capacity, slack, carry, last), _BINS), "pack")
        done = done.unionByName(up.where("done"))
        if last:
            break
        left, level = up.where(~F.col("done")), level + 1
    return _placed(done)


def _placed(bins: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            if not len(flat):
                continue
            lengths = flat.field("length").to_numpy(zero_copy_only=False)
            begun = np.cumsum(lengths) - lengths
            firsts = np.repeat(np.cumsum(counts) - counts, counts)
            offset = begun - begun[firsts]
            yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return bins.select("sequence_id", "members").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = 8, carry: int = 256) -> DataFrame:
    """All documents cut and packed: a row per piece, with its place in a sequence.

    A scan task cuts and packs in one Python worker; two chained ones would hold twice the memory.
    """
    path, slack = tokenizer or tokenizer_path("byte_bpe_50k.json"), capacity // 64
    cut, first = _cut(path, capacity, end_id, False), _round(0, capacity, slack, carry, False)
    return _merge(_id_and_text(docs).mapInArrow(lambda batches: first(cut(batches)), _BINS), capacity, slack, fan_in, carry)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token ids of each sequence (at most ``capacity`` each), from the documents and their places."""
    pieces = cut_documents(docs, tokenizer, capacity, end_id, with_ids=True).dropDuplicates(["doc_id", "piece", "ids_crc32"])
    placed = packed.join(pieces.select("doc_id", "piece", "ids_crc32", "ids"), ["doc_id", "piece", "ids_crc32"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
