"""The trie of conversations' turns, built depth by depth, and what sharing its prefixes saves.

A node is a distinct sequence of first turns (role, text); it is known by its depth and its smallest member. Building goes
by depth: what is live at a depth is grouped by (parent node, next turn) and the least conversation of a group is its node;
partial sums are made before rows move, so a first turn that a third of all conversations share is a row a task. Rolling
up goes by depth too, from the deepest: a level's children are summed by parent and joined to the level above.

Three things keep levels few and rows small. Turns are known by a 128-bit digest of role and text, so texts are read once
and never shuffled. Conversations that are alike to the end are one class with a weight before the first level, however
many there are. A class that is alone in its node has an unbranched path left, which one join adds for all such classes
after the last level; levels go on only as long as prefixes are shared by different conversations.

Defined cases: a null role or text is empty; turns are in order of ``turn``, null first, ties by digest; repeated rows are
turns of their own; rows without a ``conv_id`` take no part; a conversation without turns is a member of the root; other
columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free, staged

#: Turns are numbered by ranges of ``turn`` of this width, and members' ids are written in pieces of this width.
TURN_RANGE, ID_RANGE = 1024, 1 << 16
#: Longest prefix that a rebuilt conversation takes over, and the group that it takes it from.
LONGEST_PREFIX, FAMILY = 5, 100
NO_ENDS = hashlib.sha256(b"").hexdigest()


def number_turns(table: DataFrame) -> DataFrame:
    """(conv, pos from 0, key, len): conversations' turns in order; ``key`` is the digest of role and text, ``len`` the text's code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = table.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.char_length(text).cast("long").alias("len"))
    # repeated rows are counted, and a long conversation is cut into ranges of turns that are offset by the ranges before
    rows = rows.groupBy("conv", "turn", "key").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(2**63)).cast("long")))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv", "range").agg(F.sum("n").alias("_n")).select("conv", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("turn"), "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("n").over(inside)).join(offsets, ["conv", "range"])
    last = F.col("_first") + F.col("_upto")
    return rows.select("conv", F.explode(F.sequence(last - F.col("n"), last - 1)).alias("pos"), "key", "len")


def prefix_length(conv: Column) -> Column:
    """Turns that a conversation takes over from the first of its family."""
    return F.crc32(conv.cast("string")) % (LONGEST_PREFIX + 1)


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and turns (conv, depth from 1, key, len), each with the first turns of its family's first conversation."""
    counts = numbered.groupBy("conv").agg(F.count("*").alias("n"))
    base = counts.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = counts.withColumns({"base": F.col("conv") - F.col("conv") % FAMILY, "h": prefix_length(F.col("conv"))}).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = numbered.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "len")
    # at most 5 turns of a base, for the 100 ids of its family at most
    first = numbered.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < LONGEST_PREFIX)).select(F.col("conv").alias("base"), "pos", "key", "len")
    shared = convs.where("taken > 0").join(first, "base").where("pos < taken").select("conv", (F.col("pos") + 1).alias("depth"), "key", "len")
    return convs.select("conv", "length"), own.unionByName(shared)


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(rep, w, length, ends): conversations that are alike to the end as one row: the smallest, how many, and the digest of their ids.

    Ids are put in order within ranges of ids, which hold as many as they are wide at most; a class's ranges pass through
    the hash one after the other, so that no list of a whole class is ever held.
    """
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key"))
    signed = convs.join(turns.groupBy("conv").agg(mark(1).alias("s1"), mark(2).alias("s2")), "conv", "left").na.fill(0, ["s1", "s2"])
    pieces = signed.groupBy("s1", "s2", "length", F.floor(F.col("conv") / ID_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select("s1", "s2", "length", "range", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition("s1", "s2", "length").sortWithinPartitions("s1", "s2", "length", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["rep", "w", "length", "ends"], []
        at, rep, n, digest = None, None, 0, None

        def batch() -> pa.RecordBatch:
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for rows in batches:
            for s1, s2, length, _, first, count, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (s1, s2, length) != at:
                    if at is not None:
                        out.append((rep, n, at[2], digest.hexdigest()))
                    at, rep, n, digest = (s1, s2, length), first, 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
                n += count
            if len(out) > 10_000:
                yield batch()
                out.clear()
        if at is not None:
            out.append((rep, n, at[2], digest.hexdigest()))
        if out:
            yield batch()

    return pieces.mapInArrow(run, "rep long, w long, length long, ends string")


def build_trie(table: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that the subtree's nodes hold
    once instead of once a member), ends_sha256 (of the ids of the members that end there).
    """
    numbered = staged(number_turns(table), "trie-numbered")
    convs, turns = rebuild(numbered)
    kinds = staged(classes(convs, turns), "trie-classes")
    turns = staged(turns.join(kinds.select(F.col("rep").alias("conv")), "conv", "left_semi").repartition("conv").sortWithinPartitions("depth"), "trie-turns")
    free(numbered)
    next_turn = lambda depth: turns.where(F.col("depth") == depth).select(F.col("conv").alias("rep"), "key", "len")

    def level(groups, depth: int) -> DataFrame:
        """A node per group: the least class, conversations, classes, the class that ends there, and whether one class is left with turns to come."""
        alone = (F.count("*") == 1) & (F.max("length") > depth)
        ends = F.min(F.when(F.col("length") == depth, F.col("rep")))
        return groups.agg(F.min("rep").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("len").alias("len"), F.count("*").alias("n_classes"), ends.alias("ended"), F.when(alone, F.max("w")).alias("alone"), F.max("length").alias("length"))

    root = kinds.agg(F.count("*").alias("n"), F.min("rep").alias("rep")).first()
    everything = kinds.withColumns({"node": F.lit(None).cast("long"), "len": F.lit(0).cast("long"), "key": F.lit(None).cast("binary")})
    levels = [staged(level(everything.groupBy("node", "key"), 0), "trie-level")]
    # below a root of one class the path is unbranched
    live = kinds.where((F.col("length") > 0) & F.lit(root["n"] > 1)).select("rep", "w", "length", F.lit(root["rep"]).cast("long").alias("node"))
    depth, live = 1, staged(live.join(next_turn(1), "rep"), "trie-live")
    while not live.isEmpty():
        groups = staged(level(live.groupBy("node", "key"), depth), "trie-level")
        levels.append(groups)
        shared = groups.where("n_classes > 1").select("node", "key", F.col("conv_id").alias("child"))
        # a group that many share is split by Spark on the side that has a row a class
        onward = live.where(F.col("length") > depth).join(shared, ["node", "key"]).select("rep", "w", "length", F.col("child").alias("node"))
        before, depth = live, depth + 1
        live = staged(onward.join(next_turn(depth), "rep"), "trie-live")
        free(before)
    free(live)

    shared = reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(d).cast("long")) for d, x in enumerate(levels)])
    # paths of classes that are alone
    paths = shared.where("alone IS NOT NULL").select(F.col("conv_id").alias("rep"), F.col("alone").alias("w"), "length", F.col("depth").alias("from"))
    tails = turns.select(F.col("conv").alias("rep"), "depth", "len").join(paths, "rep").where(F.col("depth") > F.col("from"))
    saved = (F.col("w") - 1) * F.sum("len").over(Window.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("depth") == F.col("length")
    tails = tails.select(F.col("rep").alias("conv_id"), "depth", F.col("rep").alias("parent_conv_id"), F.col("w").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, F.col("rep")).alias("ended"), "from")
    tails = staged(tails, "trie-tails")
    top = tails.where(F.col("depth") == F.col("from") + 1).select("conv_id", F.col("from").alias("depth"), F.col("saved_tokens").alias("path_saved"))
    nodes = staged(shared.join(top, ["conv_id", "depth"], "left"), "trie-nodes")

    # from the deepest level upwards
    found, below = [], None
    columns = ["conv_id", "depth", F.col("node").alias("parent_conv_id"), "n_convs"]
    for d in reversed(range(len(levels))):
        own = nodes.where(F.col("depth") == d)
        if below is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in ("kids", "kid_leaves", "kid_saved")})
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("kid_leaves"), F.sum("saved_tokens").alias("kid_saved"))
            own = own.join(sums, "conv_id", "left").na.fill(0, ["kids", "kid_leaves", "kid_saved"])
        path = F.col("alone").isNotNull().cast("long")
        kids, saved = F.col("kids") + path, (F.col("n_convs") - 1) * F.col("len") + F.col("kid_saved") + F.coalesce("path_saved", F.lit(0))
        below = staged(own.select(*columns, kids.alias("n_children"), F.when(kids == 0, F.lit(1)).otherwise(F.col("kid_leaves") + path).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), "ended"), "trie-rolled")
        found.append(below)
    rows = reduce(DataFrame.unionByName, [*found, tails.drop("from")])
    ends = kinds.select(F.col("rep").alias("ended"), "ends")
    rows = rows.join(ends, "ended", "left").select(*tails.drop("from", "ended").columns, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    out = staged(rows, "trie")
    free(kinds, turns, nodes, tails, *levels, *found)
    return out
