"""Bootstrap of medians, quantiles and trimmed means of tables of any size, without resampling rows that don't matter.

Of N draws with replacement from N rows in order, the k-th smallest lies at place floor(N u), u being the k-th smallest of N
uniform numbers, which follows a beta law; the next one is the least of the N - k others, uniform above u. So a replicate
of a quantile is one or two places, drawn at once, and the values at these places are looked up by a join. The draws
between two such places are uniform between them: a trimmed mean adds them up chunk by chunk, each chunk's number of draws
coming from a tree of binomial draws that every task can walk by itself. Where values are shared by many rows, a chunk's draws
fall on its values at once (multinomial), so that work grows with the different values. Results depend on seed and replicate alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_ranks
from .resample import SHARED

#: Places of a lookup's bucket are as many as make this number of buckets; rows of a chunk of a trimmed mean.
BUCKETS, CHUNK = 4096, 1 << 19


def _values(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """(v, first, n): each distinct value with its first place in order and its rows; and the number of rows."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v"))
    places = value_ranks(known, "v").select("v", (F.col("upto") - F.col("n")).alias("first"), "n")
    return places, known.count()


def _order_statistics(rng: np.random.Generator, n: int, low: int, high: int) -> tuple[float, float]:
    """The low-th and high-th smallest (from 1) of n uniform numbers."""
    a = rng.beta(low, n - low + 1)
    return a, a if high == low else a + (1 - a) * rng.beta(high - low, n - high + 1)


def _draw_places(spark, n: int, low: int, high: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, a, b): the two order statistics of each replicate, as uniform numbers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            drawn = [_order_statistics(np.random.default_rng([seed, r]), n, low, high) for r in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([a for a, _ in drawn], pa.float64()), pa.array([b for _, b in drawn], pa.float64())], names=["replicate", "a", "b"])

    return spark.range(1, replicates + 1).mapInArrow(run, "replicate long, a double, b double")


def _place(u, n: int):
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("long")


def _lookup(places: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Adds v to rows with a ``place``: places and the values that span them meet in buckets of places."""
    width = -(-n // BUCKETS)
    last = F.col("first") + F.col("n") - 1
    spans = places.select("v", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(last / width))).alias("bucket"))
    return wanted.withColumn("bucket", F.floor(F.col("place") / width)).join(spans, "bucket").where(F.col("place").between(F.col("first"), F.col("last"))).drop("bucket", "first", "last")


def bootstrap_quantile(df: DataFrame, value: str, probability: float, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, stat): a quantile, interpolated between neighbours, of resamples of single rows. Missing values are left out."""
    if not 0 <= probability <= 1:
        raise ValueError("a probability lies between 0 and 1")
    places, n = _values(df, value)
    if n == 0:
        raise ValueError("no values")
    at = (n - 1) * probability
    low, high = math.floor(at) + 1, math.ceil(at) + 1
    drawn = _draw_places(df.sparkSession, n, low, high, replicates, seed)
    wanted = drawn.select("replicate", F.explode(F.array(F.struct(_place(F.col("a"), n).alias("place"), F.lit(1 - (at - math.floor(at))).alias("w")), F.struct(_place(F.col("b"), n).alias("place"), F.lit(at - math.floor(at)).alias("w")))).alias("x"))
    found = _lookup(places, wanted.select("replicate", "x.*").where("w > 0"), n)
    return found.groupBy("replicate").agg(F.sum(F.col("w") * F.col("v")).alias("stat"))


def bootstrap_median(df: DataFrame, value: str, replicates: int, seed: int = 42) -> DataFrame:
    return bootstrap_quantile(df, value, 0.5, replicates, seed)


def draws_of_chunk(seed: int, replicate: int, draws: int, low: float, high: float, bounds: np.ndarray, chunk: int) -> int:
    """How many of ``draws`` uniform numbers in (low, high) fall into a chunk: halves of the chunks share them by binomial draws.

    ``bounds`` are the chunks' ends as numbers from 0 to 1; all chunks' results add up to the draws.
    """
    first, last, node = 0, len(bounds) - 1, 1
    part = lambda i, j: max(0.0, min(high, bounds[j]) - max(low, bounds[i]))
    while last - first > 1 and draws:
        mid = (first + last) // 2
        left, both = part(first, mid), part(first, last)
        share = 0.5 if both <= 0 else min(1.0, left / both)
        taken = int(np.random.default_rng([seed, replicate, node, 7]).binomial(draws, share))
        if chunk < mid:
            last, draws, node = mid, taken, 2 * node
        else:
            first, draws, node = mid, draws - taken, 2 * node + 1
    return draws


def bootstrap_trimmed_mean(df: DataFrame, value: str, share: float, replicates: int, seed: int = 42, chunk_rows: int | None = None) -> DataFrame:
    """(replicate, stat): the mean of resamples of single rows without the floor(share * rows) smallest and largest draws."""
    if not 0 <= share < 0.5:
        raise ValueError("the share that is trimmed at each end lies in [0, 0.5)")
    places, n = _values(df, value)
    if n == 0:
        raise ValueError("no values")
    low, high = math.floor(share * n) + 1, n - math.floor(share * n)
    rows = chunk_rows or CHUNK
    bounds = np.minimum(np.arange(-(-n // rows) + 1) * rows, n) / n
    drawn = _draw_places(df.sparkSession, n, low, high, replicates, seed)
    last = F.col("first") + F.col("n") - 1
    chunked = places.select("v", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / rows), F.floor(last / rows))).alias("chunk"))

    def run(group: pa.Table) -> pa.Table:
        kept = group.filter(pa.compute.is_valid(group.column("v"))).sort_by("first")
        asked = group.filter(pa.compute.is_null(group.column("v")))
        if not len(kept) or not len(asked):
            return pa.table({"replicate": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        chunk = group.column("chunk")[0].as_py()
        start, stop = chunk * rows, min((chunk + 1) * rows, n)
        first, end = np.maximum(kept.column("first").to_numpy(), start), np.minimum(kept.column("last").to_numpy() + 1, stop)
        known = kept.column("v").to_numpy()
        values = np.repeat(known, end - first)
        shared = len(values) >= SHARED * len(known)
        out = []
        for r, a, b in zip(*(asked.column(c).to_pylist() for c in ("replicate", "a", "b")), strict=True):
            ends = [min(int(u * n), n - 1) for u in ((a, b) if high > low else (a,))]
            s = sum(float(values[p - start]) for p in ends if start <= p < stop)
            between = draws_of_chunk(seed, r, max(0, high - low - 1), a, b, bounds, chunk)
            span = np.maximum(0.0, np.minimum(end / n, b) - np.maximum(first / n, a)) if between and shared else None
            if between and shared and span.sum() > 0:
                # uniform numbers fall on a value by the part of its places that lies between
                s += float(np.random.default_rng([seed, r, chunk, 8]).multinomial(between, span / span.sum()) @ known)
            elif between:
                u = np.random.default_rng([seed, r, chunk, 8]).uniform(max(a, start / n), min(b, stop / n), between)
                s += values[np.clip((u * n).astype(np.int64) - start, 0, len(values) - 1)].sum()
            out.append((r, float(s)))
        ids, sums = zip(*out, strict=True)
        return pa.table({"replicate": pa.array(ids, pa.int64()), "s": pa.array(sums, pa.float64())})

    turns = drawn.select("replicate", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(bounds) - 2).cast("long"))).alias("chunk"), F.floor(F.col("replicate") / 500).alias("turn"))
    many = chunked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates // 500).cast("long"))).alias("turn"))
    sums = many.unionByName(turns, allowMissingColumns=True).groupBy("chunk", "turn").applyInArrow(run, "replicate long, s double")
    return sums.groupBy("replicate").agg((F.sum("s") / (high - low + 1)).alias("stat"))
