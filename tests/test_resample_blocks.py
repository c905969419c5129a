"""Resampling where the units' sums lie in arrays: the draws of the definition, in blocks and parts, without rows of draws."""

import hashlib
from statistics import fmean

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions.digest import first_bits, number_tiles, text_tiles
from shotloom.operators import ranks, resample


def bits(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("prefix", ["", "42:1:", "7:10000:é:", "x" * 43, "y" * 61, "z" * 130])
def test_first_bits(prefix):
    for first, tile in number_tiles(0, 1200):
        assert [int(x) for x in first_bits(prefix.encode(), tile)] == [bits(f"{prefix}{first + i}") for i in range(tile.size)]
    texts = ["", "a", "é", "b" * 57, "c" * 70, "12", "34"]
    raw = [t.encode() for t in texts]
    found = {int(i): int(x) for at, tile in text_tiles(np.array([len(t) for t in raw]), b"".join(raw)) for i, x in zip(at, first_bits(prefix.encode(), tile), strict=True)}
    assert found == {i: bits(prefix + t) for i, t in enumerate(texts)}


def clusters(spark, n):
    """Labels of several lengths, one cluster without values, strata of very different sizes and units without one."""
    return spark.range(3 * n).select(F.concat(F.lit("u"), F.col("id") % n).alias("u"), F.when(F.col("id") % n == 0, None).when(F.col("id") % n % 10 < 8, "big").otherwise("é: small").alias("s"), F.when(F.col("id") % n != 1, F.col("id") % 97 * 0.25).alias("v"))


@pytest.mark.parametrize("strata", [(), ("s",)])
@pytest.mark.parametrize("few", [0, 1024])
def test_bootstrap_in_parts(spark, monkeypatch, strata, few):
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "MOST_UNITS", 64)
    monkeypatch.setattr(resample, "FEW_DRAWS", few)
    own = resample.units(clusters(spark, 300), "v", "u", *strata)
    drawn = resample.bootstrap_means(own, 30, strata=strata)
    # no row per draw: before, slots were rows that were counted and joined to the sums
    assert "slot" not in drawn._jdf.queryExecution().toString()
    found = {r.replicate: r["mean"] for r in drawn.collect()}
    assert sorted(found) == list(range(1, 31))
    units = {}
    for r in own.collect():
        units.setdefault(tuple(r[c] for c in strata), {})[r.pos] = (r.n, r.s1 or 0.0)
    units = {k: v for k, v in units.items() if None not in k}
    for r in (1, 7, 30):
        got = [u[bits(":".join(["42", str(r), *k, str(s)])) % len(u)] for k, u in units.items() for s in range(len(u))]
        assert found[r] == pytest.approx(sum(s for _, s in got) / sum(n for n, _ in got), rel=1e-12)


@pytest.mark.parametrize("near", [0, 10])
def test_labels_by_ranks_of_hashes(spark, monkeypatch, near):
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "NEAR", near or 10)
    rows = [(f"u{k}", k % 3 == 0, float(k % 23)) for k in range(400)] if near else [("a", True, 1.0), ("b", False, 4.0), ("c", False, 9.0)]
    own = resample.units(spark.createDataFrame(rows, "u string, g boolean, v double"), "v", "u", "g")
    null = resample.permutation_differences(own, "g", True, 40)
    assert "row_number() windowspecdefinition(replicate" not in null._jdf.queryExecution().toString()  # before, each replicate was sorted
    found = {r.replicate: r.difference for r in null.collect()}
    k = sum(g for _, g, _ in rows)
    for r in range(1, 41):
        order = sorted(rows, key=lambda x: (bits(f"42:{r}:{x[0]}"), x[0]))
        assert found[r] == pytest.approx(fmean(v for *_, v in order[:k]) - fmean(v for *_, v in order[k:]), abs=1e-9)


def test_chunks_share_the_nodes_of_their_tree():
    # a block of chunks is walked at once: before, the way from the root was drawn anew for each
    whole = resample.dealt_over(3, 5, 400, 1000, 16, 0, 63)
    assert sum(whole) == 400 and whole == [resample.dealt_to(3, 5, 400, 1000, 16, c) for c in range(63)]
    assert resample.dealt_over(3, 5, 400, 1000, 16, 20, 30) == whole[20:30]


def test_ordinal_halves_its_cuts(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("b"))
    for order in (["a"], ["b", "a"]):
        out = ranks.ordinal(df, order)
        assert "lambda" not in out._jdf.queryExecution().analyzed().toString()  # before, every row met every cut
        rows = [(r.ordinal, *[(r[c] is not None, r[c]) for c in order]) for r in out.collect()]
        assert [r[0] for r in sorted(rows, key=lambda r: r[1:])] == list(range(3000))
