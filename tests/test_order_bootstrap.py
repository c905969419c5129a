from math import comb

import numpy as np
import pytest

from shotloom.operators import order_bootstrap as ob
from shotloom.operators import resample


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


def at_most(n, i, k):
    """P(the k-th smallest of n draws from n places lies at place i or below, from 0)."""
    p = (i + 1) / n
    return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))


def test_median_follows_its_exact_law(spark):
    n, b = 15, 20_000
    got = ob.bootstrap_median(frame(spark, [*np.arange(n) ** 2, None, float("nan")]), "v", b).toPandas()
    assert sorted(got["replicate"]) == list(range(1, b + 1))
    share = np.bincount(np.sqrt(got["stat"]).round().astype(int), minlength=n) / b
    law = np.diff([0.0] + [at_most(n, i, 8) for i in range(n)])
    assert np.abs(share - law).max() < 5 * np.sqrt(0.25 / b)
    again = ob.bootstrap_median(frame(spark, np.arange(n) ** 2).repartition(3), "v", 50).toPandas().set_index("replicate")["stat"]
    assert (got.set_index("replicate")["stat"][again.index] == again).all()


@pytest.mark.parametrize("probability", [0.0, 0.1, 0.5, 1.0])
def test_quantiles_like_resampling(spark, probability):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=60), 1)
    got = ob.bootstrap_quantile(frame(spark, x), "v", probability, 4000).toPandas()["stat"].to_numpy()
    brute = np.quantile(rng.choice(x, (4000, 60)), probability, axis=1)
    assert len(got) == 4000
    for q in (0.05, 0.25, 0.5, 0.75, 0.95):
        assert abs(np.quantile(got, q) - np.quantile(brute, q)) <= 0.15
    assert abs(got.mean() - brute.mean()) < 5 * brute.std() / np.sqrt(2000) + 1e-9


@pytest.mark.parametrize("share, chunk_rows", [(0.1, 7), (0.25, 1000), (0.0, 16), (0.49, 5)])
def test_trimmed_means_like_resampling(spark, share, chunk_rows):
    rng = np.random.default_rng(2)
    x = np.append(np.round(rng.normal(size=50), 1), 100.0)
    got = ob.bootstrap_trimmed_mean(frame(spark, x), "v", share, 3000, chunk_rows=chunk_rows).toPandas()["stat"].to_numpy()
    cut = int(share * 51)
    brute = np.sort(rng.choice(x, (3000, 51)), axis=1)[:, cut : 51 - cut].mean(1)
    assert len(got) == 3000
    assert abs(got.mean() - brute.mean()) < 5 * brute.std() * np.sqrt(2 / 3000)
    assert abs(got.std() / brute.std() - 1) < 0.12


def test_chunks_share_all_draws():
    bounds = np.linspace(0, 1, 14)
    for r in range(20):
        assert sum(ob.draws_of_chunk(3, r, 1000, 0.2, 0.77, bounds, c) for c in range(13)) == 1000
        assert ob.draws_of_chunk(3, r, 1000, 0.2, 0.77, bounds, 0) == 0
    assert all(sum(resample.dealt_to(1, r, 333, 1000, 64, c) for c in range(16)) == 333 for r in range(20))


def test_edges(spark):
    assert {r["stat"] for r in ob.bootstrap_median(frame(spark, [2.5]), "v", 5).collect()} == {2.5}
    for bad in (lambda: ob.bootstrap_median(frame(spark, [None]), "v", 5), lambda: ob.bootstrap_quantile(frame(spark, [1]), "v", 1.5, 5), lambda: ob.bootstrap_trimmed_mean(frame(spark, [1]), "v", 0.5, 5)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("statistic", ["mean_difference", "welch_t"])
def test_dealt_permutations(spark, statistic):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, k < 70, float(rng.normal() + 0.3 * (k < 70))) for k in range(200)], "unit long, g boolean, v double")
    sums = resample.units(rows, "v", "unit", "g")
    dealt = resample.permutation_dealt(sums, "g", True, 2000, statistic=statistic, rows=16).toPandas()
    ranked = resample.permutation_differences(sums, "g", True, 2000, statistic=statistic).toPandas()
    assert set(dealt["labelled"]) == {70} and sorted(dealt["replicate"]) == list(range(1, 2001))
    assert abs(dealt["difference"].mean() - ranked["difference"].mean()) < 5 * ranked["difference"].std() * np.sqrt(2 / 2000)
    assert abs(dealt["difference"].std() / ranked["difference"].std() - 1) < 0.12
    one, other = (resample.permutation_test(sums, "g", True, 2000, statistic=statistic, dealt=d).first() for d in (True, False))
    assert one.observed == pytest.approx(other.observed) and abs(one.p_value - other.p_value) < 0.05
