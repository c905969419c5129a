from itertools import combinations, product
from math import comb

import pytest

from shotloom.operators import exact, hypothesis


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 4), (3, 3), (2, 7), (5, 4), (8, 3)])
def test_mann_whitney_tail(n1, n2):
    sums = [sum(x) - n1 * (n1 + 1) // 2 for x in combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 2):
        assert exact.mann_whitney_upper(u, n1, n2) == pytest.approx(sum(v >= u for v in sums) / len(sums), abs=1e-12)


def test_mann_whitney_tail_of_unlike_sizes():
    assert exact.mann_whitney_upper(8_000_000, 8, 1_000_000) == pytest.approx(1 / comb(1_000_008, 8), rel=1e-9)


@pytest.mark.parametrize("n", [1, 3, 6])
def test_wilcoxon_tail(n):
    sums = [sum(r for r, up in zip(range(1, n + 1), signs, strict=True) if up) for signs in product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 2 + 2):
        assert exact.wilcoxon_upper(w, n) == pytest.approx(sum(v >= w for v in sums) / len(sums), abs=1e-12)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (3, 3), (2, 5), (4, 3), (6, 4)])
def test_smirnov_tail(n1, n2):
    gaps = []
    for c in combinations(range(n1 + n2), n1):
        at = [(sum(x <= p for x in c), p + 1 - sum(x <= p for x in c)) for p in range(n1 + n2)]
        gaps.append([i * n2 - j * n1 for i, j in at])
    for h in range(1, n1 * n2 + 1):
        assert exact.smirnov_upper(h / n1 / n2, n1, n2, True) == pytest.approx(sum(max(map(abs, g)) >= h for g in gaps) / len(gaps), abs=1e-12)
        assert exact.smirnov_upper(h / n1 / n2, n1, n2, False) == pytest.approx(sum(max(g) >= h for g in gaps) / len(gaps), abs=1e-12)


def samples(spark, a, b):
    return spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")


def test_small_samples(spark):
    df = samples(spark, (1, 2, 3), (10, 11, 12))
    for alternative, p in (("two-sided", 0.1), ("less", 0.05), ("greater", 1.0)):
        row = hypothesis.mann_whitney(df, "v", "g", "a", "b", alternative=alternative).first()
        assert (row.method, row.p_value) == ("exact", pytest.approx(p))
    for alternative, d, p in (("two-sided", 1, 0.1), ("greater", 1, 0.05), ("less", 0, 1.0)):
        row = hypothesis.kolmogorov_smirnov(df, "v", "g", "a", "b", alternative=alternative).first()
        assert (row.method, row.d, row.p_value) == ("exact", d, pytest.approx(p))
    tied = hypothesis.mann_whitney(samples(spark, (1, 2, 3), (3, 4, 5)), "v", "g", "a", "b").first()
    assert tied.method == "normal" and any(w.startswith("ties") for w in tied.warnings)
    same = hypothesis.mann_whitney(samples(spark, (1, 1), (1, 1)), "v", "g", "a", "b").first()
    assert same.z is None and same.p_value == 1


def test_wilcoxon(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (4.0, 3.0), (9.0, 5.0)], "a double, b double")
    # differences -2, -3, 1, 4: positive ranks 1 + 4
    for alternative, w, p in (("two-sided", 5, 1.0), ("greater", 5, 0.5625), ("less", 5, 0.5625)):
        row = hypothesis.wilcoxon(df, "a", "b", alternative=alternative).first()
        assert (row.method, row.w, row.p_value) == ("exact", w, pytest.approx(p))
    zero = hypothesis.wilcoxon(df.union(spark.createDataFrame([(1.0, 1.0)], df.schema)), "a", "b").first()
    assert zero.method == "normal" and zero.n == 4 and "zero differences were left out" in zero.warnings
