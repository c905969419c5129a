"""Hypothesis tests on sufficient statistics. No result carries a verdict; warnings say what weakens it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import by_alternative, chi2_sf, f_sf, lgamma, normal_sf, t_ppf, t_sf
from . import exact
from .describe import finite, skewness_g1
from .explore import complete_table
from .ranks import meet, running_sums, value_ranks


def _warnings(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in pairs])).alias("warnings")


#: Tasks that different tables are dealt to.
TABLE_TASKS = 96
CLUSTERING = "rows are taken as independent; rows of one cluster may not be"


def two_samples(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """One row: n, mean, variance and skewness of two groups, in one pass; values that aren't finite are counted apart."""
    out = []
    for k, g in ((1, first), (2, second)):
        v = F.when(F.col("_g") == g, F.col("_v"))
        out += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"m{k}"), F.var_samp(v).alias(f"v{k}")]
    rows = df.where(F.col(group).isin(first, second)).select(F.col(group).alias("_g"), F.when(finite(value), F.col(value)).alias("_v"))
    rows = rows.withColumn("_a", F.when(F.col("_g") == first, F.col("_v"))).withColumn("_b", F.when(F.col("_g") == second, F.col("_v")))
    return rows.agg(*out, skewness_g1("_a").alias("g1_1"), skewness_g1("_b").alias("g1_2"), F.count_if(F.col("_v").isNull()).alias("dropped"))


def t_statistic(samples: DataFrame, *, equal_variance: bool = False) -> DataFrame:
    """The samples with ``difference``, its standard error ``se``, ``df`` and ``t``: what the test needs short of its distribution."""
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "v1", "v2"))
    if equal_variance:
        df = n1 + n2 - 2
        se = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        se, df = F.sqrt(a + b), (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return samples.select("*", (F.col("m1") - F.col("m2")).alias("difference"), se.alias("se"), df.alias("df")).withColumn("t", F.col("difference") / F.col("se"))


def t_test(samples: DataFrame, *, equal_variance: bool = False, alternative: str = "two-sided", confidence: float = 0.95) -> DataFrame:
    """Welch's test, or Student's with a pooled variance, of the difference of two means."""
    rows = t_statistic(samples, equal_variance=equal_variance)
    ratio, small = F.greatest("v1", "v2") / F.nullif(F.least("v1", "v2"), F.lit(0.0)), lambda k: F.col(f"n{k}").between(3, 14) & (F.abs(f"g1_{k}") > 1)
    warn = _warnings(
        (F.col("dropped") > 0, "missing or infinite values were dropped"),
        (F.lit(equal_variance) & (ratio > 2), "variances differ by more than a factor of 2"),
        (F.lit(equal_variance) & (F.col("n1") != F.col("n2")), "sample sizes differ"),
        (small(1) | small(2), "a small sample is skewed"),
        (F.lit(True), CLUSTERING),
    )
    # the long expressions of the tail and the quantile stand in the plan once each
    rows = rows.withColumns({"upper": t_sf(F.col("t"), F.col("df")), "half": t_ppf((1 + confidence) / 2, F.col("df")) * F.col("se")})
    p = by_alternative(1 - F.col("upper"), F.col("upper"), alternative)
    return rows.select("n1", "n2", "t", "df", "difference", p.alias("p_value"), (F.col("difference") - F.col("half")).alias("low"), (F.col("difference") + F.col("half")).alias("high"), warn)


def mann_whitney(df: DataFrame, value: str, group: str, first, second, *, alternative: str = "two-sided") -> DataFrame:
    """U of the first sample by average ranks, the probability of superiority, and a p-value.

    The p-value is exact where the smaller sample has 8 values or fewer and none are tied, else normal with tie and
    continuity corrections.
    """
    own = df.where(F.col(group).isin(first, second) & finite(value))
    per = value_ranks(own, value, a=F.count_if(F.col(group) == first))
    s = per.agg(F.sum("a").alias("n1"), (F.sum("n") - F.sum("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    rows = s.select("n1", "n2", u.alias("u"), F.try_divide(u, n1 * n2).alias("superiority"), (n1 * n2 / 2).alias("mean"), sd.alias("sd"), "ties")
    d = F.col("u") - F.col("mean")
    is_exact = (F.least("n1", "n2") <= exact.MANN_WHITNEY_LEAST) & (F.col("ties") == 0) & (F.col("n1") * F.col("n2") <= exact.MANN_WHITNEY_CELLS)
    over = lambda v: exact.column(exact.mann_whitney_upper, F.when(is_exact, v), F.col("n1"), F.col("n2"))
    upper = F.coalesce(over(F.col("u")), normal_sf(F.try_divide(d - 0.5, F.col("sd"))))
    lower = F.coalesce(over(F.col("n1") * F.col("n2") - F.col("u")), normal_sf(F.try_divide(-d - 0.5, F.col("sd"))))
    method = F.when(is_exact, "exact").otherwise("normal").alias("method")
    warn = _warnings((F.col("ties") > 0, "ties: the p-value is not exact"), (F.lit(True), CLUSTERING))
    return rows.select("n1", "n2", "u", "superiority", F.try_divide(d, F.col("sd")).alias("z"), by_alternative(lower, upper, alternative).alias("p_value"), method, warn)


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, first, second, *, alternative: str = "two-sided") -> DataFrame:
    """The largest gap of two empirical distributions, both ways, and the p-value of ``d``.

    ``d`` is the larger gap, or the one that the alternative names: that of the first distribution above the second
    ("greater"), or below. The p-value is exact up to 10,000 values a sample; beyond, that of one sample of the effective
    size n1 n2 / (n1 + n2) (100 at least), or the limiting one-sided one.
    """
    own = df.where(F.col(group).isin(first, second) & finite(value))
    per = own.groupBy(value).agg(*[F.count_if(F.col(group) == g).alias(c) for c, g in (("a", first), ("b", second))])
    cum = running_sums(per, value, {"ca": "a", "cb": "b"})
    n = per.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    gap = F.col("ca") / F.col("n.a") - F.col("cb") / F.col("n.b")
    s = cum.withColumn("n", n).select(gap.alias("g"), "n").agg(F.max("g").alias("d_plus"), F.max(-F.col("g")).alias("d_minus"), F.first("n.a").alias("n1"), F.first("n.b").alias("n2"))
    chosen = {"two-sided": F.greatest("d_plus", "d_minus"), "greater": F.col("d_plus"), "less": F.col("d_minus")}
    if alternative not in chosen:
        raise ValueError(f"unknown alternative {alternative!r}")
    s = s.withColumn("d", F.greatest(F.lit(0.0), chosen[alternative])).withColumn("tied", per.agg(F.sum(F.col("a") + F.col("b")) > F.count("*")).scalar())
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    scaled = F.col("d") * F.col("d") * n1 * n2 / (n1 + n2)
    if alternative == "two-sided":
        # the law of one sample of the effective size, not its limit
        far = exact.column(exact.kolmogorov_upper, F.when(F.greatest("n1", "n2") > exact.KS_MOST, F.col("d")), F.greatest(F.lit(100.0), F.round(n1 * n2 / (n1 + n2))))
    else:
        far = F.exp(-2 * scaled - 2 * F.sqrt(scaled) * (F.greatest(n1, n2) + 2 * F.least(n1, n2)) / F.sqrt(n1 * n2 * (n1 + n2)) / 3)
    is_exact = F.greatest("n1", "n2") <= exact.KS_MOST
    p = F.coalesce(exact.column(exact.smirnov_upper, F.when(is_exact, F.col("d")), F.col("n1"), F.col("n2"), F.lit(alternative == "two-sided")), far)
    warn = _warnings((F.col("tied"), "ties: the p-value is conservative"), (F.lit(True), CLUSTERING))
    return s.select("n1", "n2", "d", "d_plus", "d_minus", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p_value"), F.when(is_exact, "exact").otherwise("asymptotic").alias("method"), warn)


def expected_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, expected) of every pair of levels."""
    cells = complete_table(df, row, column)
    rows, columns = (cells.groupBy(F.col(c).alias(f"_{c}")).agg(F.sum("n").alias(f"_n_{c}")) for c in (row, column))
    total = cells.agg(F.sum("n")).scalar()
    joined = cells.join(rows, F.col(row) == F.col(f"_{row}")).join(columns, F.col(column) == F.col(f"_{column}"))
    return joined.select(row, column, "n", (F.col(f"_n_{row}") * F.col(f"_n_{column}") / total).alias("expected"))


def chi_square(df: DataFrame, row: str, column: str, *, correction: bool = True) -> DataFrame:
    """Pearson's test of independence; Yates' correction for two by two tables only.

    Only cells that hold rows and the margins are looked at: an empty cell adds its expectation, and all empty cells
    together what the others' expectations leave of the total.
    """
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = known.groupBy(F.col(row).alias("_a"), F.col(column).alias("_b")).agg(F.count("*").alias("n"))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"m{c}")) for c in ("_a", "_b"))
    total = cells.agg(F.sum("n").cast("double")).scalar()
    size = [x.agg(F.struct(F.count("*").alias("k"), F.min(f"m{c}").alias("least"))).scalar() for x, c in ((rows, "_a"), (columns, "_b"))]
    e = cells.join(rows, "_a").join(columns, "_b").withColumn("e", F.col("m_a") * F.col("m_b") / total)
    off = F.abs(F.col("n") - F.col("e"))
    yates = F.pow(off - F.least(F.lit(0.5), off), F.lit(2.0)) / F.col("e")
    s = e.agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.sum(F.pow(off, F.lit(2.0)) / F.col("e")).alias("plain"), F.sum(yates).alias("yates"), F.sum("e").alias("covered"))
    s = s.withColumns({"sa": size[0], "sb": size[1]})
    empty = F.col("sa.k") * F.col("sb.k") - F.col("cells")
    left = F.when(empty > 0, F.greatest(F.lit(0.0), F.col("n") - F.col("covered"))).otherwise(0.0)
    # of a two by two table's cells one is empty, or two of equal expectation
    each = F.try_divide(left, empty)
    moved = F.coalesce(empty * F.try_divide(F.pow(each - F.least(F.lit(0.5), each), F.lit(2.0)), each), F.lit(0.0))
    s = s.select("n", (F.col("sa.k") - 1).alias("r"), (F.col("sb.k") - 1).alias("c"), (F.col("plain") + left).alias("chi2_plain"), (F.col("yates") + moved).alias("yates"), (F.col("sa.least") * F.col("sb.least") / F.col("n") < 5).alias("low"))
    s = s.withColumn("dof", F.col("r") * F.col("c"))
    s = s.withColumn("chi2", F.when((F.col("dof") == 1) & F.lit(correction), F.col("yates")).otherwise(F.col("chi2_plain")))
    return s.select("n", "dof", "chi2", chi2_sf(F.col("chi2"), F.col("dof")).alias("p_value"), F.sqrt(F.try_divide("chi2_plain", F.col("n") * F.least("r", "c"))).alias("cramers_v"), "chi2_plain", "r", "c", _warnings((F.col("low"), "some expected counts are below 5")))


def once_per_table(tables: DataFrame, found, *columns: str) -> DataFrame:
    """Adds columns of ``found``, a function of tables with cells a, b, c, d, which is asked once for each different table.

    Different tables are few and small against their work, so they are dealt to a fixed number of tasks.
    """
    cells = ["a", "b", "c", "d"]
    each = found(tables.select(*cells).distinct().repartition(TABLE_TASKS, *cells))
    # kept, a few bytes a table: the long expressions are planned and met once, however often the result is read
    each = each.select(*cells, *columns).persist(StorageLevel.MEMORY_AND_DISK)
    return meet(tables.drop(*columns), each, cells, *columns)


def fisher_exact(tables: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """``odds_ratio`` and ``p_value`` of rows with cells a, b, c, d; like tables are tested once."""
    return once_per_table(tables, lambda own: _fisher_exact(own, alternative), "odds_ratio", "p_value")


def _fisher_exact(tables: DataFrame, alternative: str) -> DataFrame:
    """tables: rows with cells a, b, c, d. Adds ``odds_ratio`` (ad / bc) and ``p_value``: tables as probable at most as the observed.

    The probabilities fall away from the mode faster and faster, so each tail is a window of ten deviations from where it
    begins, beyond which nothing is left that a double holds: memory grows with the root of the margins, not with them.
    """
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    low, high = F.greatest(F.lit(0), (F.col("a") - F.col("d"))).cast("long"), F.least(F.col("a") + F.col("b"), F.col("a") + F.col("c")).cast("long")
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    logp = lambda k: choose(a + b, k) + choose(c + d, a + c - k) - choose(a + b + c + d, a + c)
    n = a + b + c + d
    sd = F.sqrt(F.coalesce(F.try_divide((a + b) * (a + c) * (b + d) * (c + d), n * n * (n - 1)), F.lit(0.0)))
    mode = F.least(F.greatest(F.floor(F.try_divide((a + b + 1) * (a + c + 1), n + 2)), F.col("_low")), F.col("_high"))
    rows = tables.withColumns({"_low": low, "_high": high}).withColumns({"_w": F.ceil(10 * sd + 40), "_m": mode, "_o": logp(a), "_k": F.col("a").cast("long")})
    up = F.col("_k") >= F.col("_m")
    side = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    window = lambda k, rising: side(F.greatest(k, F.col("_low")), F.least(k + F.col("_w"), F.col("_high"))) if rising else side(F.greatest(k - F.col("_w"), F.col("_low")), F.least(k, F.col("_high")))
    if alternative == "two-sided":
        # by halving: how far from the mode on the other side a table is as improbable as the observed
        span = F.when(up, F.col("_m") - F.col("_low")).otherwise(F.col("_high") - F.col("_m")) + 1
        to = lambda i: F.when(up, F.col("_m") - i).otherwise(F.col("_m") + i)

        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("long")
            far = logp(to(mid).cast("double")) <= F.col("_o") + 1e-7
            return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(far, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(far, mid).otherwise(s["hi"]).alias("hi")))

        first = F.when(up, F.lit(1)).otherwise(F.lit(0)).cast("long")
        rows = rows.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(first.alias("lo"), F.greatest(span.cast("long"), first).alias("hi")), halve)["lo"])
        start = to(F.col("_f"))
        terms = F.when(up, F.concat(window(F.col("_k"), True), window(start, False))).otherwise(F.concat(window(F.col("_k"), False), window(F.greatest(start, F.col("_k") + 1), True)))
    elif alternative == "greater":
        terms = F.when(up, window(F.col("_k"), True)).otherwise(side(F.greatest(F.col("_k"), F.col("_m") - F.col("_w")), F.least(F.col("_m") + F.col("_w"), F.col("_high"))))
    elif alternative == "less":
        terms = F.when(up, side(F.greatest(F.col("_low"), F.col("_m") - F.col("_w")), F.least(F.col("_k"), F.col("_m") + F.col("_w")))).otherwise(window(F.col("_k"), False))
    else:
        raise ValueError(f"unknown alternative {alternative!r}")
    p = F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, k: s + F.exp(logp(k.cast("double")))))
    return rows.withColumn("odds_ratio", F.try_divide(a * d, b * c)).withColumn("p_value", p).drop("_low", "_high", "_w", "_m", "_o", "_k", "_f")


def paired_t(pairs: DataFrame, a: str, b: str, *, alternative: str = "two-sided") -> DataFrame:
    """On differences of pairs that were joined by key; incomplete pairs are dropped."""
    d = pairs.where(finite(a) & finite(b)).select((F.col(a) - F.col(b)).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("difference"), F.stddev_samp("d").alias("sd"))
    rows = s.select("n", "difference", (F.col("difference") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))
    return rows.withColumn("p_value", by_alternative(1 - t_sf(F.col("t"), F.col("df")), t_sf(F.col("t"), F.col("df")), alternative))


def wilcoxon(pairs: DataFrame, a: str, b: str, *, alternative: str = "two-sided") -> DataFrame:
    """Signed ranks of nonzero differences: both rank sums, the median difference, and a p-value.

    ``w`` is the smaller rank sum, or that of the positive differences with a one-sided alternative. The p-value is exact
    up to 50 differences without ties or zeros, else normal with tie correction.
    """
    d = pairs.where(finite(a) & finite(b)).select((F.col(a) - F.col(b)).alias("d"))
    whole = d.agg(F.struct(F.percentile("d", F.lit(0.5)).alias("median"), F.count_if(F.col("d") == 0).alias("zeros"))).scalar()
    per = value_ranks(d.where("d <> 0").withColumn("m", F.abs("d")), "m", up=F.count_if(F.col("d") > 0))
    s = per.agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("up")) * F.col("rank")).alias("w_minus"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    w = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    rows = s.select("n", "w_plus", "w_minus", w.alias("w"), sd.alias("sd"), "ties", whole.alias("o"))
    mean = n * (n + 1) / 4
    up, down = (F.try_divide(F.col(c) - mean, F.col("sd")) for c in ("w_plus", "w_minus"))
    is_exact = (F.col("n") <= exact.WILCOXON_MOST) & (F.col("ties") == 0) & (F.col("o.zeros") == 0)
    tails = [F.coalesce(exact.column(exact.wilcoxon_upper, F.when(is_exact, F.col(c)), F.col("n")), normal_sf(z)) for c, z in (("w_minus", down), ("w_plus", up))]
    warn = _warnings((F.col("ties") > 0, "ties: the p-value is not exact"), (F.col("o.zeros") > 0, "zero differences were left out"), (F.lit(True), CLUSTERING))
    return rows.select("n", "w_plus", "w_minus", "w", F.try_divide(F.col("w") - mean, F.col("sd")).alias("z"), F.col("o.median").alias("median_difference"), by_alternative(*tails, alternative).alias("p_value"), F.when(is_exact, "exact").otherwise("normal").alias("method"), warn)


def group_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    own = df.where(finite(value) & F.col(group).isNotNull())
    return own.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def anova(groups: DataFrame) -> DataFrame:
    """One-way analysis of variance from (n, mean, var) per group."""
    total = groups.agg(F.struct(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))).scalar()
    s = groups.withColumn("t", total).agg(F.count("*").alias("k"), F.first("t.n").alias("n"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("t.mean"), F.lit(2.0))).alias("between"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"), (F.max("var") / F.nullif(F.min("var"), F.lit(0.0))).alias("ratio"), F.min("n").alias("least"), F.max("n").alias("most"))
    rows = s.withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k")).withColumn("f", (F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2")))
    warn = _warnings((F.col("ratio") > 2, "variances differ by more than a factor of 2"), (F.col("most") > 2 * F.col("least"), "group sizes differ by more than a factor of 2"), (F.col("least") < 15, "a group has fewer than 15 values"), (F.col("k") == 2, "two groups: equivalent to a t-test"), (F.lit(True), CLUSTERING))
    return rows.select("k", "n", "f", "df1", "df2", f_sf(F.col("f"), F.col("df1"), F.col("df2")).alias("p_value"), warn)


def welch_anova(groups: DataFrame) -> DataFrame:
    g = groups.withColumn("w", F.col("n") / F.col("var"))
    total = g.agg(F.struct(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("mean"))).scalar()
    g = g.withColumn("t", total)
    s = g.agg(F.count("*").alias("k"), F.sum(F.col("w") * F.pow(F.col("mean") - F.col("t.mean"), F.lit(2.0))).alias("a"), F.sum(F.pow(1 - F.col("w") / F.col("t.w"), F.lit(2.0)) / (F.col("n") - 1)).alias("l"))
    k = F.col("k").cast("double")
    rows = s.select("k", (F.col("k") - 1).alias("df1"), ((k * k - 1) / (3 * F.col("l"))).alias("df2"), ((F.col("a") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("l"))).alias("f"))
    warn = _warnings((F.col("k") == 2, "two groups: equivalent to a t-test"), (F.lit(True), CLUSTERING))
    return rows.withColumn("p_value", f_sf(F.col("f"), F.col("df1"), F.col("df2"))).select("*", warn)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    own = df.where(finite(value) & F.col(group).isNotNull()).select(F.col(value).alias("v"), F.col(group).alias("g"))
    per = value_ranks(own, "v").select("v", "rank", F.col("n").alias("tied"))
    sums = own.groupBy("g", "v").agg(F.count("*").alias("n")).join(per, "v").groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = per.agg(F.sum(F.col("tied").cast("double") * F.col("tied") * F.col("tied") - F.col("tied"))).scalar()
    s = sums.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    n = F.col("n").cast("double")
    s = s.withColumns({"_ties": ties, "_dropped": df.agg(F.count_if(F.col(group).isNotNull() & ~F.coalesce(finite(value), F.lit(False)))).scalar()})
    rows = s.select("k", "n", (F.col("k") - 1).alias("df"), ((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))).alias("h"), "_ties", "_dropped")
    warn = _warnings((F.col("_dropped") > 0, "values that aren't finite were left out"), (F.col("k") == 2, "two groups: equivalent to a two-sample test"), (F.col("_ties") > 0, "ties: the statistic is corrected for them"), (F.lit(True), CLUSTERING))
    return rows.select("k", "n", "df", "h", chi2_sf(F.col("h"), F.col("df")).alias("p_value"), warn)
