"""Probability-forecast metrics, curves and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import RANGES, ordinal, running_sums, value_ranks
from .resample import draw

EPS = 2.220446049250313e-16


def checked(df: DataFrame, truth: str, score: str, *keep: str) -> DataFrame:
    """(keep, y, p) with an error for truths other than 0 and 1 and scores that aren't probabilities."""
    y = F.when(F.col(truth).cast("int").isin(0, 1), F.col(truth).cast("int")).otherwise(F.raise_error(F.lit("truth must be 0 or 1")))
    p = F.when(F.col(score).between(0, 1), F.col(score).cast("double")).otherwise(F.raise_error(F.lit("scores must lie in [0, 1]")))
    return df.select(*keep, y.alias("y"), p.alias("p"))


def metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by ranks, average precision over distinct thresholds, log loss, Brier, skills."""
    rows = checked(df, truth, score)
    per = value_ranks(rows, "p", pos=F.sum("y"))
    auc = per.agg(F.struct(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("r"))).scalar()
    curve = running_sums(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "p", {"cn": "n", "cp": "pos"}, descending=True)
    ap = curve.agg(F.sum(F.col("pos") * F.col("cp") / F.col("cn")) / F.sum("pos")).scalar()
    q = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    s = rows.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"), F.avg("p").alias("mean_prediction"), F.avg(-F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    s = s.withColumn("a", auc).withColumn("average_precision", ap).withColumn("prevalence", F.col("positives") / F.col("n"))
    pos, neg = F.col("a.pos"), F.col("a.n") - F.col("a.pos")
    base_log, base_brier = -(F.col("prevalence") * F.ln("prevalence") + (1 - F.col("prevalence")) * F.ln(1 - F.col("prevalence"))), F.col("prevalence") * (1 - F.col("prevalence"))
    return s.select("n", "positives", "prevalence", ((F.col("a.r") - pos * (pos + 1) / 2) / (pos * neg)).alias("roc_auc"), "average_precision", "log_loss", "brier", "mean_prediction", (1 - F.col("log_loss") / base_log).alias("log_loss_skill"), (1 - F.col("brier") / base_brier).alias("brier_skill"), (F.col("mean_prediction") - F.col("prevalence")).alias("calibration_in_the_large"))


def _metrics(per: DataFrame) -> DataFrame:
    """A row per model, from a row per model and distinct score p with its rows n and positives pos."""
    weighted = lambda c: F.sum(F.col("n") * c)
    q = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    # ranges of scores and their totals, a model's at once; any cuts give the same result
    whole = per.groupBy("model").agg(F.percentile_approx("p", [k / RANGES for k in range(1, RANGES)], 1000).alias("_cuts"), F.sum("n").alias("_all"), F.sum("pos").alias("_pos"))
    rows = per.join(F.broadcast(whole), "model").withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("p"))))
    before = Window.partitionBy("model").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = rows.groupBy("model", "_r").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    ranges = ranges.select("model", "_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_n", "_p")])
    inside = Window.partitionBy("model", "_r").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(ranges), ["model", "_r"]).withColumns({"_upto": F.col("_before_n") + F.sum("n").over(inside), "_posupto": F.col("_before_p") + F.sum("pos").over(inside)})
    rank = F.col("_upto") - (F.col("n") - 1) / 2
    cn, cp = F.col("_all") - F.col("_upto") + F.col("n"), F.col("_pos") - F.col("_posupto") + F.col("pos")  # of this score and above
    s = rows.groupBy("model").agg(
        F.sum("n").alias("n"),
        F.sum("pos").cast("long").alias("positives"),
        (weighted(F.col("p")) / F.sum("n")).alias("mean_prediction"),
        (-F.sum(F.col("pos") * F.ln(q) + (F.col("n") - F.col("pos")) * F.ln(1 - q)) / F.sum("n")).alias("log_loss"),
        (F.sum(F.col("pos") * (F.col("p") - 1) * (F.col("p") - 1) + (F.col("n") - F.col("pos")) * F.col("p") * F.col("p")) / F.sum("n")).alias("brier"),
        F.sum(F.col("pos") * rank).alias("r"),
        (F.try_divide(F.sum(F.col("pos") * cp / cn), F.sum("pos"))).alias("average_precision"),
    )
    s = s.withColumn("prevalence", F.col("positives") / F.col("n"))
    pos, neg, share = F.col("positives"), F.col("n") - F.col("positives"), F.col("prevalence")
    auc = F.try_divide(F.col("r") - pos * (pos + 1) / 2, pos * neg)
    base_log, base_brier = -(share * F.ln(share) + (1 - share) * F.ln(1 - share)), share * (1 - share)
    return s.select("model", "n", "positives", "prevalence", auc.alias("roc_auc"), "average_precision", "log_loss", "brier", "mean_prediction", F.try_divide(base_log - F.col("log_loss"), base_log).alias("log_loss_skill"), F.try_divide(base_brier - F.col("brier"), base_brier).alias("brier_skill"), (F.col("mean_prediction") - share).alias("calibration_in_the_large"))


def curve_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """A row per distinct threshold: true and false positives at it, and the rates of both curves."""
    rows = checked(df, truth, score)
    per = running_sums(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), "p", {"cn": "n", "tp": "pos"}, descending=True)
    total = per.agg(F.struct(F.sum("pos").alias("pos"), F.sum("n").alias("n"))).scalar()
    fp = F.col("cn") - F.col("tp")
    per = per.withColumn("t", total)
    return per.select(F.col("p").alias("threshold"), "tp", fp.alias("fp"), (F.col("tp") / F.col("t.pos")).alias("recall"), (fp / (F.col("t.n") - F.col("t.pos"))).alias("false_positive_rate"), (F.col("tp") / F.col("cn")).alias("precision"))


def compare_models(df: DataFrame, truth: str, scores: list[str]) -> DataFrame:
    """Log loss and Brier of several score columns against one truth, in one pass."""
    long = df.select(F.col(truth).cast("int").alias("y"), *[F.col(s).cast("double").alias(s) for s in scores]).unpivot("y", scores, "model", "p")
    q = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    return long.groupBy("model").agg(F.count("*").alias("n"), F.avg(-F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def compare_model_metrics(df: DataFrame, truth: str, scores: list[str]) -> DataFrame:
    """All metrics of several score columns against one truth, a row per model, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("p")) for s in scores]))
    long = df.select(F.col(truth).alias("y"), each.alias("x")).select("y", "x.*")
    known = checked(long, "y", "p", "model")
    return _metrics(known.groupBy("model", "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")))


def group_split(df: DataFrame, group: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """(group, is_test): the share of groups, rounded up, with the smallest hashes; rows follow by a join on the group.

    Groups are counted by their hash's first half; only those of the half that holds the last test group are put in order.
    """
    groups = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_h", draw(seed, group))
    half = F.shiftright("_h", 16)
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 rows at most
    counts = groups.groupBy(half.alias("_b")).agg(F.count("*").alias("_n")).select("_b", "_n", upto.alias("_upto"))
    wanted = F.ceil(F.max("_upto").over(Window.partitionBy()) * test_size)
    edge = counts.withColumn("_want", wanted).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
    near = groups.join(F.broadcast(edge), half == F.col("_b"))
    place = F.col("_upto") - F.col("_n") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", group))
    last = near.withColumn("_k", place).where(F.col("_k") == F.col("_want")).agg(F.max(F.struct("_h", group))).scalar()
    # no last one: no group is wanted
    return groups.withColumn("_last", last).select(group, F.coalesce(F.struct("_h", group) <= F.col("_last"), F.lit(False)).alias("is_test"))


def assert_no_leakage(train: DataFrame, test: DataFrame, group: str) -> None:
    if not train.select(group).intersect(test.select(group)).isEmpty():
        raise ValueError(f"{group}: train and test share groups")


def one_hot_levels(df: DataFrame, column: str, min_share: float = 0.01) -> DataFrame:
    """Levels of a category in order, rare ones pooled as 'infrequent'; level 0 is the one that encoding drops."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    least = df.agg(F.count("*") * min_share).scalar()
    pooled = counts.withColumn("level", F.when(F.col("n") >= least, F.col(column)).otherwise(F.lit("infrequent"))).groupBy("level").agg(F.sum("n").alias("n"))
    return ordinal(pooled, ["level"], name="code")


def standardize(df: DataFrame, *columns: str) -> DataFrame:
    """Columns less their mean, over their population deviation."""
    m = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])).scalar()
    rows = df.withColumn("_m", m)
    return rows.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"_m.{c}.m"), F.col(f"_m.{c}.s")) for c in columns}).drop("_m")


def ordered_target_statistic(df: DataFrame, category: str, target: str, key: str, prior: float, weight: float = 1.0, seed: int = 42, ranges: int = 1024) -> DataFrame:
    """Each row's category as the mean target of that category's earlier rows, in an order by hash, drawn to the prior.

    A category is cut into ranges of the hash, which are summed apart and offset by the ranges before, so that a frequent
    category is many tasks' work.
    """
    h = draw(seed, key)
    rows = df.withColumn("_c", F.col(category)).withColumn("_h", h).withColumn("_r", F.floor(F.col("_h") * ranges / 2**32)).withColumn("_y", F.col(target).cast("double"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside, whole = before("_c", "_r").orderBy("_h", key), before("_c").orderBy("_r")
    totals = rows.groupBy("_c", "_r").agg(F.sum("_y").alias("s"), F.count("_y").alias("n"))
    totals = totals.select(F.col("_c").alias("_c2"), F.col("_r").alias("_r2"), F.coalesce(F.sum("s").over(whole), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("_n"))
    rows = rows.withColumn("_si", F.coalesce(F.sum("_y").over(inside), F.lit(0.0))).withColumn("_ni", F.count("_y").over(inside))
    rows = rows.join(totals, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_r") == F.col("_r2")))
    return rows.select(*df.columns, ((F.col("_s") + F.col("_si") + weight * prior) / (F.col("_n") + F.col("_ni") + weight)).alias("target_statistic"))


def shrunken_rates(groups: DataFrame, hits: str, trials: str, a: float, b: float) -> DataFrame:
    """Beta-binomial posterior means."""
    return groups.withColumn("shrunken_rate", (F.col(hits) + a) / (F.col(trials) + a + b))
