"""One pass over the rows, no task with all copies of a row, and splits by counted hashes."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from shotloom.operators import evaluate, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [0.0, 0.25, 1.0])
def test_split_without_ranking_all_groups(spark, share):
    df = spark.range(900).select(F.when(F.col("id") % 300 != 7, F.concat(F.lit("g"), F.col("id") % 300)).alias("g"))
    split = evaluate.group_split(df, "g", share)
    assert "_before" not in plan(split)  # before, every group had a place
    order = sorted({r.g for r in df.collect()} - {None}, key=lambda g: (int(hashlib.md5(f"42:{g}".encode()).hexdigest()[:8], 16), g))
    assert {r.g: r.is_test for r in split.collect()} == {g: k < math.ceil(len(order) * share) for k, g in enumerate(order)}


def test_repeats_go_before_rows_meet(spark):
    left, right = spark.range(40).selectExpr("nullif(id % 4, 3) AS a"), spark.range(60).selectExpr("nullif(id % 3 + 2, 4) AS b")
    both = queries.in_both(left, right)
    assert "Join" not in plan(both) and plan(both).count("HashAggregate") >= 2  # before, every row went to the join
    assert {r.a for r in both.collect()} == {2, None} and both.count() == 2


def test_models_in_one_pass(spark):
    df = spark.range(4000).select((F.xxhash64("id") % 3 == 0).alias("y"), ((F.col("id") * 7919 % 1009) / 1009).alias("p"), (F.col("id") % 5 / 10).alias("q"))
    found = evaluate.compare_model_metrics(df, "y", ["p", "q"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") == 0  # before, two a model and jobs of their own
    rows = {r.model: r for r in found.collect()}
    for c in "pq":
        own = evaluate.metrics(df, "y", c).first()
        assert {k: v for k, v in rows[c].asDict().items() if k != "model"} == pytest.approx(own.asDict())
