import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import boosting, models

CONTEXT = {"numeric": ("shot_distance", "shot_angle"), "categorical": ("body_part",), "boolean": ("under_pressure",)}


def shots_frame(spark, n=600, flip=None, seed=7):
    rng = np.random.default_rng(seed)
    d, a = rng.uniform(2, 40, n), rng.uniform(0, 1.5, n)
    part = rng.choice(["Head", "Foot", "Other"], n, p=[0.3, 0.6, 0.1])
    hit = rng.random(n) < 1 / (1 + np.exp(-(1.5 - 0.22 * d + 2 * a - 1.0 * (part == "Head"))))
    if flip is not None:
        hit[flip] = ~hit[flip]
    rows = [(k, k % 30, float(d[k]), float(a[k]), str(part[k]), bool(k % 3 == 0), bool(hit[k])) for k in range(n)]
    return spark.createDataFrame(rows, "shot_id long, match_id long, shot_distance double, shot_angle double, body_part string, under_pressure boolean, goal boolean")


@pytest.fixture(scope="module")
def shots(spark):
    return shots_frame(spark).cache()


def plain_tree(x, g, h, edges, depth, step, penalty, least_weight, least_rows, leaves):
    """A tree by exhaustive search over rows, best leaf first; returns each row's step."""
    def split(at):
        best = None
        for f, cuts in enumerate(edges):
            for c in cuts:
                right = x[at, f] >= c
                l, r = at[~right], at[right]
                if min(len(l), len(r)) < max(1, least_rows) or min(h[l].sum(), h[r].sum()) < least_weight:
                    continue
                gain = 0.5 * (g[l].sum() ** 2 / (h[l].sum() + penalty) + g[r].sum() ** 2 / (h[r].sum() + penalty) - g[at].sum() ** 2 / (h[at].sum() + penalty))
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, l, r)
        return best

    open_leaves, done = [(np.arange(len(x)), 0)], []
    while open_leaves and (leaves is None or len(open_leaves) + len(done) < leaves):
        tried = [(split(at) if d < depth else None, k) for k, (at, d) in enumerate(open_leaves)]
        tried = [(b[0], k, b) for b, k in tried if b]
        if not tried:
            break
        _, k, (_, l, r) = max(tried, key=lambda z: z[0])
        _, d = open_leaves.pop(k)
        open_leaves += [(l, d + 1), (r, d + 1)]
    out = np.zeros(len(x))
    for at, _ in open_leaves + done:
        out[at] = -step * g[at].sum() / (h[at].sum() + penalty)
    return out


@pytest.mark.parametrize("leaves, least_weight, least_rows", [(None, 5.0, 1), (4, 1e-3, 30)])
def test_like_plain_trees(spark, shots, leaves, least_weight, least_rows):
    fitted = boosting.fit_histogram(shots, **CONTEXT, leaves=leaves, least_weight=least_weight, least_rows=least_rows, step=0.5, subsample=1.0, colsample=1.0, bins=8, most=3, patience=3)
    _, inner, _ = boosting._inner_and_held(shots, "match_id", CONTEXT["numeric"], 42)
    stages, names = models._encoder(inner, *CONTEXT.values(), False)
    rows = stages[0].transform(inner)
    columns = [f"f{k}" for k in range(len(names))]
    edges = boosting._bin_edges(rows, columns, 8)
    data = rows.select("label", "shot_id", *columns).toPandas().sort_values("shot_id").to_numpy(float)
    y, x = data[:, 0], data[:, 2:]
    m = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(fitted.trees):
        p = 1 / (1 + np.exp(-m))
        m = m + plain_tree(x, p - y, p * (1 - p), edges, 3, 0.5, 1.0, least_weight, least_rows, leaves)
    got = models.predict(fitted.model, inner).select("shot_id", "probability").orderBy("shot_id").toPandas()["probability"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-m)), atol=1e-9)


@pytest.mark.parametrize("fit, options", [(boosting.fit_histogram, {"colsample": 0.7}), (boosting.fit_histogram, {"leaves": 5, "least_rows": 10}), (boosting.fit_ordered, {})])
def test_learns_stops_saves_and_explains(spark, shots, tmp_path, fit, options):
    fitted = fit(shots, **CONTEXT, **options, step=0.4, most=4, patience=2)
    assert 1 <= fitted.trees <= fitted.notes["trees_grown"] <= 4 and fitted.notes["best_iteration"] == fitted.trees - 1
    assert fitted.notes["stopped_early"] == (fitted.notes["trees_grown"] < 4)
    at = lambda d, part: (1, d, 0.6, part, False)
    rows = spark.createDataFrame([at(4.0, "Foot"), at(35.0, "Foot"), at(4.0, "never seen")], "shot_id long, shot_distance double, shot_angle double, body_part string, under_pressure boolean")
    near, far, unseen = (r["probability"] for r in models.predict(fitted.model, rows).collect())
    assert 0 < far < near < 1 and 0 < unseen < 1
    models.save_artifact(fitted, "boosted", str(tmp_path), shots, fitted.notes)
    assert [r["probability"] for r in models.predict(models.load_model(f"{tmp_path}/boosted/model"), rows).collect()] == [near, far, unseen]
    shares = boosting.importance(fitted, spark).collect()
    assert {r["feature"] for r in shares} == set(fitted.names) and abs(sum(r["share"] for r in shares) - 1) < 1e-9
    assert shares[0]["feature"] in ("shot_distance", "shot_angle")
    if fit is boosting.fit_ordered:
        assert fitted.names == ["shot_distance", "shot_angle", "body_part", "under_pressure"]


def test_refresh_changes_nothing(shots, spark, monkeypatch):
    found = []
    for refresh in (2, 100):
        monkeypatch.setattr(boosting, "REFRESH", refresh)
        for fit in (boosting.fit_histogram, boosting.fit_ordered):
            fitted = fit(shots, numeric=("shot_distance",), step=0.3, most=4, patience=4, depth=1)
            found.append([r["probability"] for r in models.predict(fitted.model, shots).orderBy("shot_id").limit(50).collect()])
    assert np.allclose(found[0], found[2], atol=1e-12) and np.allclose(found[1], found[3], atol=1e-12)


def test_own_target_stays_out_of_the_residual(spark):
    """With trees of one shape, a row's own target changes no model that its residual comes from."""
    tree = boosting.Tree(1, [0], [0.5], [0.0, 0.0])

    def residual_models(flip):
        y = [float((k * 7) % 3 == 0) for k in range(256)]
        y[flip] = 1 - y[flip]
        rows = spark.createDataFrame([(k, y[k], [float(k % 2)]) for k in range(256)], "key long, y double, x array<double>")
        rows = rows.withColumn("s", boosting.prefix_of(F.col("key"), 7, 42)).withColumn("m", F.expr("array_repeat(0.1D, s + 2)"))
        for _ in range(3):
            rows = rows.withColumn("m", F.expr(boosting.ordered_margins([tree], [boosting._leaf_values(rows, tree, 8, 0.5, 3.0)])))
        return {r["key"]: (r["s"], r["m"]) for r in rows.select("key", "s", "m").collect()}

    plain = residual_models(0)
    assert {s for s, _ in plain.values()} >= {0, 1, 2, 3}
    for flip in (5, 60, 200):
        other, whole = residual_models(flip), residual_models(0)
        assert other[flip][1][-1] == pytest.approx(residual_models(flip)[flip][1][-1], abs=0)
        same = {k: v for k, v in plain.items() if k not in (0, flip)}
        assert any(other[k][1] != v[1] for k, v in same.items())
        # both runs differ in rows 0 and flip; where neither lies in the prefix before a row, its model is untouched
        for k, (s, m) in plain.items():
            if plain[0][0] <= s and plain[flip][0] <= s:
                assert other[k][1][-1] == pytest.approx(m[-1], abs=1e-12)
        assert whole == plain


def test_errors(spark, shots):
    for bad in ({"numeric": ("goal",)}, {"numeric": ("shot_angle", "shot_angle")}, {"numeric": ()}):
        for fit in (boosting.fit_histogram, boosting.fit_ordered):
            with pytest.raises(ValueError):
                fit(shots, **bad)
    with pytest.raises(ValueError, match="identifiers"):
        boosting.fit_ordered(shots, numeric=("match_id", "shot_angle"))
    with pytest.raises(ValueError, match="one"):
        boosting.fit_histogram(shots.where("goal"))


def test_the_five_models():
    assert list(boosting.ALL_MODELS) == ["logistic_baseline", "logistic_contextual", "boosted_contextual", "boosted_leafwise_contextual", "boosted_ordered_contextual"]
