"""Gradient boosting by histograms of gradients, on Spark aggregates.

Features are cut into bins once. A tree's level is one aggregate over the rows: sums of gradients and hessians by (node,
feature, bin), which combine before they shuffle and come to the driver as a bounded table; the splits of regularised gain
are chosen there. A tree is three short lists in heap order, applied to rows by an expression, so that scores are updated
and models are saved without Python in a task.

``fit_histogram`` grows level by level or leaf by leaf (the leaf of the greatest gain first, up to a number of leaves).
``fit_ordered`` grows symmetric trees, one split a level, on residuals that a row's own target has no part in: rows lie in
a random order by hash, and there is a model for each prefix of half, a quarter, an eighth ... of them; a row's residual
comes from the model of the longest prefix before it, and categories become ordered target statistics. Gains are summed
from those residuals; the leaf values of every prefix's model come from its own rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import group_split, ordered_target_statistic
from .models import BASELINE, CONTEXTUAL, Fitted, _encoder, _labelled, fit_logistic, reject_leaky_features
from .ranks import quantiles

MOST_TREES, PATIENCE = 600, 40
#: Trees between two writings of the rows' scores; ids that would let a model know who shot rather than how.
REFRESH = 16
IDENTIFIERS = {"player_id", "player", "team_id", "team", "match_id"}


@dataclass
class Tree:
    """Heap order: inner nodes' features and thresholds (a row goes right from the threshold on), the lowest level's weights."""

    depth: int
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)

    @classmethod
    def empty(cls, depth: int) -> Tree:
        return cls(depth, [0] * (2**depth - 1), [math.inf] * (2**depth - 1), [0.0] * 2**depth)


def _list(values, kind: str) -> str:
    one = {"int": str, "double": lambda x: "double('inf')" if x == math.inf else f"{float(x)!r}D"}[kind]
    return f"array({', '.join(one(x) for x in values)})"


def node_sql(tree: Tree, steps: int, x: str = "x") -> str:
    """The heap index of the node where a row stands after some steps down from the root."""
    f, t = _list(tree.feature, "int"), _list(tree.threshold, "double")
    return f"aggregate(sequence(1, {steps}), 0, (i, k) -> 2 * i + IF({x}[{f}[i]] >= {t}[i], 2, 1))" if steps else "0"


def score_sql(trees: list[Tree], start: float, x: str = "x") -> str:
    """The sum of the trees' weights at a row's leaves, on top of ``start``."""
    if not trees:
        return f"{start!r}D"
    depth = trees[0].depth
    rows = ", ".join(f"named_struct('f', {_list(t.feature, 'int')}, 't', {_list(t.threshold, 'double')}, 'w', {_list(t.weight, 'double')})" for t in trees)
    leaf = f"aggregate(sequence(1, {depth}), 0, (i, k) -> 2 * i + IF({x}[t.f[i]] >= t.t[i], 2, 1)) - {2**depth - 1}"
    return f"aggregate(array({rows}), {start!r}D, (s, t) -> s + t.w[{leaf}])"


def gradient_histogram(rows: DataFrame, node: Column, margin: Column, target: str = "y", bins: str = "b") -> DataFrame:
    """(node, feature, bin, g, h, n): sums of the logistic loss's first and second derivatives over an array of bins a row."""
    p = 1 / (1 + F.exp(-margin))
    each = rows.select(node.alias("node"), (p - F.col(target)).alias("g"), (p * (1 - p)).alias("h"), F.posexplode(bins).alias("feature", "bin"))
    return each.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def _tables(histogram: DataFrame, width: int, features: int) -> dict[int, np.ndarray]:
    """Per node: (g, h, n) by feature and bin."""
    out: dict[int, np.ndarray] = {}
    for r in histogram.collect():  # nodes x features x bins at most
        out.setdefault(r["node"], np.zeros((3, features, width)))[:, r["feature"], int(r["bin"])] = r["g"], r["h"], r["n"]
    return out


def _gains(table: np.ndarray, penalty: float, least_weight: float, least_rows: int) -> np.ndarray:
    """The gain of every (feature, cut after bin); -inf where a side is too small."""
    left = np.cumsum(table, axis=2)[:, :, :-1]
    right = table.sum(2, keepdims=True) - left
    square = lambda s: s[0] ** 2 / (s[1] + penalty)
    gain = 0.5 * (square(left) + square(right) - square(table.sum(2, keepdims=True)))
    ok = np.minimum(left[1], right[1]) >= least_weight
    ok &= np.minimum(left[2], right[2]) >= max(1, least_rows)
    return np.where(ok, gain, -np.inf)


def _best(gain: np.ndarray, edges: list[list[float]], allowed: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of the greatest gain above 0 among the allowed features; ties go to the first."""
    gain = gain.copy()
    for f, e in enumerate(edges):
        gain[f, len(e) :] = -np.inf
    gain[~allowed] = -np.inf
    at = int(gain.argmax())
    f, k = divmod(at, gain.shape[1])
    return (float(gain[f, k]), f, k) if gain[f, k] > 1e-12 else None


def grow(tables_at, edges: list[list[float]], allowed: np.ndarray, depth: int, step: float, penalty: float, least_weight: float, least_rows: int, leaves: int | None) -> tuple[Tree, np.ndarray]:
    """A tree and each feature's gain. ``tables_at(tree, level)`` gives the histograms of the nodes of a level.

    Every node's best split down to ``depth`` depends on its own rows alone, so levels are worked out whole; with
    ``leaves`` the splits are then taken from a queue, greatest gain first.
    """
    trial, found, sums = Tree.empty(depth), {}, {}
    for level in range(depth):
        tables = tables_at(trial, level)
        wanted = [0] if level == 0 else [c for p in found if p >= 2 ** (level - 1) - 1 for c in (2 * p + 1, 2 * p + 2)]
        for node in wanted:
            table = tables[node]
            sums.setdefault(node, table[:, 0].sum(1))
            if best := _best(_gains(table, penalty, least_weight, least_rows), edges, allowed):
                gain, f, k = best
                found[node] = (gain, f, edges[f][k])
                trial.feature[node], trial.threshold[node] = f, edges[f][k]
                sums[2 * node + 1] = table[:, f, : k + 1].sum(1)
                sums[2 * node + 2] = table[:, f, k + 1 :].sum(1)
        if not any(n in found for n in wanted):
            break
    tree, gains = Tree.empty(depth), np.zeros(len(edges))
    queue, split = ([(-found[0][0], 0)] if 0 in found else []), set()
    while queue and (leaves is None or len(split) + 1 < leaves):
        gain, node = heapq.heappop(queue)
        split.add(node)
        _, f, threshold = found[node]
        tree.feature[node], tree.threshold[node] = f, threshold
        gains[f] -= gain
        for child in (2 * node + 1, 2 * node + 2):
            if child in found:
                heapq.heappush(queue, (-found[child][0], child))
    ends = [c for p in split for c in (2 * p + 1, 2 * p + 2) if c not in split] or [0]
    for node in ends:
        g, h, _ = sums[node]
        place = node
        while place < 2**depth - 1:  # rows of a leaf above the lowest level go left
            place = 2 * place + 1
        tree.weight[place - (2**depth - 1)] = -step * g / (h + penalty)
    return tree, gains


@dataclass(frozen=True)
class _Binned:
    stages: list
    names: list[str]
    edges: list[list[float]]

    def rows(self, df: DataFrame, *keep: str) -> DataFrame:
        """(y, x, b, kept columns): the target, the features and their bins."""
        for s in self.stages:
            df = s.transform(df)
        f = [f"f{k}" for k in range(len(self.names))]
        splits = [[-math.inf, *(e or [0.0]), math.inf] for e in self.edges]
        cut = Bucketizer(splitsArray=splits, inputCols=f, outputCols=[f"b{k}" for k in range(len(f))]).transform(df)
        return cut.select(F.col("label").alias("y"), F.array(*f).alias("x"), F.array(*[F.col(f"b{k}").cast("int") for k in range(len(f))]).alias("b"), *keep)


def _bin_edges(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Cuts at exact quantiles of each column; a value at a cut lies right of it, so the smallest value is none."""
    long = df.select(F.posexplode(F.array(*columns)).alias("c", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    found = quantiles(long.groupBy("c", "v").agg(F.count("*").alias("n")), "v", "n", [k / bins for k in range(bins + 1)], ["c"])
    by = {r["c"]: r["q"] for r in found.collect()}  # a row a column
    return [sorted({x for x in by[k] if x > by[k][0]}) if k in by else [] for k in range(len(columns))]


def _loss(rows: DataFrame, margin: str) -> float:
    m = F.expr(margin)
    return rows.agg(F.avg(F.ln(1 + F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - m * F.col("y"))).first()[0]


def _fitted(stages: list, names: list[str], trees: list[Tree], start: float, gains: np.ndarray, tried: int, most: int, losses: list[float]) -> Fitted:
    p = f"1 / (1 + exp(-({score_sql(trees, start, '_x')})))"
    f = ", ".join(f"f{k}" for k in range(len(names)))
    last = [SQLTransformer(statement=f"SELECT *, array({f}) AS _x FROM __THIS__"), SQLTransformer(statement=f"SELECT *, {p} AS _p1 FROM __THIS__"), SQLTransformer(statement="SELECT *, 1 - _p1 AS _p0 FROM __THIS__"), VectorAssembler(inputCols=["_p0", "_p1"], outputCol="probability")]
    notes = {"trees_grown": tried, "best_iteration": len(trees) - 1, "validation_loss": min(losses), "stopped_early": tried < most}
    return Fitted(PipelineModel([*stages, *last]), names, len(trees), dict(zip(names, gains.tolist(), strict=True)), notes)


def _inner_and_held(train: DataFrame, group: str, numeric, seed: int, share: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, kept until they are unpersisted, and cut by groups: those to fit on, and those that say when to stop; both need both outcomes."""
    rows = _labelled(train.dropna(subset=list(numeric)) if numeric else train)
    split = rows.join(group_split(rows, group, share, seed), group).persist(StorageLevel.MEMORY_AND_DISK)
    outcomes = {(r["is_test"], r["label"]) for r in split.select("is_test", "label").distinct().collect()}  # four at most
    for test, name in ((False, "fitting"), (True, "validation")):
        if len({y for t, y in outcomes if t == test}) < 2:
            split.unpersist()
            raise ValueError(f"the {name} slice has one outcome only")
    return split, split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")


def fit_histogram(train: DataFrame, key: str = "shot_id", group: str = "match_id", numeric=BASELINE, categorical=(), boolean=(), *, leaves: int | None = None, step: float = 0.05, depth: int = 3, least_weight: float = 5.0, least_rows: int = 1, subsample: float = 0.8, colsample: float = 0.8, penalty: float = 1.0, most: int = MOST_TREES, patience: int = PATIENCE, bins: int = 64, seed: int = 42) -> Fitted:
    """Boosted trees level by level, or with ``leaves`` leaf by leaf; the trees up to the least validation loss are kept.

    A fifth of the groups says when to stop. Rows are drawn per tree by a hash of ``key``, features per tree by the seed.
    """
    split, inner, held = _inner_and_held(train, group, numeric, seed)
    stages, names = _encoder(inner, numeric, categorical, boolean, False)
    stages = stages[:1]  # the columns f0, f1, ...
    encoded = stages[0].transform(inner)
    binned = _Binned(stages, names, _bin_edges(encoded, [f"f{k}" for k in range(len(names))], bins))
    rows = binned.rows(inner, F.col(key).alias("key")).persist(StorageLevel.MEMORY_AND_DISK)
    watched = binned.rows(held).persist(StorageLevel.MEMORY_AND_DISK)
    n, hits = rows.agg(F.count("*"), F.sum("y")).first()
    start, width = math.log(hits / (n - hits)), max(len(e) for e in binned.edges) + 1
    trees, gains, losses, best = [], [], [], 0
    base, base_held, done = rows.withColumn("m", F.lit(start)), watched.withColumn("m", F.lit(start)), 0
    while len(trees) < most and len(trees) - best < patience:
        if len(trees) - done >= REFRESH:  # scores of all trees so far, from the rows as they were binned
            for old in (base, base_held):
                old.unpersist()
            base, base_held = (x.withColumn("m", F.expr(score_sql(trees, start))).persist(StorageLevel.MEMORY_AND_DISK) for x in (rows, watched))
            done = len(trees)
        turn = len(trees)
        margin = f"m + {score_sql(trees[done:], 0.0)}"
        drawn = base.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col("key")), F.lit(1 << 20)) < int(subsample * (1 << 20)))
        chosen = np.random.default_rng([seed, turn]).permutation(len(names))[: max(1, math.ceil(colsample * len(names)))]
        allowed = np.isin(np.arange(len(names)), chosen)
        at = lambda tree, level: _tables(gradient_histogram(drawn, F.expr(node_sql(tree, level)), F.expr(margin)), width, len(names))  # noqa: B023, E731
        tree, gain = grow(at, binned.edges, allowed, depth, step, penalty, least_weight, least_rows, leaves)
        trees.append(tree)
        gains.append(gain)
        losses.append(_loss(base_held, f"m + {score_sql(trees[done:], 0.0)}"))
        if losses[-1] < losses[best - 1] or best == 0:
            best = len(trees)
    for x in (split, rows, watched, base, base_held):
        x.unpersist()
    return _fitted(stages, names, trees[:best], start, sum(gains[:best]), len(trees), most, losses)


def category_rates(df: DataFrame, category: str, target: str, prior: float, weight: float = 1.0) -> DataFrame:
    """(category, rate): the mean target of a category over all rows, drawn to the prior."""
    return df.groupBy(category).agg(((F.sum(F.col(target).cast("double")) + weight * prior) / (F.count("*") + weight)).alias("rate"))


def prefix_of(key: Column, prefixes: int, seed: int) -> Column:
    """How many of the prefixes (of all, a half, a quarter ... of the rows, by hash) a row lies in, less one: 0 for half of the rows."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    return F.least(F.floor(-F.log2(u)), F.lit(prefixes - 1)).cast("int")


def _symmetric(tables: dict[int, np.ndarray], edges: list[list[float]], penalty: float) -> tuple[float, int, int] | None:
    """The one split of a level: the greatest gain summed over its nodes."""
    total = None
    for t in tables.values():
        gain = np.maximum(_gains(t, penalty, 0.0, 0), 0.0)
        total = gain if total is None else total + gain
    return _best(total, edges, np.ones(len(edges), bool)) if total is not None else None


def fit_ordered(train: DataFrame, key: str = "shot_id", group: str = "match_id", numeric=BASELINE, categorical=(), boolean=(), *, step: float = 0.05, depth: int = 3, penalty: float = 3.0, subsample: float = 0.8, most: int = MOST_TREES, patience: int = PATIENCE, bins: int = 64, seed: int = 42, allow_identifiers: bool = False) -> Fitted:
    """Ordered boosting with symmetric trees; features stay one column each, categories as ordered target statistics.

    Columns that say who shot are an error unless they are allowed.
    """
    columns = [*numeric, *categorical, *boolean]
    reject_leaky_features(columns)
    if len(set(columns)) != len(columns) or not columns:
        raise ValueError("feature columns must be given once each, and at least one")
    if not allow_identifiers and (bad := sorted(set(columns) & IDENTIFIERS)):
        raise ValueError(f"{', '.join(bad)}: identifiers say who, not how; they need allow_identifiers=True")
    split, inner, held = _inner_and_held(train, group, numeric, seed)
    n, hits = inner.agg(F.count("*"), F.sum("label")).first()
    prior, start = hits / n, math.log(hits / (n - hits))
    sql = [f"CAST(`{c}` AS DOUBLE) AS f{k}" for k, c in enumerate(numeric)]
    stages = []
    for c in categorical:
        rates = {str(r[c]): r["rate"] for r in category_rates(inner.where(F.col(c).isNotNull()), c, "label", prior).collect()}  # a row a level
        text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        found = f"map({', '.join(f'{text(x)}, {r!r}D' for x, r in sorted(rates.items()))})" if rates else "map('', 0.0D)"
        sql.append(f"coalesce(try_element_at({found}, CAST(`{c}` AS STRING)), {prior!r}D) AS f{len(sql)}")
    sql += [f"CAST(`{c}` AS DOUBLE) AS f{len(sql) + k}" for k, c in enumerate(boolean)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(sql)} FROM __THIS__")]
    # rows to fit on have each category's statistic from earlier rows only
    ordered = inner
    for j, c in enumerate(categorical):
        ordered = ordered_target_statistic(ordered, c, "label", key, prior, seed=seed).withColumnRenamed("target_statistic", f"_s{j}")
    f = [F.col(c).cast("double") for c in numeric] + [F.col(f"_s{j}") for j in range(len(categorical))] + [F.col(c).cast("double") for c in boolean]
    names = columns
    ordered = ordered.select("label", F.col(key).alias("key"), *[x.alias(f"f{k}") for k, x in enumerate(f)])
    prefixes = max(2, int(math.log2(n)))
    binned = _Binned([], names, _bin_edges(ordered, [f"f{k}" for k in range(len(names))], bins))
    rows = binned.rows(ordered, "key").withColumn("s", prefix_of(F.col("key"), prefixes - 1, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    watched = _Binned(stages, names, binned.edges).rows(held).persist(StorageLevel.MEMORY_AND_DISK)
    width = max(len(e) for e in binned.edges) + 1
    # m[j]: the score by the model of prefix j (0: all rows); a row has those of the prefixes it lies in and of the next, which it doesn't
    base = rows.withColumn("m", F.expr(f"array_repeat({start!r}D, s + 2)"))
    trees, gains, losses, best, values, done, kept = [], [], [], 0, [], 0, None
    while len(trees) < most and len(trees) - best < patience:
        turn, state = len(trees), base
        state = state.withColumn("m", F.expr(ordered_margins(trees[done:], values[done:])))
        if turn - done >= REFRESH:
            state = rows.withColumn("m", F.expr(f"array_repeat({start!r}D, s + 2)")).withColumn("m", F.expr(ordered_margins(trees, values))).persist(StorageLevel.MEMORY_AND_DISK)
            if kept is not None:
                kept.unpersist()
            base = kept = state
            done = turn
        drawn = state.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.col("key")), F.lit(1 << 20)) < int(subsample * (1 << 20)))
        tree, gain = Tree.empty(depth), np.zeros(len(names))
        for level in range(depth):
            tables = _tables(gradient_histogram(drawn, F.expr(node_sql(tree, level)), F.element_at("m", -1)), width, len(names))
            cut = _symmetric(tables, binned.edges, penalty)
            if cut is None:
                break
            gain[cut[1]] += cut[0]
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                tree.feature[node], tree.threshold[node] = cut[1], binned.edges[cut[1]][cut[2]]
        value = _leaf_values(drawn, tree, prefixes, step, penalty)
        tree.weight = value[0].tolist()
        trees.append(tree)
        values.append(value)
        gains.append(gain)
        losses.append(_loss(watched, score_sql(trees, start)))
        if losses[-1] < losses[best - 1] or best == 0:
            best = len(trees)
    for x in (split, rows, watched, *([kept] if kept is not None else [])):
        x.unpersist()
    return _fitted(stages, names, trees[:best], start, sum(gains[:best]), len(trees), most, losses)


def _leaf_values(rows: DataFrame, tree: Tree, prefixes: int, step: float, penalty: float) -> np.ndarray:
    """(prefix, leaf): steps from the rows of each prefix, by their scores in its own model; a row lies in two of them on average."""
    leaf = F.expr(f"{node_sql(tree, tree.depth)} - {2**tree.depth - 1}")
    each = rows.select("y", leaf.alias("leaf"), F.posexplode(F.expr("slice(m, 1, s + 1)")).alias("j", "m"))
    p = 1 / (1 + F.exp(-F.col("m")))
    out = np.zeros((prefixes + 1, 2**tree.depth))
    for r in each.groupBy("j", "leaf").agg(F.sum(p - F.col("y")).alias("g"), F.sum(p * (1 - p)).alias("h")).collect():  # prefixes x leaves at most
        out[r["j"], r["leaf"]] = -step * r["g"] / (r["h"] + penalty)
    return out


def ordered_margins(trees: list[Tree], values: list[np.ndarray]) -> str:
    """The expression of m after some trees: each prefix's score moves by its own value of the row's leaf."""
    if not trees:
        return "m"
    depth = trees[0].depth
    rows = ", ".join(f"named_struct('f', {_list(t.feature, 'int')}, 't', {_list(t.threshold, 'double')}, 'v', array({', '.join(_list(x, 'double') for x in v)}))" for t, v in zip(trees, values, strict=True))
    leaf = f"aggregate(sequence(1, {depth}), 0, (i, k) -> 2 * i + IF(x[t.f[i]] >= t.t[i], 2, 1)) - {2**depth - 1}"
    return f"aggregate(array({rows}), m, (a, t) -> transform(a, (z, j) -> z + t.v[j][{leaf}]))"


def importance(fitted: Fitted, spark) -> DataFrame:
    """(feature, gain, share): each feature's summed gain, largest first; shares are 0 where nothing was split."""
    total = sum(fitted.gains.values())
    rows = [(n, float(g), float(g / total) if total else 0.0) for n, g in fitted.gains.items()]
    return spark.createDataFrame(rows, "feature string, gain double, share double").orderBy(F.desc("gain"), "feature")


#: What ``models.persist_all_models`` fits: two regressions, and boosting by levels, by leaves of 30 rows or more, and ordered.
ALL_MODELS = {
    "logistic_baseline": lambda train, seed: fit_logistic(train),
    "logistic_contextual": lambda train, seed: fit_logistic(train, **CONTEXTUAL),
    "boosted_contextual": lambda train, seed: fit_histogram(train, **CONTEXTUAL, seed=seed),
    "boosted_leafwise_contextual": lambda train, seed: fit_histogram(train, **CONTEXTUAL, leaves=8, least_weight=1e-3, least_rows=30, seed=seed),
    "boosted_ordered_contextual": lambda train, seed: fit_ordered(train, **CONTEXTUAL, seed=seed),
}
