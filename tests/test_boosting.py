"""Boosted trees: a plain Python twin, missing values, tasks, restarts, saved models."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandcast.operators import boosting as B
from bandcast.operators import training as M


def twin(p, bins, y, w, key, base, scale, n_bins):
    """The same boosting by loops over rows, nodes, features and bins: [{slot: (feature, bin, missing left)}], margins."""
    n = len(y)
    margin = [[b] * n for b in base]
    splits = []
    limit = min(int(p.row_share * 2.0 ** 64), (1 << 64) - 1)
    for r in range(p.rounds):
        sampled = B.mix(key, p.seed * 1_000_003 + r) <= np.uint64(limit)
        g, h = B.gradients(p, y, w, np.array(margin))
        for k in range(len(base)):
            gk, hk = [round(float(v) * scale) for v in g[k]], [round(float(v) * scale) for v in h[k]]
            columns = [int(c) for c in B.columns_of_tree(p, bins.shape[1], r, k)]
            tree, value, level = {}, {}, {0: list(range(n))}
            for depth in range(p.depth + 1):
                below = {}
                for slot, rows in level.items():
                    mine = [i for i in rows if sampled[i]]
                    tg, th = sum(gk[i] for i in mine) / scale, sum(hk[i] for i in mine) / scale
                    value[slot] = (-B.rate_of(p, r) * tg / (th + p.l2), rows)
                    if depth == p.depth or (slot and th < 2 * p.min_child_weight):
                        continue
                    best = None
                    for f in columns:
                        for b in range(1, n_bins):
                            for missing in (False, True):
                                left = [i for i in mine if (missing if bins[i, f] == 0 else bins[i, f] <= b)]
                                lg, lh = sum(gk[i] for i in left) / scale, sum(hk[i] for i in left) / scale
                                rg, rh = tg - lg, th - lh
                                if lh >= p.min_child_weight and rh >= p.min_child_weight:
                                    gain = 0.5 * (lg * lg / (lh + p.l2) + rg * rg / (rh + p.l2) - tg * tg / (th + p.l2))
                                    if best is None or gain > best[0]:
                                        best = (gain, f, b, missing)
                    if best and best[0] > B.EPSILON:
                        _, f, b, missing = best
                        tree[slot] = (f, b, missing)
                        del value[slot]
                        for i in rows:
                            left = missing if bins[i, f] == 0 else bins[i, f] <= b
                            below.setdefault(2 * slot + (1 if left else 2), []).append(i)
                level = below
            splits.append(tree)
            for v, rows in value.values():
                for i in rows:
                    margin[k][i] += v
    return splits, margin


@pytest.mark.parametrize("objective,classes", [("logistic", 1), ("squared", 1), ("softmax", 3)])
def test_trees_equal_a_plain_twin(objective, classes):
    rnd = np.random.default_rng(4)
    n, n_bins = 120, 7
    bins = rnd.integers(0, n_bins, (n, 4)).astype(np.uint8)
    y = {"logistic": (bins[:, 0] > 3) ^ (rnd.random(n) < 0.2), "squared": bins[:, 1] * 0.5 + (bins[:, 2] == 0),
         "softmax": (bins[:, 0] + bins[:, 3]) % 3}[objective].astype(float)
    w = rnd.choice([1.0, 5.0, 0.5], n)
    key = rnd.integers(0, 2 ** 63, n).astype(np.uint64)
    p = B.Params(objective, rounds=4, depth=3, rate=0.3, min_child_weight=2.0, classes=classes)
    base = np.full(classes, 0.1)
    trees = B.boost(p, 0, p.rounds, B.Trees.empty(0, p.depth), base, bins, n_bins, y, w, key, 2.0 ** 30, lambda a: a)
    splits, margin = twin(p, bins, y, w, key, base, 2.0 ** 30, n_bins)
    got = [{s: (int(trees.feature[t, s]), int(trees.bin[t, s]), bool(trees.missing_left[t, s])) for s in np.flatnonzero(trees.feature[t] >= 0)}
           for t in range(len(trees))]
    assert got == splits and any(len(s) > 2 for s in splits)
    model = B.BoostedModel(p, list("abcd"), [], list(base), trees)
    model.bins = lambda columns: bins
    assert np.allclose(model.margins([]), margin)


def frame(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.random(), rnd.choice([None, 0.0, 1.0, 2.0])
        rows.append((i, a, b, float(rnd.randrange(3)), float((a > 0.5) != (b is None))))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label double")


def same(x: B.BoostedModel, y: B.BoostedModel) -> bool:
    return x.edges == y.edges and x.base == y.base and all((a == b).all() for a, b in zip(x.trees.arrays(), y.trees.arrays()))


def test_missing_values_are_routed(spark):
    df = frame(spark)
    m = M.fit_classifier(df, ["a", "b", "c"], maxIter=20, maxDepth=3)
    got = M.score(m, df, "prob").withColumn("hit", ((F.col("score") > 0.5) == (F.col("label") == 1)).cast("int"))
    assert got.agg(F.avg("hit")).first()[0] > 0.97
    nan = df.withColumn("b", F.coalesce("b", F.lit(float("nan"))))
    assert same(m, M.fit_classifier(nan, ["a", "b", "c"], maxIter=20, maxDepth=3))


def test_trees_do_not_depend_on_tasks_order_or_jobs(spark):
    df = frame(spark, 200)
    p = B.Params(rounds=2, depth=2)
    one = B.train(df, ["a", "b", "c"], "label", None, p)
    assert same(one, B.train(df.orderBy(F.desc("a")), ["a", "b", "c"], "label", None, p, rounds_per_job=1))
    assert same(one, B.train(df, ["a", "b", "c"], "label", None, p, tasks=3))


def test_weights_empty_input_and_constant_labels(spark):
    df = frame(spark, 60)
    none = B.train(df.limit(0), ["a"], "label", None, B.Params(rounds=3))
    assert len(none.trees) == 0 and none.base == [0.0]
    assert {r.score for r in M.score(none, df, "prob").collect()} == {0.5}
    flat = B.train(df.withColumn("label", F.lit(2.0)), ["a", "b"], "label", None, B.Params("squared", rounds=3, depth=2))
    assert {round(r.score, 9) for r in M.score(flat, df, "value").collect()} == {2.0}
    weighted = df.withColumn("w", F.when(F.col("label") == 1, 3.0).otherwise(None))
    only = B.train(weighted, ["a"], "label", "w", B.Params(rounds=2, depth=2))
    assert M.score(only, df, "prob").agg(F.min("score")).first()[0] > 0.99
    unlabelled = df.unionByName(df.withColumn("label", F.lit(None).cast("double")))
    assert same(B.train(df, ["a"], "label", None, B.Params(rounds=2, depth=2)), B.train(unlabelled, ["a"], "label", None, B.Params(rounds=2, depth=2)))


def test_saved_models_importance_and_classes(spark, tmp_path):
    df = frame(spark)
    m = M.fit_multiclass(df.withColumn("y", (F.col("c") + F.col("label")) % 3), ["a", "b", "c"], "y", numTrees=40, maxDepth=5, stepSize=0.3, minChildWeight=1.0)
    s = M.score(m, df, "class").withColumn("hit", (F.col("score") == (F.col("c") + F.col("label")) % 3).cast("int"))
    assert s.agg(F.avg("hit")).first()[0] > 0.9
    M.save(m, str(tmp_path / "model"))
    assert same(m, M.load(str(tmp_path / "model")))
    r = M.fit_regressor(df, ["a", "b", "c"], maxIter=10, maxDepth=3)
    shares = {x.feature: x.importance for x in M.importance(spark, r, ["a", "b", "c"], 3).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["c"] < shares["a"]


def test_cascade_in_one_pass_equals_stage_by_stage(spark):
    df = frame(spark)
    models = [M.fit_classifier(df, ["a", "b"], maxIter=3, maxDepth=2), M.fit_classifier(df, ["a", "c"], maxIter=3, maxDepth=2),
              M.fit_regressor(df, ["c", "b"], maxIter=3, maxDepth=2), M.fit_regressor(df, ["a"], maxIter=3, maxDepth=2)]
    got = df.withColumn("s", B.cascade_column(spark, *models, gate_threshold=0.45))
    assert str(got._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
    got = got.select("id", "s.*").toPandas().sort_values("id").reset_index(drop=True)
    each = [M.score(m, df, k).toPandas().sort_values("id")["score"].to_numpy() for m, k in zip(models, ("prob", "prob", "value", "value"))]
    want = np.where(each[0] < 0.45, 0.0, np.where(each[1] >= 0.5, each[2], each[3]))
    pd.testing.assert_frame_equal(got[["gate", "router", "magnitude"]], pd.DataFrame({"gate": each[0], "router": each[1], "magnitude": want}))
