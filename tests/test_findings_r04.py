"""Training: columns counted together, no exchange where one task holds the rows, independent models at the same time."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandcast.operators import boosting as B
from bandcast.operators import training as M
from bandcast.plans import q_ml


def test_columns_counted_together_equal_columns_counted_alone():
    rnd = np.random.default_rng(5)
    sizes, n, nodes = np.array([3, 10, 256, 2, 17, 4]), 20_000, 5
    bins = np.asfortranarray(np.stack([rnd.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8))
    columns, node = np.array([0, 1, 2, 4, 5]), rnd.integers(0, nodes, n)
    values = [np.rint(rnd.normal(size=n) * 2 ** 30), np.rint(rnd.random(n) * 2 ** 30)]
    counter = B.Counter(bins, columns, sizes)
    assert max(map(len, counter.bundles)) > 1
    got = counter.empty(2, nodes)
    rows = np.arange(n)
    for part in (rows[:7000], rows[7000:]):
        counter.add(got, part, node[part], [v[part] for v in values])
    got = counter.by_column(got, nodes)
    for j, f in enumerate(columns):
        for k, v in enumerate(values):
            want = np.bincount(node * sizes[f] + bins[:, f], v, nodes * sizes[f]).reshape(nodes, sizes[f])
            assert (got[k, :, counter.starts[j]:counter.starts[j + 1]] == want).all()


def test_leaves_equal_a_walk_row_by_row():
    rnd = np.random.default_rng(6)
    bins = rnd.integers(0, 256, (3000, 4)).astype(np.uint8)
    y, w, key = (bins[:, 0] > 90) * 1.0, np.ones(3000), rnd.integers(0, 2 ** 63, 3000).astype(np.uint64)
    t = B.boost(B.Params(rounds=3, depth=4), 0, 3, B.Trees.empty(0, 4), np.zeros(1), bins, 256, y, w, key, 2.0 ** 30, lambda a: a)

    def walk(tree, row):
        s = 0
        while s < t.feature.shape[1] and t.feature[tree, s] >= 0:
            b = row[t.feature[tree, s]]
            s = 2 * s + (1 if (t.missing_left[tree, s] if b == 0 else b <= t.bin[tree, s]) else 2)
        return s
    for tree in range(3):
        assert t.leaf(tree, bins).tolist() == [walk(tree, row) for row in bins]


def test_rows_that_fit_one_task_are_not_shared_out(spark, monkeypatch):
    seen, job = [], B._job
    monkeypatch.setattr(B, "_job", lambda *a: seen.append(a[-1]) or job(*a))
    df = spark.range(1_100_000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label"))
    B.train(df, ["a"], "label", None, B.Params(rounds=1, depth=1))
    B.train(df.limit(1000), ["a"], "label", None, B.Params(rounds=1, depth=1), rows_per_task=600)
    assert seen == [1, 2]


def test_models_of_a_query_are_trained_at_the_same_time(spark, monkeypatch):
    class Trained(Exception):
        pass

    for query, n in ((q_ml.q_train_router, 2), (q_ml.cascade_frame, 4)):
        together = threading.Barrier(n, timeout=60)

        def fit(df, features, label_col="label", **kw):
            together.wait()         # broken unless all are here at once
            raise Trained
        for name in ("fit_classifier", "fit_regressor"):
            monkeypatch.setattr(M, name, fit)
        frame = spark.range(10).selectExpr("id AS link_id", "id AS snapshot_ts", "4 AS sb", "4 AS y_tp15", "1 AS incident_nearby")
        monkeypatch.setattr(q_ml, "split", lambda s, d: (frame, frame, ["sb"]))
        with pytest.raises(Trained):
            query(spark, "")
