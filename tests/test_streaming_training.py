"""T3 equals W5 on in-order input; training is deterministic and learns a
signal; the cascade funnel never increases."""

import random

import pandas as pd
from pyspark.sql import functions as F

from bandcast.operators import cascade as C
from bandcast.operators import evaluation as E
from bandcast.operators import training as M
from bandcast.operators.lifecycle import incident_lifecycles
from bandcast.plans import fixtures as fx
from bandcast.plans.q_streaming import run_stream_lifecycles
from tests.conftest import SF001


def test_stream_lifecycles_equal_batch(spark):
    snaps = fx.incident_snapshots(spark, SF001)
    cols = ["incident_id", "type", "start_ts", "end_ts", "sightings", "message"]
    batch = sorted(tuple(r) for r in incident_lifecycles(snaps).select(*cols).collect())
    stream = sorted(tuple(r) for r in run_stream_lifecycles(spark, snaps, "t3_test").select(*cols).collect())
    assert stream == batch


def _signal_frame(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = rnd.random()
        rows.append((i, x, rnd.random(), 1.0 if x + rnd.random() * 0.3 > 0.8 else 0.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "x", "noise", "label"]))


def test_classifier_learns_and_is_deterministic(spark):
    df = _signal_frame(spark)
    train, test = df.filter(F.col("id") < 2000), df.filter(F.col("id") >= 2000)
    m1 = M.fit_classifier(train, ["x", "noise"], "label", maxIter=10, maxDepth=3)
    m2 = M.fit_classifier(train, ["x", "noise"], "label", maxIter=10, maxDepth=3)
    s1 = M.score(m1, test, "prob").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    s2 = M.score(m2, test, "prob")
    assert sorted(map(tuple, s1.select("id", "score").collect())) == sorted(map(tuple, s2.select("id", "score").collect()))
    model = E.binary_metrics(s1, "label", "pred").first().accuracy
    base = E.constant_baseline(s1, "label").first().accuracy
    assert model > base + 0.1


def test_regressor_and_importance(spark):
    df = _signal_frame(spark).withColumn("mag", F.col("x") * 4)
    m = M.fit_regressor(df, ["x", "noise"], "mag", maxIter=10, maxDepth=3)
    s = M.score(m, df, "value")
    assert E.magnitude_metrics(s, "mag", "score").first().mae < 0.3
    imp = M.importance(spark, m, ["x", "noise"], 2).collect()
    assert imp[0].feature == "x"


def test_funnel_is_non_increasing(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(1, 9), rnd.randrange(1, 9), rnd.randrange(2), rnd.randrange(2), rnd.random() * 4)
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "sb int, y_tp15 int, gk_pred_25 int, router_pred int, raw double")
    df = df.withColumn("route", C.route())
    out = C.score_routed(df, {"descent": lambda x: x.withColumn("score", F.col("raw"))})
    out = out.withColumns({"jam": C.true_magnitude(sign=-1), "routed": (F.col("route") == "descent").cast("int"),
                           "final": ((F.col("route") == "descent") & (F.col("strict_alert") == 1)).cast("int")})
    for r in C.funnel(out, "jam", routed="routed", alert="final").collect():
        assert r.total >= r.gate_caught >= r.routed_caught >= r.final_caught
    assert out.count() == 2000
