"""Registered training queries train on all rows they are meant for, with the reference's rounds and depth."""

import pytest

from bandcast import jobs
from bandcast.operators import training as M
from bandcast.plans import q_ml
from tests.conftest import SF001


class Trained(Exception):
    pass


@pytest.fixture
def fits(monkeypatch):
    seen = []

    def fit(df, features, label_col="label", **kw):
        seen.append((df, kw))
        raise Trained
    for name in ("fit_classifier", "fit_regressor", "fit_multiclass"):
        monkeypatch.setattr(M, name, fit)
    return seen


def test_specialists_train_on_every_row_of_their_classes(spark, fits):
    train = spark.range(6000).selectExpr("id AS link_id", "id AS snapshot_ts", "4 AS sb", "cast(3 + id % 3 AS int) AS y_tp15")
    for direction in ("descent", "ascent"):
        with pytest.raises(Trained):
            q_ml._specialist(train, ["sb"], direction)
        df, kw = fits[-1]
        assert df.count() == 4000 and not kw


def test_reference_rounds_and_depth(spark, fits, monkeypatch):
    assert all((p["maxIter"], p["maxDepth"]) == (465, 8) for p in (M.GATE_PARAMS, M.SPECIALIST_PARAMS))
    frame = spark.range(10).selectExpr("id AS link_id", "id AS snapshot_ts", "4 AS sb", "4 AS y_tp15", "1 AS incident_nearby")
    monkeypatch.setattr(q_ml, "split", lambda s, d: (frame, frame, ["sb"]))
    for query in (q_ml.q_train_gatekeeper, q_ml.q_train_router, q_ml.q_feature_importance, q_ml.q_model_save_load,
                  q_ml.q_train_cascade_funnel, q_ml.q_train_specialist_reports):
        with pytest.raises(Trained):
            query(spark, SF001)
        assert not {"maxIter", "maxDepth"} & set(fits[-1][1])
    with pytest.raises(Trained):
        q_ml.q_train_multiclass(spark, SF001)
    assert (fits[-1][1]["numTrees"], fits[-1][1]["maxDepth"]) == (465, 8)
    monkeypatch.setattr(jobs, "run_all", lambda *a, **kw: fits.append((None, kw)) or {"cascade_reports": None})
    q_ml.q_reference_chain(spark, SF001)
    kw = fits[-1][1]
    assert not {"maxIter", "maxDepth"} & set(kw) and kw["sample_frac"] == 1.0
