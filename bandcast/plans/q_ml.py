"""Registered queries: the training side (M1-M14) end to end on the fixture
feature table — master features (features + incident buckets + as-of
rain), chronological split, sampling, the three cascade stages, the
8-class alternative, importances, save/load — evaluated with E and C.

Rows-only checks (model outputs have no SQL oracle); the trees' plain twin and
"beats the constant baseline" are asserted in ``tests/``.  The label, gate and
router tables over pseudo-scores have oracles (``label_table``, ``gate_table``,
``router_table``).  Models have the reference's rounds and depth (465 x 8, the
defaults of the trainers); the specialists train on every row that moved their
way and every stable row.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from bandcast.functions.scalars import flag, require_columns
from bandcast.operators import cascade as C
from bandcast.operators import evaluation as E
from bandcast.operators import training as M
from bandcast.operators.features import FEATURES, MULTICLASS_FEATURES, model_frame
from bandcast.operators.filters import row_class, split_side
from bandcast.operators.joins import broadcast_if_small
from bandcast.operators.sampling import chrono_split, keep_or_sample
from bandcast.operators.temporal import asof_join
from bandcast.plans import fixtures as fx
from bandcast.plans.q_features import buckets_df, features_df
from bandcast.plans.q_spatial import rain_readings, station_mapping
from bandcast.plans.registry import register
from bandcast.session import checkpoint_dir, cut_lineage

KEYS = ["link_id", "snapshot_ts"]


def master_frame(spark, d):
    """Features + roads + incident buckets + rain (as-of, 30 min tolerance)."""
    m = model_frame(features_df(spark, d), fx.links(spark, d), buckets_df(spark, d))
    mapping = station_mapping(spark, d).select("link_id", F.col("nearest_station_id").alias("station_id"))
    m = m.join(broadcast_if_small(mapping), "link_id", "left")
    m = asof_join(m, rain_readings(spark, d), "station_id", "snapshot_ts", "reading_ts", ["value_mm"],
                  tolerance=1800)
    m = m.withColumnRenamed("value_mm", "rain_mm").withColumn("is_raining", flag(F.col("rain_mm") > 0))
    return m.drop("station_id", "reading_ts_matched")


def split(spark, d):
    m = master_frame(spark, d)
    require_columns(m, FEATURES, strict=True)          # P27: fail before any action
    m = cut_lineage(m)                                 # nulls stay: the trees route missing values
    t = chrono_split(m)
    return split_side(m, t, "train"), split_side(m, t, "test"), list(FEATURES)


def _fit_gate(train, feats):
    return M.fit_classifier(M.label(keep_or_sample(train, F.col("incident_nearby") == 1, KEYS, 0.5), "change"), feats, "label")


def _fit_router(train, feats):
    return M.fit_classifier(M.label(row_class(train, "change"), "direction"), feats, "label")


def _gate(train, test, feats):
    model = _fit_gate(train, feats)
    return model, M.gate_table(M.score(model, test, "prob"))


@register("train_gatekeeper")
def q_train_gatekeeper(spark, d):
    """M1, M6, M7, M10, M13 -> E2 sweep, E1 at 0.25, E3, E4, E7 segments."""
    train, test, feats = split(spark, d)
    _, g = _gate(train, test, feats)
    g = g.withColumn("persist", E.persistence(g, "changed"))
    sweep = E.threshold_sweep(g, "true_change", "gk_prob").withColumn("report", F.lit("sweep"))
    base = E.constant_baseline(g, "true_change").withColumn("report", F.lit("always_no_change"))
    pers = E.binary_metrics(g, "true_change", "persist").withColumn("report", F.lit("persistence"))
    segs = E.by_segment(g, {"incident": F.col("incident_nearby") == 1, "changed": F.col("true_change") == 1},
                        E.binary_metrics, y="true_change", pred="gk_pred_25") \
        .withColumn("report", F.concat(F.lit("segment:"), F.col("segment"))).drop("segment")
    return E.ablation_table([("gatekeeper", sweep), ("gatekeeper", base), ("gatekeeper", pers),
                             ("gatekeeper", segs)])


@register("train_router")
def q_train_router(spark, d):
    """M2, M14 -> E14 changed-only metrics, E12 score bands, E13 margin bands."""
    train, test, feats = split(spark, d)
    gate, router = M.fit_together(lambda: _fit_gate(train, feats), lambda: _fit_router(train, feats))
    passed = M.gate_table(M.score(gate, test, "prob")).filter(F.col("gk_pred_25") == 1)
    r = M.router_table(M.score(router, passed, "prob"))
    co = E.changed_only_metrics(r).select(F.lit("changed_only").alias("band"), F.col("passed_rows").alias("rows"),
                                          F.col("acc_changed").alias("accuracy"),
                                          F.col("passed_change_rate").alias("change_rate"))
    return co.unionByName(E.score_bands(r)).unionByName(E.margin_bands(r))


def _specialist(train, feats, direction):
    kind, cls = ("drop", "fall") if direction == "descent" else ("rise", "rise")
    both = row_class(train, cls).unionByName(row_class(train, "stable"))
    return M.fit_regressor(M.label(both, kind), feats, "label")


def cascade_frame(spark, d):
    """The test rows scored by all stages in one pass."""
    train, test, feats = split(spark, d)
    gate, router, desc, asc = M.fit_together(
        lambda: _fit_gate(train, feats), lambda: _fit_router(train, feats),
        lambda: _specialist(train, feats, "descent"), lambda: _specialist(train, feats, "ascent"))
    return C.apply_cascade(test, gate, router, desc, asc)


@register("train_cascade_funnel")
def q_train_cascade_funnel(spark, d):
    """Stage funnel per direction with trained models."""
    c = cut_lineage(cascade_frame(spark, d))
    out = []
    for direction, mag in (("descent", "jam_mag"), ("ascent", "rise_mag")):
        x = c.withColumns({"routed": flag(F.col("route") == direction),
                           "final": flag((F.col("route") == direction) & (F.col("strict_alert") == 1))})
        out.append(C.funnel(x, mag, routed="routed", alert="final").withColumn("direction", F.lit(direction)))
    return out[0].unionByName(out[1])


@register("train_specialist_reports")
def q_train_specialist_reports(spark, d):
    """E6, E8, E9, E10, E11 on the descent specialist's routed rows."""
    c = cut_lineage(cascade_frame(spark, d).filter(F.col("route") == "descent"))
    from bandcast.functions.scalars import JAM_LABELS, cut_right
    mag = E.magnitude_metrics(c, "jam_mag", "pred_mag").withColumn("report", F.lit("magnitude"))
    alert = E.alert_report(c, "jam_mag", "pred_mag").withColumn("report", F.lit("alerts"))
    ex = E.severity_recall(c, "jam_mag", "strict_alert", True).withColumn("report", F.lit("severity_exclusive"))
    cu = E.severity_recall(c, "jam_mag", "strict_alert", False).withColumn("report", F.lit("severity_cumulative"))
    bins = E.event_rate_by_bin(c.withColumn("bin", cut_right("pred_mag", labels=JAM_LABELS)), "jam_mag", "bin",
                               list(JAM_LABELS)).withColumn("report", F.lit("event_rate_by_bin"))
    return E.ablation_table([("descent", mag), ("descent", alert), ("descent", ex), ("descent", cu),
                             ("descent", bins)])


@register("train_multiclass_ablation")
def q_train_multiclass(spark, d):
    """M4, M5, M9: 8-class forest with incident weight 5 -> E5 vs the
    same-band persistence (E4) -> E15 table, plus the incident segment (E7)."""
    train, test, feats = split(spark, d)
    mc = [c for c in MULTICLASS_FEATURES]
    tr = M.incident_weight(M.label(train, "class"), 5.0)
    model = M.fit_multiclass(tr, mc, "label", weight="weight", numTrees=465, maxDepth=8)
    s = M.score(model, test, "class").withColumns({
        "y_class": F.col("y_tp15") - 1, "base": E.persistence(test, "same"), "pred": F.col("score").cast("int")})
    runs = [("model", E.ordinal_metrics(s, "y_class", "pred", base="base")),
            ("persistence", E.ordinal_metrics(s, "y_class", "base", base="base")),
            ("model_incident", E.ordinal_metrics(s.filter(F.col("incident_nearby") == 1), "y_class", "pred",
                                                 base="base"))]
    return E.ablation_table(runs)


@register("feature_importance")
def q_feature_importance(spark, d):
    """Top-15 importances of the gatekeeper."""
    train, test, feats = split(spark, d)
    model, _ = _gate(train, test, feats)
    return M.importance(spark, model, feats, 15)


@register("model_save_load")
def q_model_save_load(spark, d):
    """A saved and reloaded gatekeeper scores the test rows identically."""
    train, test, feats = split(spark, d)
    model, _ = _gate(train, test, feats)
    path = os.path.join(checkpoint_dir(spark), "models", f"gatekeeper-{uuid.uuid4().hex[:8]}")
    M.save(model, path)
    a = M.score(model, test, "prob", out="p_saved")
    b = M.score(M.load(path), test, "prob", out="p_loaded").select(*KEYS, "p_loaded")
    j = a.select(*KEYS, "p_saved").join(b, KEYS)
    return j.agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(flag(F.abs(F.col("p_saved") - F.col("p_loaded")) < 1e-12)).cast("bigint").alias("identical"),
                 F.avg("p_loaded").alias("mean_prob"))


@register("reference_chain_cascade_report")
def q_reference_chain(spark, d):
    """Every artifact of the reference's script chain built by ``bandcast.jobs``
    from the traffic-shaped tables, each written and re-read, ending in the
    cascade funnel report (rows-only)."""
    from bandcast import jobs
    out = os.path.join(checkpoint_dir(spark), "chain", uuid.uuid4().hex[:8])
    res = jobs.run_all(spark, fx.traffic_tables(spark, d), out, start_ts=1704067200, days=21,
                       sample_frac=1.0)
    return res["cascade_reports"]
