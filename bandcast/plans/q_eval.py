"""Registered queries: evaluation (E1-E15) and the cascade (C1-C5) over the
``predictions`` fixture (deterministic pseudo-scores), so every metric is
oracle-checked without training."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandcast.functions import scalars as S
from bandcast.operators import cascade as C
from bandcast.operators import evaluation as E
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.registry import register

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

SCORED_SQL = """
    SELECT *, CAST(CASE WHEN y_tp15 <> sb THEN 1 ELSE 0 END AS INTEGER) AS true_change,
              CAST(CASE WHEN y_tp15 < sb THEN 1 ELSE 0 END AS INTEGER) AS true_down,
              CAST(CASE WHEN gk_prob >= 0.25e0 THEN 1 ELSE 0 END AS INTEGER) AS gk_pred_25,
              CAST(CASE WHEN router_prob >= 0.5e0 THEN 1 ELSE 0 END AS INTEGER) AS router_pred,
              GREATEST(sb - y_tp15, 0) AS jam_mag,
              GREATEST(y_tp15 - sb, 0) AS rise_mag,
              CAST(CASE WHEN gk_prob >= 0.5e0 THEN l_suppkey % 8 ELSE sb - 1 END AS INTEGER) AS pred_class
    FROM predictions"""


def scored(spark, d):
    p = fx.predictions(spark, d)
    return p.withColumns({
        "true_change": S.flag(F.col("y_tp15") != F.col("sb")),
        "true_down": S.flag(F.col("y_tp15") < F.col("sb")),
        "gk_pred_25": S.flag(F.col("gk_prob") >= 0.25),
        "router_pred": S.flag(F.col("router_prob") >= 0.5),
        "jam_mag": C.true_magnitude(sign=-1),
        "rise_mag": C.true_magnitude(sign=+1),
        "pred_class": F.when(F.col("gk_prob") >= 0.5, F.col("l_suppkey") % 8)
                       .otherwise(F.col("sb") - 1).cast("int"),
    })


def _q(body, **extra):
    return with_views(body, "predictions", extra={"scored": SCORED_SQL, **extra})


def _r6(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


CONF_SQL = """CAST(SUM(CASE WHEN {y} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
              CAST(SUM(CASE WHEN {y} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
              CAST(SUM(CASE WHEN {y} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
              CAST(SUM(CASE WHEN {y} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn"""
RATES_SQL = """tp + fp + tn + fn AS rows,
    ROUND(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0e0 END, 6) AS accuracy,
    ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, 6) AS precision,
    ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END, 6) AS recall,
    ROUND(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END, 6) AS f1"""
RATE_COLS = ["accuracy", "precision", "recall", "f1"]


@register("gate_metrics", _q(f"""
    SELECT tp, fp, tn, fn, {RATES_SQL} FROM (SELECT {CONF_SQL.format(y='true_change', p='gk_pred_25')} FROM scored)"""))
def q_gate_metrics(spark, d):
    return _r6(E.binary_metrics(scored(spark, d), "true_change", "gk_pred_25"), RATE_COLS)


@register("threshold_sweep", _q(f"""
    SELECT threshold, tp, fp, tn, fn, {RATES_SQL} FROM (
        SELECT threshold, {CONF_SQL.format(y='true_change', p='CAST(gk_prob >= threshold AS INTEGER)')}
        FROM scored, (SELECT UNNEST([0.2e0, 0.25e0, 0.3e0, 0.35e0, 0.4e0, 0.45e0, 0.5e0]) AS threshold)
        GROUP BY threshold)"""))
def q_threshold_sweep(spark, d):
    return _r6(E.threshold_sweep(scored(spark, d), "true_change", "gk_prob"), RATE_COLS)


@register("constant_baseline", _q(f"""
    SELECT tp, fp, tn, fn, {RATES_SQL} FROM (SELECT {CONF_SQL.format(y='true_change', p='0')} FROM scored)"""))
def q_constant_baseline(spark, d):
    return _r6(E.constant_baseline(scored(spark, d), "true_change"), RATE_COLS)


SEG_SQL = """UNNEST(list_filter([CASE WHEN TRUE THEN 'all' END,
                                  CASE WHEN incident_nearby = 1 THEN 'incident' END,
                                  CASE WHEN true_change = 1 THEN 'changed' END,
                                  CASE WHEN incident_nearby = 1 AND true_change = 1 THEN 'incident_changed' END],
                                 lambda x: x IS NOT NULL))"""


@register("segment_metrics", _q(f"""
    SELECT segment, tp, fp, tn, fn, {RATES_SQL} FROM (
        SELECT segment, {CONF_SQL.format(y='true_change', p='gk_pred_25')}
        FROM (SELECT *, {SEG_SQL} AS segment FROM scored) GROUP BY segment)"""))
def q_segment_metrics(spark, d):
    s = scored(spark, d)
    segs = {"all": F.lit(True), "incident": F.col("incident_nearby") == 1, "changed": F.col("true_change") == 1,
            "incident_changed": (F.col("incident_nearby") == 1) & (F.col("true_change") == 1)}
    return _r6(E.by_segment(s, segs, E.binary_metrics, y="true_change", pred="gk_pred_25"), RATE_COLS)


ORD_SQL = """COUNT(*) AS rows, ROUND(AVG(CASE WHEN {y} = {p} THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
             ROUND(AVG(ABS({p} - {y})), 6) AS mae,
             ROUND(AVG(CASE WHEN ABS({p} - {y}) <= 1 THEN 1e0 ELSE 0e0 END), 6) AS within1,
             ROUND(COALESCE(AVG(CASE WHEN sb - 1 <> {y} THEN CASE WHEN {y} = {p} THEN 1e0 ELSE 0e0 END END), 0e0), 6) AS change_accuracy"""


@register("ablation_ordinal", _q(f"""
    SELECT 'model' AS config, {ORD_SQL.format(y='(y_tp15 - 1)', p='pred_class')} FROM scored
    UNION ALL
    SELECT 'persistence' AS config, {ORD_SQL.format(y='(y_tp15 - 1)', p='(sb - 1)')} FROM scored
    UNION ALL
    SELECT 'model_incident' AS config, {ORD_SQL.format(y='(y_tp15 - 1)', p='pred_class')} FROM scored WHERE incident_nearby = 1"""))
def q_ablation_ordinal(spark, d):
    """E5 + E4 ('same' persistence) + E15."""
    s = scored(spark, d).withColumns({"y_class": F.col("y_tp15") - 1, "base": E.persistence(None, "same")})
    runs = [("model", E.ordinal_metrics(s, "y_class", "pred_class", base="base")),
            ("persistence", E.ordinal_metrics(s, "y_class", "base", base="base")),
            ("model_incident", E.ordinal_metrics(s.filter(F.col("incident_nearby") == 1), "y_class", "pred_class",
                                                 base="base"))]
    return _r6(E.ablation_table(runs), ["accuracy", "mae", "within1", "change_accuracy"])


@register("magnitude_metrics", _q("""
    SELECT COUNT(*) AS rows, ROUND(AVG(ABS(pred_mag - jam_mag)), 6) AS mae,
           ROUND(SQRT(AVG(POW(pred_mag - jam_mag, 2))), 6) AS rmse,
           ROUND(AVG(CASE WHEN round_even(pred_mag, 0) = jam_mag THEN 1e0 ELSE 0e0 END), 6) AS exact,
           ROUND(AVG(CASE WHEN ABS(round_even(pred_mag, 0) - jam_mag) <= 1 THEN 1e0 ELSE 0e0 END), 6) AS within1
    FROM scored WHERE gk_pred_25 = 1 AND router_pred = 1"""))
def q_magnitude_metrics(spark, d):
    s = scored(spark, d).filter((F.col("gk_pred_25") == 1) & (F.col("router_pred") == 1))
    return _r6(E.magnitude_metrics(s, "jam_mag", "pred_mag"), ["mae", "rmse", "exact", "within1"])


@register("alert_report", _q("""
    SELECT tp, fp, events, base_fp, tp + fp AS alerts,
           ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, 6) AS precision,
           ROUND(CASE WHEN events > 0 THEN tp / events ELSE 0e0 END, 6) AS recall,
           base_fp - fp AS false_alarms_saved
    FROM (SELECT CAST(SUM(CASE WHEN pred_mag >= 0.75e0 AND jam_mag >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                 CAST(SUM(CASE WHEN pred_mag >= 0.75e0 AND jam_mag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                 CAST(SUM(CASE WHEN jam_mag >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS events,
                 CAST(SUM(CASE WHEN pred_mag >= 0.5e0 AND jam_mag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS base_fp
          FROM scored WHERE gk_pred_25 = 1 AND router_pred = 1)"""))
def q_alert_report(spark, d):
    s = scored(spark, d).filter((F.col("gk_pred_25") == 1) & (F.col("router_pred") == 1))
    return _r6(E.alert_report(s, "jam_mag", "pred_mag", 0.75, 0.5), ["precision", "recall"])


def _sev_sql(exclusive: bool):
    segs = ("[CASE WHEN jam_mag = 1 THEN '1' END, CASE WHEN jam_mag BETWEEN 2 AND 3 THEN '2-3' END, "
            "CASE WHEN jam_mag >= 4 THEN '4+' END]") if exclusive else \
           ("[CASE WHEN jam_mag >= 2 THEN '>=2' END, CASE WHEN jam_mag >= 3 THEN '>=3' END, "
            "CASE WHEN jam_mag >= 4 THEN '>=4' END]")
    return _q(f"""
    SELECT severity, COUNT(*) AS total, CAST(SUM(alert) AS BIGINT) AS caught,
           ROUND(CASE WHEN COUNT(*) > 0 THEN SUM(alert) / COUNT(*) ELSE 0e0 END, 6) AS recall
    FROM (SELECT CAST(CASE WHEN pred_mag >= 0.75e0 THEN 1 ELSE 0 END AS INTEGER) AS alert,
                 UNNEST(list_filter({segs}, lambda x: x IS NOT NULL)) AS severity FROM scored)
    GROUP BY severity""")


@register("severity_recall_exclusive", _sev_sql(True))
def q_severity_recall_exclusive(spark, d):
    s = scored(spark, d).withColumn("alert", S.flag(F.col("pred_mag") >= 0.75))
    return _r6(E.severity_recall(s, "jam_mag", "alert", exclusive=True), ["recall"])


@register("severity_recall_cumulative", _sev_sql(False))
def q_severity_recall_cumulative(spark, d):
    s = scored(spark, d).withColumn("alert", S.flag(F.col("pred_mag") >= 0.75))
    return _r6(E.severity_recall(s, "jam_mag", "alert", exclusive=False), ["recall"])


_BIN_SQL = """CASE WHEN pred_mag > -0.001e0 AND pred_mag <= 0.75e0 THEN 'Noise (Vetoed)'
                   WHEN pred_mag > 0.75e0 AND pred_mag <= 1.5e0 THEN 'Minor Jam (1-band)'
                   WHEN pred_mag > 1.5e0 AND pred_mag <= 3e0 THEN 'Significant Jam (2-3)'
                   WHEN pred_mag > 3e0 AND pred_mag <= 10e0 THEN 'Major Jam (4+)' END"""


@register("event_rate_by_bin", _q(f"""
    SELECT l.bin, COALESCE(a.total_pred, 0) AS total_pred, COALESCE(a.real_events, 0) AS real_events,
           ROUND(CASE WHEN COALESCE(a.total_pred, 0) > 0 THEN a.real_events / a.total_pred ELSE 0e0 END, 6) AS real_rate
    FROM (SELECT UNNEST(['Noise (Vetoed)', 'Minor Jam (1-band)', 'Significant Jam (2-3)', 'Major Jam (4+)', 'Off scale']) AS bin) l
    LEFT JOIN (SELECT {_BIN_SQL} AS bin, COUNT(*) AS total_pred,
                      CAST(SUM(CASE WHEN jam_mag > 0 THEN 1 ELSE 0 END) AS BIGINT) AS real_events
               FROM scored WHERE gk_pred_25 = 1 AND router_pred = 1 GROUP BY 1) a ON l.bin = a.bin"""))
def q_event_rate_by_bin(spark, d):
    s = scored(spark, d).filter((F.col("gk_pred_25") == 1) & (F.col("router_pred") == 1))
    s = s.withColumn("bin", S.cut_right("pred_mag", labels=S.JAM_LABELS))
    return _r6(E.event_rate_by_bin(s, "jam_mag", "bin", list(S.JAM_LABELS) + ["Off scale"]), ["real_rate"])


ROUTER_SQL = """SELECT *, CAST(CASE WHEN router_pred = true_down THEN 1 ELSE 0 END AS INTEGER) AS router_correct
                FROM scored WHERE gk_pred_25 = 1"""


def _router(spark, d):
    return scored(spark, d).filter(F.col("gk_pred_25") == 1) \
        .withColumn("router_correct", S.flag(F.col("router_pred") == F.col("true_down")))


@register("score_bands", _q("""
    SELECT CASE WHEN router_prob < 0.45e0 THEN 'LOW' WHEN router_prob <= 0.55e0 THEN 'MID' ELSE 'HIGH' END AS band,
           COUNT(*) AS rows, ROUND(AVG(router_correct), 6) AS accuracy, ROUND(AVG(true_change), 6) AS change_rate
    FROM routerset GROUP BY 1""", routerset=ROUTER_SQL))
def q_score_bands(spark, d):
    return _r6(E.score_bands(_router(spark, d)), ["accuracy", "change_rate"])


@register("margin_bands", _q("""
    SELECT CASE WHEN ABS(router_prob - 0.5e0) <= 0.05e0 THEN 'VERY_UNCERTAIN'
                WHEN ABS(router_prob - 0.5e0) <= 0.20e0 THEN 'MEDIUM' ELSE 'CONFIDENT' END AS band,
           COUNT(*) AS rows, ROUND(AVG(router_correct), 6) AS accuracy, ROUND(AVG(true_change), 6) AS change_rate
    FROM routerset GROUP BY 1""", routerset=ROUTER_SQL))
def q_margin_bands(spark, d):
    return _r6(E.margin_bands(_router(spark, d)), ["accuracy", "change_rate"])


@register("changed_only_metrics", _q("""
    SELECT ROUND((SELECT CASE WHEN COUNT(*) > 0 THEN AVG(CASE WHEN router_pred = true_down THEN 1e0 ELSE 0e0 END) ELSE 0e0 END
                  FROM routerset WHERE true_change = 1), 6) AS acc_changed,
           ROUND((SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END
                  FROM (SELECT SUM(CASE WHEN true_down = 1 AND router_pred = 1 THEN 1 ELSE 0 END) AS tp,
                               SUM(CASE WHEN true_down = 0 AND router_pred = 1 THEN 1 ELSE 0 END) AS fp,
                               SUM(CASE WHEN true_down = 1 AND router_pred = 0 THEN 1 ELSE 0 END) AS fn
                        FROM routerset WHERE true_change = 1)), 6) AS f1_changed,
           (SELECT COUNT(*) FROM routerset) AS passed_rows,
           ROUND((SELECT AVG(true_change) FROM routerset), 6) AS passed_change_rate,
           (SELECT CAST(SUM(CASE WHEN true_change = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM routerset) AS passed_false_positives,
           ROUND((SELECT AVG(gk_prob) FROM routerset), 6) AS avg_gate_prob""", routerset=ROUTER_SQL))
def q_changed_only_metrics(spark, d):
    return _r6(E.changed_only_metrics(_router(spark, d)),
               ["acc_changed", "f1_changed", "passed_change_rate", "avg_gate_prob"])


# Cascade ------------------------------------------------------------------------
CASCADE_SQL = """
    SELECT *, CASE WHEN gk_pred_25 = 1 AND router_pred = 1 THEN 'descent'
                   WHEN gk_pred_25 = 1 THEN 'ascent' ELSE 'none' END AS route,
              CASE WHEN gk_pred_25 = 1 AND router_pred = 1 THEN GREATEST(pred_mag, 0e0)
                   WHEN gk_pred_25 = 1 THEN GREATEST(pred_mag * 0.5e0 - 0.1e0, 0e0) ELSE 0e0 END AS cmag
    FROM scored"""


def cascade(spark, d):
    """C1 + C2 with pseudo-models: the descent scorer reads the fixture's
    magnitude, the ascent scorer a shrunk copy of it."""
    s = scored(spark, d).withColumn("route", C.route()).withColumnRenamed("pred_mag", "raw_mag")
    scorers = {"descent": lambda x: x.withColumn("score", F.col("raw_mag")),
               "ascent": lambda x: x.withColumn("score", F.col("raw_mag") * 0.5 - 0.1)}
    return C.score_routed(s, scorers)


@register("cascade_routes", _q("""
    SELECT route, COUNT(*) AS rows, CAST(SUM(CASE WHEN cmag >= 0.75e0 THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
           ROUND(SUM(cmag), 6) AS total_mag
    FROM cascaded GROUP BY route""", cascaded=CASCADE_SQL))
def q_cascade_routes(spark, d):
    c = cascade(spark, d)
    return c.groupBy("route").agg(F.count(F.lit(1)).alias("rows"),
                                  F.sum("strict_alert").cast("bigint").alias("alerts"),
                                  F.round(F.sum("pred_mag"), 6).alias("total_mag"))


def _funnel_sql(mag, route):
    return _q(f"""
    SELECT severity, COUNT(*) AS total,
           CAST(SUM(gk_pred_25) AS BIGINT) AS gate_caught,
           CAST(SUM(CASE WHEN route = '{route}' THEN 1 ELSE 0 END) AS BIGINT) AS routed_caught,
           CAST(SUM(CASE WHEN route = '{route}' AND cmag >= 0.75e0 THEN 1 ELSE 0 END) AS BIGINT) AS final_caught,
           ROUND(SUM(gk_pred_25) / COUNT(*), 6) AS gate_recall,
           ROUND(SUM(CASE WHEN route = '{route}' THEN 1 ELSE 0 END) / COUNT(*), 6) AS routed_recall,
           ROUND(SUM(CASE WHEN route = '{route}' AND cmag >= 0.75e0 THEN 1 ELSE 0 END) / COUNT(*), 6) AS final_recall
    FROM (SELECT *, UNNEST(list_filter([CASE WHEN {mag} >= 2 THEN '>=2' END, CASE WHEN {mag} >= 3 THEN '>=3' END,
                                        CASE WHEN {mag} >= 4 THEN '>=4' END], lambda x: x IS NOT NULL)) AS severity
          FROM cascaded)
    GROUP BY severity""", cascaded=CASCADE_SQL)


def _funnel(spark, d, mag, route):
    c = cascade(spark, d).withColumns({
        "routed": S.flag(F.col("route") == route),
        "final": S.flag((F.col("route") == route) & (F.col("strict_alert") == 1))})
    return _r6(C.funnel(c, mag, routed="routed", alert="final"), ["gate_recall", "routed_recall", "final_recall"])


@register("cascade_funnel_descent", _funnel_sql("jam_mag", "descent"))
def q_cascade_funnel_descent(spark, d):
    return _funnel(spark, d, "jam_mag", "descent")


@register("cascade_funnel_ascent", _funnel_sql("rise_mag", "ascent"))
def q_cascade_funnel_ascent(spark, d):
    return _funnel(spark, d, "rise_mag", "ascent")


@register("largest_drops", _q("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sb, cmag AS pred_mag,
           CAST(round_even(sb - cmag, 0) AS INTEGER) AS projected_sb
    FROM cascaded WHERE router_pred = 1 AND cmag >= 2e0
    ORDER BY cmag DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""", cascaded=CASCADE_SQL))
def q_largest_drops(spark, d):
    c = cascade(spark, d).filter(F.col("router_pred") == 1)
    return C.largest_moves(c, "pred_mag", -1, 5, 2.0, KEYS).select(*KEYS, "sb", "pred_mag", "projected_sb")


@register("largest_jams_floor", _q("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sb, cmag AS pred_mag,
           GREATEST(1, CAST(round_even(sb - cmag, 0) AS INTEGER)) AS projected_sb
    FROM cascaded WHERE router_pred = 1
    ORDER BY cmag DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 3""", cascaded=CASCADE_SQL))
def q_largest_jams_floor(spark, d):
    c = cascade(spark, d).filter(F.col("router_pred") == 1)
    return C.largest_moves(c, "pred_mag", -1, 3, None, KEYS, floor=1).select(*KEYS, "sb", "pred_mag", "projected_sb")


@register("largest_rises", _q("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sb, cmag AS pred_mag,
           CAST(round_even(sb + cmag, 0) AS INTEGER) AS projected_sb
    FROM cascaded WHERE router_pred = 0 AND cmag >= 2e0
    ORDER BY cmag DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""", cascaded=CASCADE_SQL))
def q_largest_rises(spark, d):
    c = cascade(spark, d).filter(F.col("router_pred") == 0)
    return C.largest_moves(c, "pred_mag", +1, 5, 2.0, KEYS).select(*KEYS, "sb", "pred_mag", "projected_sb")
