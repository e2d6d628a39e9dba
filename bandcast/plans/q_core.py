"""Registered queries: the flagship slice, scalar functions (P), filters (F),
aggregations (A) and row-offset windows (W1-W4) over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandcast.functions import scalars as S
from bandcast.functions.geo import angular_to_m, haversine_m
from bandcast.operators import aggregates as A
from bandcast.operators import filters as FL
from bandcast.operators.features import traffic_windows
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.registry import register

# DuckDB text shared by several oracles --------------------------------------
HOUR_SQL = "CAST(((snapshot_ts + 28800) // 3600) % 24 AS INTEGER)"
DOW_SQL = "CAST(((snapshot_ts + 28800) // 86400 + 4) % 7 AS INTEGER)"
TRAFFIC_SQL = f"""
    SELECT link_id, snapshot_ts, speed_band AS sb,
           LAG(speed_band, 1) OVER w AS sb_tm5,
           LAG(speed_band, 2) OVER w AS sb_tm10,
           LAG(speed_band, 3) OVER w AS sb_tm15,
           LEAD(speed_band, 3) OVER w AS y_tp15,
           {HOUR_SQL} AS hour_sg, {DOW_SQL} AS dow_sg
    FROM speedbands
    WINDOW w AS (PARTITION BY link_id ORDER BY snapshot_ts)"""
VALID_SQL = ("sb BETWEEN 1 AND 8 AND sb_tm5 BETWEEN 1 AND 8 AND sb_tm10 BETWEEN 1 AND 8 "
             "AND sb_tm15 BETWEEN 1 AND 8 AND y_tp15 BETWEEN 1 AND 8")
FILTERED_SQL = f"SELECT * FROM traffic WHERE {VALID_SQL}"


def r6(c):
    return F.round(c, 6)


# Flagship: W1/W2/W3 -> F2 -> P20 -> M1 -> A5 by local hour -------------------
@register("change_rate_by_hour", with_views(f"""
    SELECT hour_sg, COUNT(*) AS rows,
           CAST(SUM(CASE WHEN y_tp15 <> sb THEN 1 ELSE 0 END) AS BIGINT) AS change_count,
           ROUND(AVG(CASE WHEN y_tp15 <> sb THEN 1e0 ELSE 0e0 END), 6) AS change_rate,
           ROUND(AVG(CAST(sb - sb_tm5 AS DOUBLE)), 6) AS mean_delta_0_5,
           ROUND(AVG(CAST((sb - sb_tm5) - (sb_tm5 - sb_tm10) AS DOUBLE)), 6) AS mean_acceleration
    FROM filtered GROUP BY hour_sg""", "speedbands",
    extra={"traffic": TRAFFIC_SQL, "filtered": FILTERED_SQL}))
def change_rate_by_hour(spark, d):
    t = FL.valid_bands(traffic_windows(fx.speedbands(spark, d)))
    t = S.momentum(t).withColumn("change", S.flag(F.col("y_tp15") != F.col("sb")))
    return t.groupBy("hour_sg").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("change").cast("bigint").alias("change_count"),
        r6(F.avg(F.col("change").cast("double"))).alias("change_rate"),
        r6(F.avg(F.col("delta_0_5").cast("double"))).alias("mean_delta_0_5"),
        r6(F.avg(F.col("acceleration").cast("double"))).alias("mean_acceleration"),
    )


# W1-W3 as rows ----------------------------------------------------------------
@register("feature_windows", with_views(
    "SELECT * FROM filtered", "speedbands", extra={"traffic": TRAFFIC_SQL, "filtered": FILTERED_SQL}))
def feature_windows(spark, d):
    return FL.valid_bands(traffic_windows(fx.speedbands(spark, d)))


# Time-correct lags (our strict variant) ----------------------------------
@register("strict_lags", with_views("""
    SELECT link_id, snapshot_ts, speed_band AS sb,
           CASE WHEN snapshot_ts - LAG(snapshot_ts, 1) OVER w = 300 THEN LAG(speed_band, 1) OVER w END AS sb_tm5,
           CASE WHEN snapshot_ts - LAG(snapshot_ts, 2) OVER w = 600 THEN LAG(speed_band, 2) OVER w END AS sb_tm10,
           CASE WHEN snapshot_ts - LAG(snapshot_ts, 3) OVER w = 900 THEN LAG(speed_band, 3) OVER w END AS sb_tm15,
           CASE WHEN LEAD(snapshot_ts, 3) OVER w - snapshot_ts = 900 THEN LEAD(speed_band, 3) OVER w END AS y_tp15
    FROM speedbands WINDOW w AS (PARTITION BY link_id ORDER BY snapshot_ts)""", "speedbands"))
def strict_lags(spark, d):
    from bandcast.operators.temporal import lag_lead
    s = fx.speedbands(spark, d).select("link_id", "snapshot_ts", F.col("speed_band").alias("sb"))
    return lag_lead(s, "link_id", "snapshot_ts", "sb", {"sb_tm5": 1, "sb_tm10": 2, "sb_tm15": 3},
                    {"y_tp15": 3}, strict_step=300)


# Skew path of W1/W2: day chunks + boundary window must equal the plain one ---
@register("chunked_lags", with_views(
    "SELECT link_id, snapshot_ts, sb, sb_tm5, sb_tm10, sb_tm15, y_tp15 FROM traffic", "speedbands",
    extra={"traffic": TRAFFIC_SQL}))
def chunked_lags(spark, d):
    from bandcast.operators.temporal import lag_lead
    s = fx.speedbands(spark, d).select("link_id", "snapshot_ts", F.col("speed_band").alias("sb"))
    return lag_lead(s, "link_id", "snapshot_ts", "sb", {"sb_tm5": 1, "sb_tm10": 2, "sb_tm15": 3},
                    {"y_tp15": 3}, chunk_seconds=86400)


# Safe int, str() parity ------------------------------------------
_K_SQL = "regexp_extract(props, ':\\s*([^}]*)\\}', 1)"


@register("safe_int_parse", f"""
    SELECT event_id,
           CASE WHEN regexp_matches(trim({_K_SQL}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({_K_SQL}) AS INTEGER) END AS k,
           CASE WHEN regexp_matches(trim(event_type), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(event_type) AS INTEGER) END AS bad,
           CASE WHEN regexp_matches(trim(CAST(value AS VARCHAR)), '^[+-]?[0-9]+$')
                THEN TRY_CAST(trim(CAST(value AS VARCHAR)) AS INTEGER) END AS value_as_int,
           COALESCE(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'None') AS type_text
    FROM events""")
def safe_int_parse(spark, d):
    from bandcast.sources.tables import read_table
    e = read_table(spark, d, "events")
    k = F.regexp_extract("props", r":\s*([^}]*)\}", 1)
    return e.select(
        "event_id",
        S.safe_int(k).alias("k"),
        S.safe_int("event_type").alias("bad"),
        S.safe_int(F.col("value").cast("string")).alias("value_as_int"),
        S.text_or_none(F.when(F.col("event_type") != "view", F.col("event_type")), parity=True).alias("type_text"),
    )


# P14-P19, P21, P28, P29 ------------------------------------------------------
@register("time_functions", f"""
    WITH t AS (SELECT event_id, CAST(FLOOR(epoch(ts)) AS BIGINT) AS snapshot_ts FROM events)
    SELECT event_id, snapshot_ts,
           CAST(snapshot_ts // 300 * 300 AS BIGINT) AS bucket,
           {HOUR_SQL} AS hour_sg, {DOW_SQL} AS dow_sg,
           CAST(CASE WHEN {DOW_SQL} IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
           CAST(CASE WHEN {HOUR_SQL} IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS INTEGER) AS is_peak,
           CAST(CASE WHEN {HOUR_SQL} >= 4 AND {HOUR_SQL} < 22 THEN 1 ELSE 0 END AS INTEGER) AS active,
           CAST(((snapshot_ts + 28800) // 86400 + CASE WHEN {HOUR_SQL} >= 22 THEN 1 ELSE 0 END) * 86400
                + 4 * 3600 - 28800 AS BIGINT) AS next_window,
           CAST(CEIL(snapshot_ts / 300e0) * 300 AS BIGINT) AS next_tick,
           ROUND((snapshot_ts - CAST(snapshot_ts // 300 * 300 AS BIGINT)) / 60e0, 6) AS mins_into_bucket
    FROM t""")
def time_functions(spark, d):
    from bandcast.sources.tables import read_table
    e = read_table(spark, d, "events").select(
        "event_id", F.floor(F.unix_timestamp("ts")).cast("bigint").alias("snapshot_ts"))
    ts = F.col("snapshot_ts")
    return e.select(
        "event_id", "snapshot_ts",
        S.time_bucket(ts).alias("bucket"),
        S.local_hour(ts).alias("hour_sg"),
        S.local_dow(ts).alias("dow_sg"),
        S.is_weekend(S.local_dow(ts)).alias("is_weekend"),
        S.is_peak(S.local_hour(ts)).alias("is_peak"),
        S.flag(S.in_active_window(ts)).alias("active"),
        S.next_window_start(ts).alias("next_window"),
        S.next_tick(ts).alias("next_tick"),
        r6(S.minutes_between(ts, S.time_bucket(ts))).alias("mins_into_bucket"),
    )


# ISO text round trip -----------------------------------------------------
@register("iso_round_trip", """
    SELECT event_id, CAST(FLOOR(epoch(ts)) AS BIGINT) AS epoch_s,
           strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso_text,
           CAST(FLOOR(epoch(ts)) AS BIGINT) AS parsed_epoch
    FROM events""")
def iso_round_trip(spark, d):
    from bandcast.sources.tables import read_table
    e = read_table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    iso = F.regexp_replace(S.to_iso(F.date_trunc("second", "t")), "Z$", "+00:00")
    return e.select("event_id", S.to_epoch("t").alias("epoch_s"), iso.alias("iso_text"),
                    S.to_epoch(S.parse_utc(iso)).alias("parsed_epoch"))


# P9-P13 ---------------------------------------------------------------------
@register("geo_functions", with_views("""
    SELECT link_id,
           ROUND((start_lat + end_lat) / 2e0, 9) AS mid_lat,
           ROUND((start_lon + end_lon) / 2e0, 9) AS mid_lon,
           CAST(FLOOR((start_lat + end_lat) / 2e0 * 200e0) AS BIGINT) AS lat_bin,
           CAST(FLOOR((start_lon + end_lon) / 2e0 * 200e0) AS BIGINT) AS lon_bin,
           ROUND(2e0 * 6371000e0 * atan2(sqrt(a), sqrt(1e0 - a)), 3) AS length_m,
           ROUND(sqrt(pow(start_lat - end_lat, 2) + pow(start_lon - end_lon, 2)), 9) AS link_dist_proxy,
           ROUND(radians(end_lat - start_lat) * 6371000e0, 3) AS lat_span_m
    FROM (SELECT *, pow(sin(radians(end_lat - start_lat) / 2), 2)
                 + cos(radians(start_lat)) * cos(radians(end_lat)) * pow(sin(radians(end_lon - start_lon) / 2), 2) AS a
          FROM links)""", "links"))
def geo_functions(spark, d):
    l = fx.links(spark, d)
    return l.select(
        "link_id",
        F.round(S.midpoint("start_lat", "end_lat"), 9).alias("mid_lat"),
        F.round(S.midpoint("start_lon", "end_lon"), 9).alias("mid_lon"),
        S.grid_bin(S.midpoint("start_lat", "end_lat")).alias("lat_bin"),
        S.grid_bin(S.midpoint("start_lon", "end_lon")).alias("lon_bin"),
        F.round(haversine_m("start_lat", "start_lon", "end_lat", "end_lon"), 3).alias("length_m"),
        F.round(S.length_proxy("start_lat", "start_lon", "end_lat", "end_lon"), 9).alias("link_dist_proxy"),
        F.round(angular_to_m(F.radians(F.col("end_lat") - F.col("start_lat"))), 3).alias("lat_span_m"),
    )


# P22-P26 --------------------------------------------------------------------
_CUT_SQL = """CASE WHEN pred_mag > -0.001e0 AND pred_mag <= 0.75e0 THEN 'Noise (Vetoed)'
                   WHEN pred_mag > 0.75e0 AND pred_mag <= 1.5e0 THEN 'Minor Jam (1-band)'
                   WHEN pred_mag > 1.5e0 AND pred_mag <= 3e0 THEN 'Significant Jam (2-3)'
                   WHEN pred_mag > 3e0 AND pred_mag <= 10e0 THEN 'Major Jam (4+)' END"""


@register("band_projection", with_views(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           GREATEST(pred_mag - 1e0, 0e0) AS clipped,
           CAST(round_even(pred_mag, 0) AS INTEGER) AS rounded,
           GREATEST(1, CAST(round_even(sb - pred_mag, 0) AS INTEGER)) AS band_down,
           CAST(round_even(sb + pred_mag, 0) AS INTEGER) AS band_up,
           ABS(router_prob - 0.5e0) AS router_margin,
           {_CUT_SQL} AS severity_bin
    FROM predictions""", "predictions"))
def band_projection(spark, d):
    p = fx.predictions(spark, d)
    return p.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.clip_low(F.col("pred_mag") - 1.0).alias("clipped"),
        S.round_half_even("pred_mag").cast("int").alias("rounded"),
        S.projected_band("sb", "pred_mag", -1, floor=1).alias("band_down"),
        S.projected_band("sb", "pred_mag", +1, floor=None).alias("band_up"),
        S.margin("router_prob").alias("router_margin"),
        S.cut_right("pred_mag", labels=S.JAM_LABELS).alias("severity_bin"),
    )


# P6-P8 + P4 + P30 -------------------------------------------------------------
@register("category_flags", with_views("""
    SELECT incident_id, CAST(link_id AS INTEGER) AS link_id, type,
           CAST(CASE WHEN type = 'Accident' THEN 1 ELSE 0 END AS INTEGER) AS has_accident,
           CAST(CASE WHEN type = 'Roadwork' THEN 1 ELSE 0 END AS INTEGER) AS has_roadwork,
           CAST(CASE WHEN type = 'Vehicle breakdown' THEN 1 ELSE 0 END AS INTEGER) AS has_breakdown,
           COALESCE(CASE WHEN incident_id % 7 = 0 THEN NULL ELSE end_ts - start_ts END, -1) AS duration_s
    FROM incident_intervals""", "incident_intervals"))
def category_flags(spark, d):
    i = fx.incident_intervals(spark, d)
    i = S.category_flags(i, "type", {"has_accident": "Accident", "has_roadwork": "Roadwork",
                                     "has_breakdown": "Vehicle breakdown"})
    i = i.withColumn("duration_s", F.when(F.col("incident_id") % 7 != 0, F.col("end_ts") - F.col("start_ts")))
    i = S.fill_defaults(i, {"duration_s": -1})
    i = S.narrow(i, {"link_id": "int"})
    return S.keep(i, ["incident_id", "link_id", "type", "has_accident", "has_roadwork", "has_breakdown",
                      "duration_s", "not_a_column"])


# One count per predicate -------------------------------------------
@register("filter_counts", with_views("""
    SELECT
      (SELECT COUNT(*) FROM speedbands WHERE snapshot_ts BETWEEN 1704153600 AND 1704153600 + 7 * 86400) AS in_range,
      (SELECT COUNT(*) FROM incident_intervals WHERE link_id IS NOT NULL) AS not_null_key,
      (SELECT COUNT(*) FROM speedbands WHERE snapshot_ts < 1705000000) AS train_rows,
      (SELECT COUNT(*) FROM speedbands WHERE snapshot_ts >= 1705000000) AS test_rows,
      (SELECT COUNT(*) FROM predictions WHERE y_tp15 <> sb) AS change_rows,
      (SELECT COUNT(*) FROM predictions WHERE y_tp15 = sb) AS stable_rows,
      (SELECT COUNT(*) FROM predictions WHERE y_tp15 > sb) AS rise_rows,
      (SELECT COUNT(*) FROM predictions WHERE y_tp15 < sb) AS fall_rows,
      (SELECT COUNT(*) FROM predictions WHERE gk_prob >= 0.25e0 AND router_prob >= 0.5e0) AS routed_down,
      (SELECT COUNT(*) FROM predictions WHERE pred_mag >= 0.75e0) AS above_075
    """, "speedbands", "incident_intervals", "predictions"))
def filter_counts(spark, d):
    sp = fx.speedbands(spark, d)
    ii = fx.incident_intervals(spark, d)
    p = fx.predictions(spark, d).withColumns({
        "gk_pred_25": S.flag(F.col("gk_prob") >= 0.25), "router_pred": S.flag(F.col("router_prob") >= 0.5)})
    counts = [
        ("in_range", FL.between_ts(sp, 1704153600, 1704153600 + 7 * 86400)),
        ("not_null_key", FL.not_null(ii, "link_id")),
        ("train_rows", FL.split_side(sp, 1705000000, "train")),
        ("test_rows", FL.split_side(sp, 1705000000, "test")),
        ("change_rows", FL.row_class(p, "change")),
        ("stable_rows", FL.row_class(p, "stable")),
        ("rise_rows", FL.row_class(p, "rise")),
        ("fall_rows", FL.row_class(p, "fall")),
        ("routed_down", FL.routed(p, 1, 1)),
        ("above_075", FL.above(p, "pred_mag", 0.75)),
    ]
    out = None
    for name, df in counts:
        c = A.row_count(df, name=name)
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    return out.agg(*[F.max(n).alias(n) for n, _ in counts])


# A1, A4, A6, A10, A11 ------------------------------------------------------------
@register("time_bounds", with_views(
    "SELECT MIN(snapshot_ts) AS min_ts, MAX(snapshot_ts) AS max_ts FROM speedbands", "speedbands"))
def time_bounds(spark, d):
    return A.time_bounds(fx.speedbands(spark, d))


@register("incident_type_counts", with_views(
    "SELECT type, COUNT(*) AS count FROM incident_snapshots GROUP BY type", "incident_snapshots"))
def incident_type_counts(spark, d):
    return A.value_counts(fx.incident_snapshots(spark, d), "type")


@register("mean_magnitude_where", with_views("""
    SELECT incident_nearby, ROUND(AVG(CASE WHEN y_tp15 <> sb THEN pred_mag END), 6) AS mean_pred_mag
    FROM predictions GROUP BY incident_nearby""", "predictions"))
def mean_magnitude_where(spark, d):
    out = A.mean_where(fx.predictions(spark, d), "pred_mag", F.col("y_tp15") != F.col("sb"),
                       by="incident_nearby", name="mean_pred_mag")
    return out.withColumn("mean_pred_mag", r6(F.col("mean_pred_mag")))


@register("speedbands_export", with_views("SELECT * FROM speedbands", "speedbands"))
def speedbands_export(spark, d):
    """Floor to 5 minutes, first row per (link, bucket)."""
    return fx.speedbands(spark, d)


@register("severity_crosstab", with_views(f"""
    SELECT severity_bin,
           CAST(SUM(CASE WHEN y_tp15 <= sb THEN 1 ELSE 0 END) AS BIGINT) AS real_0,
           CAST(SUM(CASE WHEN y_tp15 > sb THEN 1 ELSE 0 END) AS BIGINT) AS real_1
    FROM (SELECT *, {_CUT_SQL} AS severity_bin FROM predictions)
    WHERE severity_bin IS NOT NULL GROUP BY severity_bin""", "predictions"))
def severity_crosstab(spark, d):
    p = fx.predictions(spark, d).select(
        S.cut_right("pred_mag", labels=S.JAM_LABELS).alias("severity_bin"),
        S.flag(F.col("y_tp15") > F.col("sb")).alias("real"))
    out = A.crosstab(p, "severity_bin", "real", [0, 1])
    return out.select("severity_bin", F.col("0").cast("bigint").alias("real_0"),
                      F.col("1").cast("bigint").alias("real_1"))
