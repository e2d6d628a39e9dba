"""Registered queries: streaming T1-T6.

Each query lands input files derived by Spark from the driver tables in a
fresh folder under the shared checkpoint folder, runs the stream to
completion with ``availableNow`` into a parquet sink (with its own
checkpoint), and returns the sink as a batch DataFrame.  Windowed and
session outputs need the watermark to pass their end: a heartbeat record
two days after the last event is landed with the data and filtered from the
output (a stream never ends; the heartbeat stands for later traffic).
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.q_ingest import SNAP_SQL, _events, _iso, speed_items
from bandcast.plans.registry import register
from bandcast.sources import feeds as FD
from bandcast.streaming import streams as ST
from bandcast.streaming.lifecycles import closed_lifecycles, start_lifecycles

HEARTBEAT_AFTER = 2 * 86400


def _paths(spark, name):
    root = ST.stream_workspace(spark, name)
    return os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "ckpt")


@register("stream_speed_feed", f"""
    SELECT CAST(user_id AS VARCHAR) AS link_id,
           CASE WHEN event_type = 'view' THEN NULL ELSE CAST(FLOOR(value) AS INTEGER) % 10 END AS speed_band,
           CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(FLOOR(value) AS INTEGER) END AS min_speed,
           CAST(FLOOR(value) AS INTEGER) + 10 AS max_speed,
           {SNAP_SQL} AS snapshot_time
    FROM events""")
def q_stream_speed_feed(spark, d):
    """T1 + S2 + S13: poll pages landed in day folders, streamed."""
    src, out, ck = _paths(spark, "speed_feed")
    e = _events(spark, d)
    items = speed_items(e)
    it = e.select(F.col("_bucket").alias("poll"), "_page",
                  F.struct(*[c.alias(n) for n, c in items.items()]).alias("_i"))
    pages = it.groupBy("poll", "_page").agg(
        F.to_json(F.struct(F.col("poll"), F.collect_list("_i").alias("value"))).alias("json"))
    pages = pages.withColumn("day", F.floor(F.col("poll") / 86400).cast("bigint"))
    ST.land_text(pages, src, partition="day")
    raw = ST.stream_feed(spark, src, FD.SPEED_ITEM, stamp=T.StructField("poll", T.LongType()))
    norm = FD.normalize_speedbands(FD.stamp_snapshot(raw, _iso(F.col("poll"))))
    ST.run_available_now(norm, out, ck)
    return spark.read.parquet(out)


@register("stream_readings_dedupe", with_views(
    "SELECT DISTINCT station_id, reading_ts FROM rain", "rain"))
def q_stream_readings_dedupe(spark, d):
    """Every reading landed twice (again in the next poll); the stream
    keeps one per (station, reading time)."""
    src, out, ck = _paths(spark, "readings_dedupe")
    r = fx.rain(spark, d)
    first = r.select("station_id", "reading_ts", "value_mm", F.col("reading_ts").alias("poll"))
    again = r.select("station_id", "reading_ts", (F.col("value_mm") + 1000).alias("value_mm"),
                     (F.col("reading_ts") + 300).alias("poll"))
    both = first.unionByName(again).withColumn("day", F.floor(F.col("poll") / 86400).cast("bigint"))
    ST.land_json(both, src, partition="day")
    schema = T.StructType([T.StructField("station_id", T.StringType()), T.StructField("reading_ts", T.LongType()),
                           T.StructField("value_mm", T.DoubleType()), T.StructField("poll", T.LongType())])
    s = ST.stream_rows(spark, src, schema).withColumn("reading_time", F.timestamp_seconds("reading_ts"))
    ST.run_available_now(ST.stream_dedupe(s, ["station_id", "reading_time"], "reading_time", "1 hour"), out, ck)
    return spark.read.parquet(out).select("station_id", "reading_ts")


def _land_with_heartbeat(df, ts_col, src, key_col, key_value):
    mx = df.agg(F.max(ts_col)).first()[0]
    hb = df.limit(1).withColumns({ts_col: F.lit(int(mx) + HEARTBEAT_AFTER).cast("bigint"),
                                  key_col: F.lit(key_value).cast(dict(df.dtypes)[key_col])})
    ST.land_json(df.unionByName(hb), src)


INTERVAL_SCHEMA = T.StructType([
    T.StructField("incident_id", T.LongType()), T.StructField("link_id", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("start_ts", T.LongType()),
    T.StructField("end_ts", T.LongType())])


@register("stream_link_rollup", with_views("""
    SELECT link_id, start_ts // 300 * 300 AS window_start_ts, COUNT(*) AS incidents,
           CAST(MAX(CASE WHEN type = 'Accident' THEN 1 ELSE 0 END) AS INTEGER) AS nearby_accident
    FROM incident_intervals GROUP BY link_id, start_ts // 300 * 300""", "incident_intervals"))
def q_stream_link_rollup(spark, d):
    """T4: tumbling 5-minute rollup per link with a 10-minute watermark."""
    src, out, ck = _paths(spark, "link_rollup")
    _land_with_heartbeat(fx.incident_intervals(spark, d), "start_ts", src, "link_id", -1)
    s = ST.stream_rows(spark, src, INTERVAL_SCHEMA).withColumn("event_time", F.timestamp_seconds("start_ts"))
    agg = ST.stream_rollup(s, "event_time", ["link_id"],
                           [F.count(F.lit(1)).alias("incidents"),
                            F.max(F.when(F.col("type") == "Accident", 1).otherwise(0)).cast("int")
                            .alias("nearby_accident")])
    ST.run_available_now(agg, out, ck)
    res = spark.read.parquet(out).filter(F.col("link_id") >= 0)
    return res.select("link_id", F.unix_timestamp("window_start").alias("window_start_ts"), "incidents",
                      "nearby_accident")


@register("stream_incident_sessions", with_views("""
    SELECT type, link_id, MIN(start_ts) AS session_start_ts, MAX(start_ts) + 900 AS session_end_ts,
           COUNT(*) AS sightings
    FROM (SELECT *, SUM(new) OVER (PARTITION BY type, link_id ORDER BY start_ts, incident_id
                                   ROWS UNBOUNDED PRECEDING) AS sess
          FROM (SELECT *, CASE WHEN LAG(start_ts) OVER (PARTITION BY type, link_id ORDER BY start_ts, incident_id) IS NULL
                                 OR start_ts - LAG(start_ts) OVER (PARTITION BY type, link_id ORDER BY start_ts, incident_id) > 900
                               THEN 1 ELSE 0 END AS new
                FROM incident_intervals))
    GROUP BY type, link_id, sess""", "incident_intervals"))
def q_stream_incident_sessions(spark, d):
    """Session windows per (type, link), gap 15 minutes."""
    src, out, ck = _paths(spark, "incident_sessions")
    _land_with_heartbeat(fx.incident_intervals(spark, d), "start_ts", src, "link_id", -1)
    s = ST.stream_rows(spark, src, INTERVAL_SCHEMA).withColumn("event_time", F.timestamp_seconds("start_ts"))
    ST.run_available_now(ST.stream_sessions(s, "event_time", ["type", "link_id"], "15 minutes"), out, ck)
    res = spark.read.parquet(out).filter(F.col("link_id") >= 0)
    return res.select("type", "link_id", F.unix_timestamp("session_start").alias("session_start_ts"),
                      F.unix_timestamp("session_end").alias("session_end_ts"), "sightings")


@register("stream_enriched_speed", with_views("""
    SELECT s.link_id, s.snapshot_ts, s.speed_band, l.road_category, i.incident_id
    FROM speedbands s JOIN links l ON s.link_id = l.link_id
    LEFT JOIN incident_intervals i ON i.link_id = s.link_id AND s.snapshot_ts BETWEEN i.start_ts AND i.end_ts""",
                                              "speedbands", "links", "incident_intervals"))
def q_stream_enriched_speed(spark, d):
    """T5: speed stream joined to the static road dimension and interval table."""
    src, out, ck = _paths(spark, "enriched_speed")
    ST.land_json(fx.speedbands(spark, d), src)
    schema = T.StructType([T.StructField("link_id", T.LongType()), T.StructField("snapshot_ts", T.LongType()),
                           T.StructField("speed_band", T.IntegerType())])
    s = ST.stream_rows(spark, src, schema)
    dim = fx.links(spark, d).select("link_id", "road_category")
    iv = fx.incident_intervals(spark, d).select("link_id", "incident_id", "start_ts", "end_ts")
    ST.run_available_now(ST.stream_enrich(s, dim, "link_id", iv).select(
        "link_id", "snapshot_ts", "speed_band", "road_category", "incident_id"), out, ck)
    return spark.read.parquet(out)


SIGHTING_SCHEMA = T.StructType([
    T.StructField("src_id", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("message", T.StringType()), T.StructField("ts", T.LongType())])


def run_stream_lifecycles(spark, snapshots, name="lifecycles", gap=15.0, dist=200.0, **kw):
    src, out, ck = _paths(spark, name)
    _land_with_heartbeat(snapshots.select(*[f.name for f in SIGHTING_SCHEMA.fields]), "ts", src, "type",
                         "__heartbeat__")
    start_lifecycles(ST.stream_rows(spark, src, SIGHTING_SCHEMA), out, ck, gap, dist, **kw)
    return closed_lifecycles(spark, out).filter(~F.col("type").eqNullSafe("__heartbeat__"))


@register("stream_incident_lifecycles")
def q_stream_incident_lifecycles(spark, d):
    """Stateful lifecycles on a stream (rows-only; equals W5 in tests)."""
    return run_stream_lifecycles(spark, fx.incident_snapshots(spark, d))


@register("stream_unlimited_lifecycles", with_views("""
    SELECT type, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS sightings
    FROM (SELECT *, SUM(new) OVER (PARTITION BY type ORDER BY ts, src_id ROWS UNBOUNDED PRECEDING) AS session
          FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY type ORDER BY ts, src_id) <= 900 THEN 0 ELSE 1 END AS new
                FROM incident_snapshots))
    GROUP BY type, session""", "incident_snapshots"))
def q_stream_unlimited_lifecycles(spark, d):
    """T3 without a limit of distance: one incident per type and gap session, which SQL can check."""
    got = run_stream_lifecycles(spark, fx.incident_snapshots(spark, d), "unlimited", 15.0, 2.1e7)
    return got.select("type", "start_ts", "end_ts", "sightings")
