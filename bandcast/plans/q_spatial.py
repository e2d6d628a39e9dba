"""Registered queries: spatial joins (J8-J12, J15), the impacted-links and
bucket pipeline (J9 -> J12 -> W7 -> A3), fan-out (A9), adjacency export
(A7), weather mapping (J7, P7) and the as-of weather join (J13, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandcast.functions import scalars as S
from bandcast.operators import aggregates as A
from bandcast.operators import spatial as SP
from bandcast.operators.joins import join_readings
from bandcast.operators.temporal import asof_join, interval_bucket_rollup
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.registry import register


def _hav_sql(lat1, lon1, lat2, lon2):
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"(2e0 * 6371000e0 * atan2(sqrt({a}), sqrt(1e0 - ({a}))))"


LINK_MID_SQL = """SELECT link_id, (start_lat + end_lat) / 2e0 AS mid_lat, (start_lon + end_lon) / 2e0 AS mid_lon
                  FROM links"""
INCIDENTS_SQL = """SELECT src_id AS incident_id, type, lat, lon, ts AS start_ts, ts + (src_id % 12) * 600 AS end_ts
                   FROM incident_snapshots"""
NEIGHBORS_SQL = f"""
    SELECT a.link_id, b.link_id AS neighbor_link_id, {_hav_sql('a.mid_lat', 'a.mid_lon', 'b.mid_lat', 'b.mid_lon')} AS dist_m
    FROM lm a, lm b
    WHERE a.link_id <> b.link_id
      AND {_hav_sql('a.mid_lat', 'a.mid_lon', 'b.mid_lat', 'b.mid_lon')} <= 200e0"""
ANCHORS_SQL = f"""
    SELECT incident_id, link_id AS anchor_link_id, dist_m, rank FROM (
        SELECT i.incident_id, l.link_id, d.dist_m,
               ROW_NUMBER() OVER (PARTITION BY i.incident_id ORDER BY d.dist_m, l.link_id) AS rank
        FROM inc i, lm l, LATERAL (SELECT {_hav_sql('i.lat', 'i.lon', 'l.mid_lat', 'l.mid_lon')} AS dist_m) d
        WHERE d.dist_m <= 200e0)
    WHERE rank <= 5"""
IMPACTED_SQL = """
    SELECT DISTINCT x.incident_id, x.link_id, i.start_ts, i.end_ts, i.type FROM (
        SELECT incident_id, anchor_link_id AS link_id FROM anchors
        UNION ALL
        SELECT a.incident_id, n.neighbor_link_id AS link_id FROM anchors a JOIN nb n ON a.anchor_link_id = n.link_id
    ) x JOIN inc i ON x.incident_id = i.incident_id"""
MAPPING_SQL = f"""
    SELECT link_id, arg_min(station_id, struct_pack(d := dist_m, s := station_id)) AS nearest_station_id,
           MIN(dist_m) AS dist_m
    FROM (SELECT l.link_id, s.station_id, {_hav_sql('l.mid_lat', 'l.mid_lon', 's.lat', 's.lon')} AS dist_m
          FROM lm l, rain_stations s)
    GROUP BY link_id"""
RAIN_DEDUP_SQL = "SELECT station_id, reading_ts, arg_min(value_mm, src_id) AS value_mm FROM rain GROUP BY station_id, reading_ts"

SPATIAL_CTES = {"lm": LINK_MID_SQL, "inc": INCIDENTS_SQL, "nb": NEIGHBORS_SQL, "anchors": ANCHORS_SQL}


def link_mids(spark, d):
    return fx.links(spark, d).select(
        "link_id", S.midpoint("start_lat", "end_lat").alias("mid_lat"), S.midpoint("start_lon", "end_lon").alias("mid_lon"))


def incidents(spark, d):
    s = fx.incident_snapshots(spark, d)
    return s.select(F.col("src_id").alias("incident_id"), "type", "lat", "lon", F.col("ts").alias("start_ts"),
                    (F.col("ts") + (F.col("src_id") % 12) * 600).alias("end_ts"))


def neighbors(spark, d):
    return SP.neighbors_within(link_mids(spark, d), "link_id", 200.0, "mid_lat", "mid_lon")


def anchors(spark, d):
    return SP.knn_within(incidents(spark, d), link_mids(spark, d), "incident_id", "link_id", k=5, max_m=200.0,
                         r_lat="mid_lat", r_lon="mid_lon", out_right="anchor_link_id")


def impacted(spark, d):
    carry = ["start_ts", "end_ts", "type"]
    a = SP.knn_within(incidents(spark, d), link_mids(spark, d), "incident_id", "link_id", k=5, max_m=200.0,
                      r_lat="mid_lat", r_lon="mid_lon", carry=carry)
    return SP.expand_one_hop(a, neighbors(spark, d).select("link_id", "neighbor_link_id"), "incident_id",
                             carry=carry)


def station_mapping(spark, d):
    return SP.nearest(link_mids(spark, d), fx.rain_stations(spark, d), "link_id", "station_id",
                      l_lat="mid_lat", l_lon="mid_lon") \
        .withColumnRenamed("station_id", "nearest_station_id")


def rain_readings(spark, d):
    """One reading per (station, reading time), first source row wins."""
    return A.first_per_key(fx.rain(spark, d), ["station_id", "reading_ts"], ["src_id"]).drop("src_id")


@register("link_neighbors_200m", with_views(
    "SELECT link_id, neighbor_link_id, ROUND(dist_m, 2) AS dist_m FROM nb", "links", extra=SPATIAL_CTES))
def q_link_neighbors(spark, d):
    return neighbors(spark, d).withColumn("dist_m", F.round("dist_m", 2))


@register("neighbor_adjacency", with_views("""
    SELECT link_id, array_to_string(list_sort(list(neighbor_link_id)), ',') AS neighbor_link_ids
    FROM nb GROUP BY link_id""", "links", extra=SPATIAL_CTES))
def q_neighbor_adjacency(spark, d):
    g = A.collect_groups(neighbors(spark, d), "link_id", "neighbor_link_id")
    return g.select("link_id", F.array_join(F.col("neighbor_link_ids").cast("array<string>"), ",")
                    .alias("neighbor_link_ids"))


@register("incident_anchor_links", with_views(
    "SELECT incident_id, anchor_link_id, ROUND(dist_m, 2) AS dist_m, CAST(rank AS INTEGER) AS rank FROM anchors",
    "links", "incident_snapshots", extra=SPATIAL_CTES))
def q_incident_anchor_links(spark, d):
    return anchors(spark, d).withColumn("dist_m", F.round("dist_m", 2))


@register("anchor_fanout", with_views("""
    SELECT COUNT(*) AS total_anchors,
           ROUND(COUNT(*) / GREATEST((SELECT COUNT(*) FROM inc), 1), 6) AS avg_anchors_per_source
    FROM anchors""", "links", "incident_snapshots", extra=SPATIAL_CTES))
def q_anchor_fanout(spark, d):
    n = incidents(spark, d).count()
    out = A.fanout_stats(anchors(spark, d), n, "anchors")
    return out.withColumn("avg_anchors_per_source", F.round("avg_anchors_per_source", 6))


@register("incident_nearest_link", with_views(f"""
    SELECT i.incident_id, n.link_id AS nearest_link_id FROM inc i
    LEFT JOIN (SELECT incident_id, anchor_link_id AS link_id FROM anchors WHERE rank = 1) n
      ON i.incident_id = n.incident_id""", "links", "incident_snapshots", extra=SPATIAL_CTES))
def q_incident_nearest_link(spark, d):
    out = SP.nearest_within(incidents(spark, d), link_mids(spark, d), "incident_id", "link_id", 200.0,
                            out="nearest_link_id", r_lat="mid_lat", r_lon="mid_lon")
    return out.select("incident_id", "nearest_link_id")


@register("impacted_links_200m", with_views("SELECT * FROM impacted", "links", "incident_snapshots",
                                            extra={**SPATIAL_CTES, "impacted": IMPACTED_SQL}))
def q_impacted_links(spark, d):
    return impacted(spark, d).select("incident_id", "link_id", "start_ts", "end_ts", "type")


@register("incident_nearby_buckets_200m", with_views("""
    SELECT link_id, snapshot_ts, 1 AS incident_nearby,
           CAST(MAX(CASE WHEN type = 'Accident' THEN 1 ELSE 0 END) AS INTEGER) AS nearby_accident,
           CAST(MAX(CASE WHEN type = 'Roadwork' THEN 1 ELSE 0 END) AS INTEGER) AS nearby_roadwork,
           CAST(MAX(CASE WHEN type = 'Vehicle breakdown' THEN 1 ELSE 0 END) AS INTEGER) AS nearby_breakdown,
           (snapshot_ts - MAX(start_ts)) / 60e0 AS mins_since_nearby_start
    FROM (SELECT link_id, type, start_ts,
                 UNNEST(generate_series(start_ts // 300 * 300, end_ts // 300 * 300, 300)) AS snapshot_ts
          FROM impacted)
    GROUP BY link_id, snapshot_ts""", "links", "incident_snapshots", extra={**SPATIAL_CTES, "impacted": IMPACTED_SQL}))
def q_incident_nearby_buckets(spark, d):
    return interval_bucket_rollup(impacted(spark, d))


@register("link_station_mapping", with_views(
    "SELECT link_id, nearest_station_id, ROUND(dist_m, 2) AS dist_m FROM mapping", "links", "rain_stations",
    extra={"lm": LINK_MID_SQL, "mapping": MAPPING_SQL}))
def q_link_station_mapping(spark, d):
    return station_mapping(spark, d).withColumn("dist_m", F.round("dist_m", 2))


@register("mapping_check", with_views("""
    SELECT l.link_id, l.road_name, m.nearest_station_id FROM links l JOIN mapping m ON l.link_id = m.link_id""",
                                      "links", "rain_stations", extra={"lm": LINK_MID_SQL, "mapping": MAPPING_SQL}))
def q_mapping_check(spark, d):
    m = station_mapping(spark, d).select("link_id", "nearest_station_id")
    return SP.mapping_check(fx.links(spark, d).select("link_id", "road_name"), m)


@register("weather_features", with_views("""
    SELECT m.link_id, r.reading_ts, r.value_mm AS rain_mm,
           CAST(CASE WHEN r.value_mm > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_raining
    FROM mapping m JOIN rain_dedup r ON m.nearest_station_id = r.station_id""",
                                         "links", "rain_stations", "rain",
                                         extra={"lm": LINK_MID_SQL, "mapping": MAPPING_SQL,
                                                "rain_dedup": RAIN_DEDUP_SQL}))
def q_weather_features(spark, d):
    m = station_mapping(spark, d).select("link_id", "nearest_station_id")
    j = join_readings(m, rain_readings(spark, d))
    return j.select("link_id", "reading_ts", F.col("value_mm").alias("rain_mm"),
                    S.flag(F.col("value_mm") > 0).alias("is_raining"))


@register("rain_asof", with_views("""
    SELECT s.link_id, s.snapshot_ts,
           CASE WHEN s.snapshot_ts - r.reading_ts <= 1800 THEN r.value_mm END AS rain_mm,
           CASE WHEN s.snapshot_ts - r.reading_ts <= 1800 THEN r.reading_ts END AS reading_ts_matched
    FROM (SELECT sp.link_id, sp.snapshot_ts, m.nearest_station_id AS station_id
          FROM speedbands sp JOIN mapping m ON sp.link_id = m.link_id) s
    ASOF LEFT JOIN rain_dedup r ON s.station_id = r.station_id AND s.snapshot_ts >= r.reading_ts""",
                                  "links", "rain_stations", "rain", "speedbands",
                                  extra={"lm": LINK_MID_SQL, "mapping": MAPPING_SQL, "rain_dedup": RAIN_DEDUP_SQL}))
def q_rain_asof(spark, d):
    m = station_mapping(spark, d).select("link_id", F.col("nearest_station_id").alias("station_id"))
    s = fx.speedbands(spark, d).select("link_id", "snapshot_ts").join(m, "link_id")
    out = asof_join(s, rain_readings(spark, d), "station_id", "snapshot_ts", "reading_ts", ["value_mm"],
                    tolerance=1800)
    return out.select("link_id", "snapshot_ts", F.col("value_mm").alias("rain_mm"), "reading_ts_matched")


@register("rain_asof_unbounded", with_views("""
    SELECT s.link_id, s.snapshot_ts, r.value_mm AS rain_mm, r.reading_ts AS reading_ts_matched
    FROM (SELECT sp.link_id, sp.snapshot_ts, m.nearest_station_id AS station_id
          FROM speedbands sp JOIN mapping m ON sp.link_id = m.link_id) s
    ASOF LEFT JOIN rain_dedup r ON s.station_id = r.station_id AND s.snapshot_ts >= r.reading_ts""",
                                            "links", "rain_stations", "rain", "speedbands",
                                            extra={"lm": LINK_MID_SQL, "mapping": MAPPING_SQL,
                                                   "rain_dedup": RAIN_DEDUP_SQL}))
def q_rain_asof_unbounded(spark, d):
    m = station_mapping(spark, d).select("link_id", F.col("nearest_station_id").alias("station_id"))
    s = fx.speedbands(spark, d).select("link_id", "snapshot_ts").join(m, "link_id")
    # unbounded look-back; a measured hot station switches to day chunks with
    # the latest earlier reading carried into each day (exact, see tests)
    out = asof_join(s, rain_readings(spark, d), "station_id", "snapshot_ts", "reading_ts", ["value_mm"],
                    chunk_seconds="auto")
    return out.select("link_id", "snapshot_ts", F.col("value_mm").alias("rain_mm"), "reading_ts_matched")
