"""Registered queries: feed ingest.

Feed pages are derived by Spark from the driver tables (one JSON page per
poll snapshot and page number, at most 50 items), then parsed back with the
same normalisers that read landed files.  The oracles state the expected
rows directly from the source tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bandcast.sources import feeds as FD
from bandcast.sources.tables import read_table
from bandcast.operators.aggregates import first_per_key
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.registry import register

PAGE = 50
_BUCKET = "CAST(FLOOR(epoch(ts) / 300) * 300 AS BIGINT)"
_ISO_SQL = "strftime(make_timestamp(({b}) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
SNAP_SQL = _ISO_SQL.format(b=_BUCKET)


def _iso(epoch_col):
    return F.concat(F.date_format(F.timestamp_seconds(epoch_col), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _events(spark, d):
    e = read_table(spark, d, "events")
    b = (F.floor(F.unix_timestamp("ts") / 300) * 300).cast("bigint")
    return e.withColumns({"_bucket": b, "snapshot_time": _iso(b), "_page": F.floor(F.col("event_id") / PAGE)})


def _pages(items, item_cols: dict):
    """One ``{"value": [...]}`` text per (snapshot, page)."""
    it = items.select("snapshot_time", "_page", "event_id", F.struct(*[c.alias(n) for n, c in item_cols.items()]).alias("_i"))
    ordered = F.sort_array(F.collect_list(F.struct("event_id", "_i")))["_i"]        # feed order: by event
    return it.groupBy("snapshot_time", "_page").agg(F.to_json(F.struct(ordered.alias("value"))).alias("json"))


def _s(c):
    return c.cast("string")


# S1, S2, S13 --------------------------------------------------------------------------
def speed_items(e):
    lat = F.lit(1.3e0) + (F.col("user_id") % 10) * F.lit(8e-4)
    lon = F.lit(103.8e0) + F.floor(F.col("user_id") / 10) * F.lit(8e-4)
    return {
        "LinkID": _s(F.col("user_id")),
        "RoadName": F.concat(F.lit("Road "), _s(F.col("user_id")), F.lit(" v"), _s(F.col("event_id") % 3)),
        "RoadCategory": F.when(F.col("event_type") != "click", _s(F.col("user_id") % 8 + 1)),
        "SpeedBand": F.when(F.col("event_type") == "view", F.lit("n/a"))
                      .otherwise(_s(F.floor("value").cast("int") % 10)),
        "MinimumSpeed": F.when(F.col("event_type") == "signup", F.lit("")).otherwise(_s(F.floor("value"))),
        "MaximumSpeed": _s(F.floor("value") + 10),
        "StartLat": _s(lat), "StartLon": _s(lon), "EndLat": _s(lat + F.lit(4e-4)), "EndLon": _s(lon + F.lit(3e-4)),
    }


def speed_raw(spark, d):
    e = _events(spark, d)
    return FD.parse_feed(_pages(e, speed_items(e)), FD.SPEED_ITEM, position="_pos")


@register("feed_speedbands", f"""
    SELECT CAST(user_id AS VARCHAR) AS link_id,
           CASE WHEN event_type = 'view' THEN NULL ELSE CAST(FLOOR(value) AS INTEGER) % 10 END AS speed_band,
           CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(FLOOR(value) AS INTEGER) END AS min_speed,
           CAST(FLOOR(value) AS INTEGER) + 10 AS max_speed,
           {SNAP_SQL} AS snapshot_time
    FROM events""")
def q_feed_speedbands(spark, d):
    return FD.normalize_speedbands(speed_raw(spark, d))


ROADS_NEW_SQL = f"""
    SELECT CAST(user_id AS VARCHAR) AS link_id,
           'Road ' || CAST(user_id AS VARCHAR) || ' v' || CAST(event_id % 3 AS VARCHAR) AS road_name,
           COALESCE(CASE WHEN event_type <> 'click' THEN CAST(user_id % 8 + 1 AS VARCHAR) END, 'None') AS road_category,
           CAST(CAST(1.3e0 + (user_id % 10) * 8e-4 AS VARCHAR) AS DOUBLE) AS start_lat,
           CAST(CAST(103.8e0 + FLOOR(user_id / 10) * 8e-4 AS VARCHAR) AS DOUBLE) AS start_lon,
           CAST(CAST(1.3e0 + (user_id % 10) * 8e-4 + 4e-4 AS VARCHAR) AS DOUBLE) AS end_lat,
           CAST(CAST(103.8e0 + FLOOR(user_id / 10) * 8e-4 + 3e-4 AS VARCHAR) AS DOUBLE) AS end_lon,
           {SNAP_SQL} AS snapshot_time, event_id
    FROM events"""


@register("feed_road_links_first_wins", with_views("""
    SELECT CAST(link_id AS VARCHAR) AS link_id, road_name, road_category, start_lat, start_lon, end_lat, end_lon
    FROM links
    UNION ALL
    SELECT link_id, arg_min(road_name, struct_pack(s := snapshot_time, r := event_id)),
           arg_min(road_category, struct_pack(s := snapshot_time, r := event_id)),
           arg_min(start_lat, struct_pack(s := snapshot_time, r := event_id)),
           arg_min(start_lon, struct_pack(s := snapshot_time, r := event_id)),
           arg_min(end_lat, struct_pack(s := snapshot_time, r := event_id)),
           arg_min(end_lon, struct_pack(s := snapshot_time, r := event_id))
    FROM roads_new WHERE link_id NOT IN (SELECT CAST(link_id AS VARCHAR) FROM links)
    GROUP BY link_id""", "links", extra={"roads_new": ROADS_NEW_SQL}))
def q_feed_road_links(spark, d):
    """S3: insert-or-ignore into the existing road dimension; the first item in feed order wins."""
    dim = fx.links(spark, d).withColumn("link_id", F.col("link_id").cast("string"))
    new = FD.road_link_rows(speed_raw(spark, d), keep=["_page", "_pos"])
    return FD.upsert_first(dim, new, "link_id", ["snapshot_time", "_page", "_pos"])


# S4-S7 -----------------------------------------------------------------------------------
_TYPE_SQL = ("CASE event_type WHEN 'error' THEN 'Accident' WHEN 'signup' THEN 'Roadwork' "
             "WHEN 'purchase' THEN 'Vehicle breakdown' ELSE 'Heavy Traffic' END")


@register("feed_incidents", f"""
    SELECT {_TYPE_SQL} AS type,
           CAST(CAST(1.3e0 + (user_id % 10) * 8e-4 + 2e-4 AS VARCHAR) AS DOUBLE) AS lat,
           CAST(CAST(103.8e0 + FLOOR(user_id / 10) * 8e-4 + 1e-4 AS VARCHAR) AS DOUBLE) AS lon,
           props AS message, {SNAP_SQL} AS snapshot_time
    FROM events""")
def q_feed_incidents(spark, d):
    e = _events(spark, d)
    s = fx.incident_snapshots(spark, d).select("src_id", "type", "lat", "lon", "message")
    e = e.join(s, e["event_id"] == s["src_id"])
    items = {"Type": F.col("type"), "Latitude": _s(F.col("lat")), "Longitude": _s(F.col("lon")),
             "Message": F.col("message")}
    return FD.normalize_incidents(FD.parse_feed(_pages(e, items), FD.INCIDENT_ITEM))


@register("feed_travel_times", f"""
    SELECT 'Expressway ' || CAST(user_id % 7 AS VARCHAR) AS name,
           CASE WHEN event_type = 'view' THEN NULL ELSE user_id % 2 + 1 END AS direction,
           COALESCE(CASE WHEN event_type <> 'error' THEN 'P' || CAST(user_id AS VARCHAR) END, 'None') AS far_end_point,
           'S' || CAST(user_id AS VARCHAR) AS start_point,
           'E' || CAST(user_id AS VARCHAR) AS end_point,
           CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(FLOOR(value) AS INTEGER) END AS est_time,
           {SNAP_SQL} AS snapshot_time
    FROM events""")
def q_feed_travel_times(spark, d):
    e = _events(spark, d)
    items = {
        "Name": F.concat(F.lit("Expressway "), _s(F.col("user_id") % 7)),
        "Direction": F.when(F.col("event_type") == "view", F.lit("x")).otherwise(_s(F.col("user_id") % 2 + 1)),
        "FarEndPoint": F.when(F.col("event_type") != "error", F.concat(F.lit("P"), _s(F.col("user_id")))),
        "StartPoint": F.concat(F.lit("S"), _s(F.col("user_id"))),
        "EndPoint": F.concat(F.lit("E"), _s(F.col("user_id"))),
        "EstTime": F.when(F.col("event_type") == "signup", F.lit("")).otherwise(_s(F.floor("value"))),
    }
    out = FD.normalize_travel_times(FD.parse_feed(_pages(e, items), FD.TRAVEL_ITEM))
    return out.withColumn("direction", F.col("direction").cast("bigint"))


@register("feed_faulty_lights", f"""
    SELECT 'A' || CAST(event_id AS VARCHAR) AS alarm_id, CAST(user_id AS VARCHAR) AS node_id,
           CAST(event_id % 4 + 1 AS INTEGER) AS type, {SNAP_SQL} AS start_date,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE {SNAP_SQL} END AS end_date,
           CASE WHEN event_type = 'view' THEN NULL ELSE props END AS message,
           {SNAP_SQL} AS snapshot_time
    FROM events""")
def q_feed_faulty_lights(spark, d):
    e = _events(spark, d)
    items = {
        "AlarmID": F.concat(F.lit("A"), _s(F.col("event_id"))), "NodeID": _s(F.col("user_id")),
        "Type": _s(F.col("event_id") % 4 + 1), "StartDate": F.col("snapshot_time"),
        "EndDate": F.when(F.col("event_id") % 3 != 0, F.col("snapshot_time")),
        "Message": F.when(F.col("event_type") != "view", F.col("props")),
    }
    return FD.normalize_faulty_lights(FD.parse_feed(_pages(e, items), FD.FAULTY_ITEM))


@register("feed_signs", f"""
    SELECT 'E' || CAST(user_id AS VARCHAR) AS equipment_id,
           CAST(CAST(1.3e0 + (user_id % 10) * 8e-4 AS VARCHAR) AS DOUBLE) AS lat,
           CAST(CAST(103.8e0 + FLOOR(user_id / 10) * 8e-4 AS VARCHAR) AS DOUBLE) AS lon,
           event_type AS message, {SNAP_SQL} AS snapshot_time
    FROM events""")
def q_feed_signs(spark, d):
    e = _events(spark, d)
    items = {"EquipmentID": F.concat(F.lit("E"), _s(F.col("user_id"))),
             "Latitude": _s(F.lit(1.3e0) + (F.col("user_id") % 10) * F.lit(8e-4)),
             "Longitude": _s(F.lit(103.8e0) + F.floor(F.col("user_id") / 10) * F.lit(8e-4)),
             "Message": F.col("event_type")}
    return FD.normalize_signs(FD.parse_feed(_pages(e, items), FD.SIGN_ITEM))


# S8 ---------------------------------------------------------------------------------------
ALERT_PAGE = 20


@register("feed_train_alerts", f"""
    WITH e AS (SELECT *, {SNAP_SQL} AS snapshot_time, event_id // {ALERT_PAGE} AS page FROM events),
    firsts AS (SELECT snapshot_time, page, MIN(event_id) AS first_id FROM e GROUP BY snapshot_time, page)
    SELECT 2 AS status, 'L' || CAST(e.user_id % 6 AS VARCHAR) AS line,
           CAST(e.user_id % 2 + 1 AS VARCHAR) AS direction, 'ST' || CAST(e.user_id AS VARCHAR) AS stations,
           'Yes' AS free_bus, 'No' AS free_shuttle, NULL AS shuttle_direction,
           lpad(CAST(f.first_id AS VARCHAR), 10, '0') || ':' || fe.props AS message,
           fe.snapshot_time AS created_time, e.snapshot_time
    FROM e JOIN firsts f ON e.snapshot_time = f.snapshot_time AND e.page = f.page
           JOIN e fe ON fe.event_id = f.first_id
    WHERE e.page % 5 <> 0 AND e.event_type <> 'view'
    UNION ALL
    SELECT CASE WHEN event_type = 'view' THEN NULL ELSE 1 END, 'L' || CAST(user_id % 6 AS VARCHAR),
           CAST(user_id % 2 + 1 AS VARCHAR), 'ST' || CAST(user_id AS VARCHAR), NULL, NULL, 'Both',
           props, snapshot_time, snapshot_time
    FROM e WHERE page % 5 = 0""")
def q_feed_train_alerts(spark, d):
    """Object pages (Line[] + Message[], first message carried; pages whose
    segments are all filtered out give no rows) and list pages (rows as is)."""
    e = _events(spark, d).withColumn("_page", F.floor(F.col("event_id") / ALERT_PAGE))
    seg = F.struct(F.concat(F.lit("L"), _s(F.col("user_id") % 6)).alias("Line"),
                   _s(F.col("user_id") % 2 + 1).alias("Direction"),
                   F.concat(F.lit("ST"), _s(F.col("user_id"))).alias("Stations"),
                   F.lit(None).cast("string").alias("MRTShuttleDirection"))
    msg = F.struct(F.concat(F.lpad(_s(F.col("event_id")), 10, "0"), F.lit(":"), F.col("props")).alias("Content"),
                   F.col("snapshot_time").alias("CreatedDate"))
    obj = e.filter(F.col("_page") % 5 != 0).groupBy("snapshot_time", "_page").agg(
        F.collect_list(F.when(F.col("event_type") != "view", seg)).alias("Line"),
        F.array_sort(F.collect_list(msg)).alias("Message"))
    obj_json = obj.select("snapshot_time", F.to_json(F.struct(F.struct(
        F.lit("2").alias("Status"), F.lit("Yes").alias("FreePublicBus"), F.lit("No").alias("FreeMRTShuttle"),
        "Line", "Message").alias("value"))).alias("json"))
    row = F.struct(F.when(F.col("event_type") != "view", F.lit("1")).alias("Status"),
                   F.concat(F.lit("L"), _s(F.col("user_id") % 6)).alias("Line"),
                   _s(F.col("user_id") % 2 + 1).alias("Direction"),
                   F.concat(F.lit("ST"), _s(F.col("user_id"))).alias("Stations"),
                   F.lit("Both").alias("MRTShuttleDirection"), F.col("props").alias("Message"),
                   F.col("snapshot_time").alias("CreatedDate"))
    lst = e.filter(F.col("_page") % 5 == 0).groupBy("snapshot_time", "_page").agg(F.collect_list(row).alias("value"))
    lst_json = lst.select("snapshot_time", F.to_json(F.struct("value")).alias("json"))
    return FD.flatten_alerts(obj_json.unionByName(lst_json))


# S9-S11 -------------------------------------------------------------------------------------
@register("feed_rainfall_readings", f"""
    WITH r AS (
        SELECT 'S' || CAST(event_id % 25 AS VARCHAR) AS station_id, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_mm,
               {SNAP_SQL} AS reading_time, {SNAP_SQL} AS snapshot_time, event_id FROM events
        UNION ALL
        SELECT 'S' || CAST(event_id % 25 AS VARCHAR), CAST(CAST(value + 1000 AS VARCHAR) AS DOUBLE),
               {SNAP_SQL}, {_ISO_SQL.format(b=_BUCKET + ' + 300')}, event_id FROM events)
    SELECT station_id, reading_time, arg_min(value_mm, struct_pack(s := snapshot_time, e := event_id)) AS value_mm,
           MIN(snapshot_time) AS snapshot_time
    FROM r GROUP BY station_id, reading_time""")
def q_feed_rainfall_readings(spark, d):
    """S10 + S11: the first reading in feed order wins, inside a poll and over polls."""
    docs = rain_poll_docs(spark, d)
    rows = FD.normalize_rainfall(docs, position="_pos", keep=["_page"])
    first = first_per_key(rows, ["station_id", "reading_time"], ["snapshot_time", "_page", "_pos"])
    return first.select("station_id", "reading_time", "value_mm", "snapshot_time")


def rain_poll_docs(spark, d):
    """Rainfall documents: readings of a poll in pages of at most ``PAGE``
    source rows (a reading appears again, +1000, in the next poll)."""
    e = _events(spark, d)
    v = F.struct(F.concat(F.lit("S"), _s(F.col("event_id") % 25)).alias("stationId"), _s(F.col("value")).alias("value"))
    v2 = F.struct(F.concat(F.lit("S"), _s(F.col("event_id") % 25)).alias("stationId"),
                  _s(F.col("value") + 1000).alias("value"))
    both = e.select(F.col("_bucket").alias("_poll"), "_bucket", "_page", "event_id", v.alias("v")).unionByName(
        e.select((F.col("_bucket") + 300).alias("_poll"), "_bucket", "_page", "event_id", v2.alias("v")))
    readings = both.groupBy("_poll", "_page", "_bucket").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "v")))["v"].alias("data")).select(
        "_poll", "_page", F.struct(_iso(F.col("_bucket")).alias("timestamp"), "data").alias("r"))
    per_page = readings.groupBy("_poll", "_page").agg(F.collect_list("r").alias("readings"))
    return per_page.select(_iso(F.col("_poll")).alias("snapshot_time"), "_page",
                           F.to_json(F.struct(F.struct("readings").alias("data"))).alias("json"))


def station_docs(spark, d):
    """Station list documents: one per region, polled 5 minutes apart; each
    station is listed in its region's document and again, renamed, in the
    next region's, so first-wins decides between two versions."""
    n = read_table(spark, d, "nation")
    loc = F.when(F.col("n_nationkey") % 7 != 0, F.struct(
        _s(F.lit(1.3e0) + (F.col("n_nationkey") % 5) * F.lit(2e-3)).alias("latitude"),
        _s(F.lit(103.8e0) + F.floor(F.col("n_nationkey") / 5) * F.lit(2e-3)).alias("longitude")))
    sid = F.concat(F.lit("S"), _s(F.col("n_nationkey")))
    own = n.select(F.col("n_regionkey").alias("_doc"), F.struct(sid.alias("id"), F.col("n_name").alias("name"),
                                                               loc.alias("labelLocation")).alias("s"))
    copy = n.select(((F.col("n_regionkey") + 1) % 5).alias("_doc"),
                    F.struct(sid.alias("id"), F.concat(F.col("n_name"), F.lit(" (copy)")).alias("name"),
                             loc.alias("labelLocation")).alias("s"))
    docs = own.unionByName(copy).groupBy("_doc").agg(F.collect_list("s").alias("stations"))
    return docs.select(_iso(F.lit(STATION_T0) + F.col("_doc") * 300).alias("snapshot_time"),
                       F.to_json(F.struct(F.struct("stations").alias("data"))).alias("json"))


STATION_T0 = 1704067200
_ST_SNAP = "strftime(make_timestamp((CAST({t0} AS BIGINT) + ({d}) * 300) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
STATIONS_SQL = f"""
    SELECT 'S' || CAST(n_nationkey AS VARCHAR) AS station_id, n_name AS loc_name,
           CASE WHEN n_nationkey % 7 <> 0 THEN CAST(CAST(1.3e0 + (n_nationkey % 5) * 2e-3 AS VARCHAR) AS DOUBLE) END AS lat,
           CASE WHEN n_nationkey % 7 <> 0 THEN CAST(CAST(103.8e0 + FLOOR(n_nationkey / 5) * 2e-3 AS VARCHAR) AS DOUBLE) END AS lon,
           {_ST_SNAP.format(t0=STATION_T0, d='n_regionkey')} AS snapshot_time
    FROM nation
    UNION ALL
    SELECT 'S' || CAST(n_nationkey AS VARCHAR), n_name || ' (copy)',
           CASE WHEN n_nationkey % 7 <> 0 THEN CAST(CAST(1.3e0 + (n_nationkey % 5) * 2e-3 AS VARCHAR) AS DOUBLE) END,
           CASE WHEN n_nationkey % 7 <> 0 THEN CAST(CAST(103.8e0 + FLOOR(n_nationkey / 5) * 2e-3 AS VARCHAR) AS DOUBLE) END,
           {_ST_SNAP.format(t0=STATION_T0, d='(n_regionkey + 1) % 5')}
    FROM nation"""


@register("feed_rainfall_stations", f"""
    WITH s AS ({STATIONS_SQL})
    SELECT station_id, arg_min(loc_name, snapshot_time) AS loc_name, arg_min(lat, snapshot_time) AS lat,
           arg_min(lon, snapshot_time) AS lon, MIN(snapshot_time) AS snapshot_time
    FROM s GROUP BY station_id""")
def q_feed_rainfall_stations(spark, d):
    """S9 + S3: station list, coordinates from labelLocation (null if absent), first wins."""
    return FD.upsert_first(None, FD.normalize_stations(station_docs(spark, d)), "station_id", ["snapshot_time"])


UPDATES_SQL = """
    SELECT 'S' || CAST(n_nationkey AS VARCHAR) AS station_id,
           CASE WHEN n_nationkey % 4 = 0 THEN 0e0 ELSE 1.31e0 + n_nationkey * 1e-4 END AS lat,
           CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 103.81e0 + n_nationkey * 1e-4 END AS lon
    FROM nation
    UNION ALL
    SELECT 'S' || CAST(r_regionkey + 100 AS VARCHAR), 1.2e0, 103.7e0 FROM region"""


def station_updates(spark, d):
    n = read_table(spark, d, "nation").select(
        F.concat(F.lit("S"), _s(F.col("n_nationkey"))).alias("station_id"),
        F.when(F.col("n_nationkey") % 4 == 0, F.lit(0.0)).otherwise(F.lit(1.31e0) + F.col("n_nationkey") * F.lit(1e-4)).alias("lat"),
        F.when(F.col("n_nationkey") % 6 != 0, F.lit(103.81e0) + F.col("n_nationkey") * F.lit(1e-4)).alias("lon"))
    r = read_table(spark, d, "region").select(F.concat(F.lit("S"), _s(F.col("r_regionkey") + 100)).alias("station_id"),
                                             F.lit(1.2e0).alias("lat"), F.lit(103.7e0).alias("lon"))
    return n.unionByName(r)


_UPD_JOIN = """FROM rain_stations s LEFT JOIN (SELECT * FROM upd WHERE lat IS NOT NULL AND lat <> 0
                                                AND lon IS NOT NULL AND lon <> 0) u
               ON s.station_id = u.station_id"""


@register("station_coordinate_update", with_views(f"""
    SELECT s.station_id, s.loc_name, COALESCE(u.lat, s.lat) AS lat, COALESCE(u.lon, s.lon) AS lon {_UPD_JOIN}""",
                                                  "rain_stations", extra={"upd": UPDATES_SQL}))
def q_station_update(spark, d):
    """Only existing ids, only when both coordinates are truthy."""
    new, _ = FD.update_by_key(fx.rain_stations(spark, d), station_updates(spark, d), "station_id", ["lat", "lon"])
    return new


@register("station_update_count", with_views(f"SELECT COUNT(u.station_id) AS updated {_UPD_JOIN}",
                                             "rain_stations", extra={"upd": UPDATES_SQL}))
def q_station_update_count(spark, d):
    _, cnt = FD.update_by_key(fx.rain_stations(spark, d), station_updates(spark, d), "station_id", ["lat", "lon"])
    return cnt


@register("ingest_quarantine", f"""
    WITH r AS (SELECT event_id, {SNAP_SQL} AS snapshot_time FROM events),
    bad AS (SELECT DISTINCT snapshot_time FROM r WHERE event_id % 401 = 0)
    SELECT CASE WHEN b.snapshot_time IS NULL THEN 'good' ELSE 'quarantined' END AS status,
           COUNT(*) AS rows, COUNT(DISTINCT r.snapshot_time) AS batches
    FROM r LEFT JOIN bad b ON r.snapshot_time = b.snapshot_time GROUP BY 1""")
def q_ingest_quarantine(spark, d):
    """S15 + P2: a poll whose strict float cast fails anywhere is set aside
    whole; the other polls of the feed proceed."""
    e = _events(spark, d)
    items = {"Type": F.col("event_type"),
             "Latitude": F.when(F.col("event_id") % 401 == 0, F.lit("bad")).otherwise(_s(F.col("value"))),
             "Longitude": _s(F.col("value")), "Message": F.col("props")}
    raw = FD.parse_feed(_pages(e, items), FD.INCIDENT_ITEM)
    good, quarantined = FD.isolate_batches(raw, {"Latitude": "double", "Longitude": "double"})
    g = FD.normalize_incidents(good).select(F.lit("good").alias("status"), "snapshot_time")
    q = quarantined.select(F.lit("quarantined").alias("status"), "snapshot_time")
    return g.unionByName(q).groupBy("status").agg(F.count(F.lit(1)).alias("rows"),
                                                  F.countDistinct("snapshot_time").alias("batches"))
