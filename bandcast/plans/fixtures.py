"""Traffic-shaped views over the driver tables.

Each view is defined twice: as a Spark DataFrame builder that reads the
driver parquet (so every registered query scales with the given tables) and
as DuckDB SQL text used by the oracle.  Definitions follow FIXTURES.md §3.
Constants are written with an exponent so both engines type them DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandcast.sources.tables import read_table
from bandcast.operators.aggregates import first_per_key


def _epoch(c):
    return F.unix_timestamp(c).cast("double")


def _incident_type(c):
    return (F.when(c == "error", "Accident")
             .when(c == "signup", "Roadwork")
             .when(c == "purchase", "Vehicle breakdown")
             .otherwise("Heavy Traffic"))


def links(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    start_lat = F.lit(1.3e0) + (F.col("s_suppkey") % 10) * F.lit(8e-4) + F.col("s_acctbal") * F.lit(1e-9)
    start_lon = F.lit(103.8e0) + F.floor(F.col("s_suppkey") / 10) * F.lit(8e-4)
    return s.select(
        F.col("s_suppkey").alias("link_id"),
        F.col("s_name").alias("road_name"),
        (F.col("s_suppkey") % 8 + 1).cast("string").alias("road_category"),
        start_lat.alias("start_lat"),
        start_lon.alias("start_lon"),
        (start_lat + F.lit(4e-4)).alias("end_lat"),
        (start_lon + F.lit(3e-4)).alias("end_lon"),
    )


def speedbands_raw(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("link_id"),
        (F.floor(_epoch(F.col("ts")) / 300) * 300).cast("bigint").alias("snapshot_ts"),
        (F.floor(F.col("value")).cast("int") % 10).alias("speed_band"),
        F.col("event_id"),
    )


def speedbands(spark: SparkSession, d: str) -> DataFrame:
    """One band per (link, 5-minute bucket): the first event wins."""
    return first_per_key(speedbands_raw(spark, d), ["link_id", "snapshot_ts"], ["event_id"]) \
        .select("link_id", "snapshot_ts", "speed_band")


def incident_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("src_id"),
        _incident_type(F.col("event_type")).alias("type"),
        (F.lit(1.3e0) + (F.col("user_id") % 10) * F.lit(8e-4) + F.lit(2e-4)).alias("lat"),
        (F.lit(103.8e0) + F.floor(F.col("user_id") / 10) * F.lit(8e-4) + F.lit(1e-4)).alias("lon"),
        F.col("props").alias("message"),
        F.floor(_epoch(F.col("ts"))).cast("bigint").alias("ts"),
    )


def incident_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").filter(F.col("event_type") != "view")
    start = F.floor(_epoch(F.col("ts"))).cast("bigint")
    return e.select(
        F.col("event_id").alias("incident_id"),
        F.col("user_id").alias("link_id"),
        _incident_type(F.col("event_type")).alias("type"),
        start.alias("start_ts"),
        (start + (F.col("event_id") % 12) * 600).alias("end_ts"),
    )


def rain_stations(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation")
    return n.select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("station_id"),
        F.col("n_name").alias("loc_name"),
        (F.lit(1.3e0) + (F.col("n_nationkey") % 5) * F.lit(2e-3) + F.col("n_nationkey") * F.lit(1e-7)).alias("lat"),
        (F.lit(103.8e0) + F.floor(F.col("n_nationkey") / 5) * F.lit(2e-3)).alias("lon"),
    )


def rain(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(
        F.concat(F.lit("S"), (F.col("event_id") % 25).cast("string")).alias("station_id"),
        (F.floor(_epoch(F.col("ts")) / 300) * 300).cast("bigint").alias("reading_ts"),
        F.when(F.col("value") < F.lit(3e1), F.lit(0e0)).otherwise(F.col("value") / F.lit(1e2)).alias("value_mm"),
        F.col("event_id").alias("src_id"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    sb = F.lit(1) + F.col("l_quantity").cast("int") % 8
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        sb.cast("int").alias("sb"),
        F.when(F.col("l_partkey") % 5 < 3, sb).otherwise(F.lit(1) + F.col("l_suppkey") % 8).cast("int").alias("y_tp15"),
        (F.col("l_discount") * F.lit(1e1)).alias("gk_prob"),
        (F.col("l_tax") * F.lit(1.25e1)).alias("router_prob"),
        (F.col("l_extendedprice") / F.lit(2e4)).alias("pred_mag"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("incident_nearby"),
    )


BUILDERS = {
    "links": links,
    "speedbands": speedbands,
    "incident_snapshots": incident_snapshots,
    "incident_intervals": incident_intervals,
    "rain_stations": rain_stations,
    "rain": rain,
    "predictions": predictions,
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, d)


# --------------------------------------------------------------------------
# DuckDB text of the same views (oracle side).
_E = "epoch(ts)"
_TYPE = ("CASE event_type WHEN 'error' THEN 'Accident' WHEN 'signup' THEN 'Roadwork' "
         "WHEN 'purchase' THEN 'Vehicle breakdown' ELSE 'Heavy Traffic' END")

SQL_VIEWS = {
    "links": f"""
        SELECT s_suppkey AS link_id, s_name AS road_name,
               CAST(s_suppkey % 8 + 1 AS VARCHAR) AS road_category,
               1.3e0 + (s_suppkey % 10) * 8e-4 + s_acctbal * 1e-9 AS start_lat,
               103.8e0 + FLOOR(s_suppkey / 10) * 8e-4 AS start_lon,
               1.3e0 + (s_suppkey % 10) * 8e-4 + s_acctbal * 1e-9 + 4e-4 AS end_lat,
               103.8e0 + FLOOR(s_suppkey / 10) * 8e-4 + 3e-4 AS end_lon
        FROM supplier""",
    "speedbands": f"""
        SELECT link_id, snapshot_ts, arg_min(speed_band, event_id) AS speed_band
        FROM (SELECT user_id AS link_id,
                     CAST(FLOOR({_E} / 300) * 300 AS BIGINT) AS snapshot_ts,
                     CAST(FLOOR(value) AS INTEGER) % 10 AS speed_band, event_id
              FROM events)
        GROUP BY link_id, snapshot_ts""",
    "incident_snapshots": f"""
        SELECT event_id AS src_id, {_TYPE} AS type,
               1.3e0 + (user_id % 10) * 8e-4 + 2e-4 AS lat,
               103.8e0 + FLOOR(user_id / 10) * 8e-4 + 1e-4 AS lon,
               props AS message, CAST(FLOOR({_E}) AS BIGINT) AS ts
        FROM events""",
    "incident_intervals": f"""
        SELECT event_id AS incident_id, user_id AS link_id, {_TYPE} AS type,
               CAST(FLOOR({_E}) AS BIGINT) AS start_ts,
               CAST(FLOOR({_E}) AS BIGINT) + (event_id % 12) * 600 AS end_ts
        FROM events WHERE event_type <> 'view'""",
    "rain_stations": """
        SELECT CONCAT('S', CAST(n_nationkey AS VARCHAR)) AS station_id, n_name AS loc_name,
               1.3e0 + (n_nationkey % 5) * 2e-3 + n_nationkey * 1e-7 AS lat,
               103.8e0 + FLOOR(n_nationkey / 5) * 2e-3 AS lon
        FROM nation""",
    "rain": f"""
        SELECT CONCAT('S', CAST(event_id % 25 AS VARCHAR)) AS station_id,
               CAST(FLOOR({_E} / 300) * 300 AS BIGINT) AS reading_ts,
               CASE WHEN value < 3e1 THEN 0e0 ELSE value / 1e2 END AS value_mm,
               event_id AS src_id
        FROM events""",
    "predictions": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CAST(1 + CAST(l_quantity AS INTEGER) % 8 AS INTEGER) AS sb,
               CAST(CASE WHEN l_partkey % 5 < 3 THEN 1 + CAST(l_quantity AS INTEGER) % 8
                         ELSE 1 + l_suppkey % 8 END AS INTEGER) AS y_tp15,
               l_discount * 1e1 AS gk_prob, l_tax * 1.25e1 AS router_prob,
               l_extendedprice / 2e4 AS pred_mag,
               CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS incident_nearby
        FROM lineitem""",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for the fixture views it uses (and extra CTEs)."""
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    ctes += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def _iso_seconds(epoch_col):
    return F.concat(F.date_format(F.timestamp_seconds(epoch_col), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def traffic_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The reference's own table shapes (FIXTURES.md §1), derived from the
    driver tables: text ids and ISO snapshot times as the feeds store them."""
    l = links(spark, d).withColumn("link_id", F.col("link_id").cast("string"))
    e = read_table(spark, d, "events")
    t = F.floor(F.unix_timestamp("ts")).cast("bigint")
    speed = e.select(F.col("user_id").cast("string").alias("link_id"),
                     (F.floor(F.col("value")).cast("int") % 10).alias("speed_band"),
                     F.floor(F.col("value")).cast("int").alias("min_speed"),
                     (F.floor(F.col("value")).cast("int") + 10).alias("max_speed"),
                     _iso_seconds(t).alias("snapshot_time"))
    inc = incident_snapshots(spark, d).select("type", "lat", "lon", "message", _iso_seconds(F.col("ts")).alias("snapshot_time"))
    r = rain(spark, d).join(e.select(F.col("event_id").alias("src_id"), t.alias("_t")), "src_id")
    rainfall = r.select("station_id", "value_mm", _iso_seconds(F.col("reading_ts")).alias("reading_time"),
                        _iso_seconds(F.col("_t")).alias("snapshot_time"))
    return {"road_links": l, "speedbands": speed, "traffic_incidents": inc,
            "rainfall_stations": rain_stations(spark, d), "rainfall": rainfall}
