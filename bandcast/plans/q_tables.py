"""Registered queries: sinks that survive retries (S14, S18-S20), the export job (S21), label, gate and
router tables over pseudo-scores (M1-M4, M13, M14), and small operators that other queries only use inside (A5, F8, P5, P27, U1, T2)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from bandcast import jobs
from bandcast.functions.geo import haversine_m
from bandcast.functions.scalars import midpoint, require_columns, text_or_null
from bandcast.operators import aggregates as A
from bandcast.operators import filters as FL
from bandcast.operators import sampling as R
from bandcast.operators import training as M
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.q_sampling import KEYS, PH_KEYS
from bandcast.plans.registry import register
from bandcast.session import checkpoint_dir
from bandcast.sources import tables as TB
from bandcast.sources.commits import BatchLog
from bandcast.streaming import streams as ST


def _folder(spark, name):
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:8]}")


@register("fact_batches", with_views("SELECT link_id, snapshot_ts, speed_band FROM speedbands", "speedbands"))
def q_fact_batches(spark, d):
    """Facts in two batches, the second written twice (a retry) and a third never committed; readers see each row once."""
    root = _folder(spark, "facts")
    log = BatchLog(spark, f"{root}/_commits")
    facts = TB.fact_rows(fx.speedbands(spark, d).withColumn("snapshot_time", F.timestamp_seconds("snapshot_ts")), files_per_date=2, entity="link_id")
    for batch, part in ((0, "link_id % 2 = 0"), (1, "link_id % 2 <> 0"), (1, "link_id % 2 <> 0"), (2, "true")):
        log.write(facts.filter(part), root, batch, ["snapshot_date"], ["link_id", "snapshot_time"])
        if batch < 2:
            log.commit(batch, {root: facts.schema})
    return log.read(root).select("link_id", "snapshot_ts", "speed_band")


@register("table_codecs", with_views("""
    SELECT codec, COUNT(*) AS rows, CAST(SUM(speed_band) AS BIGINT) AS bands
    FROM speedbands, (SELECT UNNEST(['zstd', 'snappy', 'gzip']) AS codec) GROUP BY codec""", "speedbands"))
def q_table_codecs(spark, d):
    """The same table under three codecs reads back alike."""
    root, out = _folder(spark, "codecs"), None
    for codec in ("zstd", "snappy", "gzip"):
        TB.write_table(fx.speedbands(spark, d), f"{root}/{codec}", None if codec == "snappy" else codec, sort_within=["link_id", "snapshot_ts"])
        one = spark.read.parquet(f"{root}/{codec}").agg(F.count("*").alias("rows"), F.sum("speed_band").cast("bigint").alias("bands")) \
            .withColumn("codec", F.lit(codec))
        out = one if out is None else out.unionByName(one)
    return out


@register("compacted_speedbands", with_views(
    "SELECT CAST(link_id AS INTEGER) AS link_id, CAST(speed_band AS SMALLINT) AS speed_band FROM speedbands", "speedbands"))
def q_compacted(spark, d):
    """Two columns kept, narrowed and rewritten."""
    return TB.compact(fx.speedbands(spark, d), _folder(spark, "slim"), {"link_id": "int", "speed_band": "smallint"}, files=4)


@register("table_replaced_from_itself", with_views("""
    SELECT station_id, lat, lon, COUNT(*) OVER () AS stations FROM rain_stations WHERE lat > 1.3e0""", "rain_stations"))
def q_replaced(spark, d):
    """A table replaced by a query over itself, twice."""
    name = f"stations_{uuid.uuid4().hex[:8]}"
    TB.replace_table(fx.rain_stations(spark, d).select("station_id", "lat", "lon"), name)
    TB.replace_table(spark.table(name).filter(F.col("lat") > F.lit(1.3)), name)
    return TB.replace_table(spark.table(name).withColumn("stations", F.lit(spark.table(name).count()).cast("bigint")), name)


@register("speedbands_export_job", with_views("""
    SELECT CAST(user_id AS INTEGER) AS link_id, CAST(FLOOR(epoch(ts) / 300) * 300 AS BIGINT) AS snapshot_ts,
           min_by(CAST(FLOOR(value) AS INTEGER) % 10, FLOOR(epoch(ts)) * 100 + CAST(FLOOR(value) AS INTEGER) % 10) AS speed_band
    FROM events GROUP BY 1, 2"""))
def q_export_job(spark, d):
    """S21 as the chain's job, from the feed-shaped table: epoch buckets, integer ids, first poll per (link, bucket)."""
    return jobs.speedbands_export(fx.traffic_tables(spark, d)["speedbands"])


_LABELS = {"change": "CASE WHEN y_tp15 <> sb THEN 1e0 ELSE 0e0 END", "direction": "CASE WHEN y_tp15 < sb THEN 1e0 ELSE 0e0 END",
           "rise": "CAST(GREATEST(y_tp15 - sb, 0) AS DOUBLE)", "drop": "CAST(GREATEST(sb - y_tp15, 0) AS DOUBLE)", "class": "CAST(y_tp15 - 1 AS DOUBLE)"}


@register("label_table", with_views(f"""
    SELECT {', '.join(KEYS)}, {', '.join(f'{sql} AS label_{k}' for k, sql in _LABELS.items())},
           CASE WHEN incident_nearby = 1 THEN 5e0 ELSE 1e0 END AS weight FROM predictions""", "predictions"))
def q_label_table(spark, d):
    """M1-M4 labels and M5 weights of every row."""
    p = fx.predictions(spark, d)
    for kind in _LABELS:
        p = M.label(p, kind, out=f"label_{kind}")
    return M.incident_weight(p).select(*KEYS, *[f"label_{k}" for k in _LABELS], "weight")


_GATE = """true_change, true_down, true_up, gk_pred_25, gk_pred_30, gk_pred_35, gk_pred_40, gk_pred_25 * (1 - true_change) AS is_fp,
           gk_pred_25 * true_change AS is_tp"""
_GATE_SQL = """
    SELECT *, CAST(y_tp15 <> sb AS INTEGER) AS true_change, CAST(y_tp15 < sb AS INTEGER) AS true_down, CAST(y_tp15 > sb AS INTEGER) AS true_up,
           CAST(gk_prob >= 0.25e0 AS INTEGER) AS gk_pred_25, CAST(gk_prob >= 0.3e0 AS INTEGER) AS gk_pred_30,
           CAST(gk_prob >= 0.35e0 AS INTEGER) AS gk_pred_35, CAST(gk_prob >= 0.4e0 AS INTEGER) AS gk_pred_40 FROM predictions"""


def _gated(spark, d):
    return M.gate_table(fx.predictions(spark, d).withColumnRenamed("gk_prob", "score"))


@register("gate_table", with_views(f"""
    SELECT {', '.join(KEYS)}, ROUND(CAST(gk_prob AS DOUBLE), 5) AS gk_prob, {_GATE} FROM gated""", "predictions", extra={"gated": _GATE_SQL}))
def q_gate_table(spark, d):
    """M13 over pseudo-scores."""
    flags = ["true_change", "true_down", "true_up", "gk_pred_25", "gk_pred_30", "gk_pred_35", "gk_pred_40", "is_fp", "is_tp"]
    return _gated(spark, d).select(*KEYS, F.round(F.col("gk_prob").cast("double"), 5).alias("gk_prob"), *[F.col(c).cast("int").alias(c) for c in flags])


@register("router_table", with_views(f"""
    SELECT {', '.join(KEYS)}, ROUND(CAST(router_prob AS DOUBLE), 5) AS router_prob, CAST(router_prob >= 0.5e0 AS INTEGER) AS router_pred,
           CAST((router_prob >= 0.5e0) = (true_down = 1) AS INTEGER) AS router_correct, ROUND(ABS(router_prob - 0.5e0), 5) AS router_margin
    FROM gated WHERE gk_pred_25 = 1""", "predictions", extra={"gated": _GATE_SQL}))
def q_router_table(spark, d):
    """M14 over pseudo-scores, for rows the gate lets pass."""
    r = M.router_table(_gated(spark, d).filter("gk_pred_25 = 1").withColumnRenamed("router_prob", "score"))
    return r.select(*KEYS, F.round(F.col("router_prob").cast("double"), 5).alias("router_prob"), F.col("router_pred").cast("int").alias("router_pred"),
                    F.col("router_correct").cast("int").alias("router_correct"), F.round("router_margin", 5).alias("router_margin"))


@register("flag_rates", with_views("""
    SELECT incident_nearby, COUNT(*) AS rows, CAST(SUM(CASE WHEN y_tp15 <> sb THEN 1 ELSE 0 END) AS BIGINT) AS changed_count,
           AVG(CASE WHEN y_tp15 <> sb THEN 1e0 ELSE 0e0 END) AS changed_rate FROM predictions GROUP BY incident_nearby""", "predictions"))
def q_flag_rates(spark, d):
    """A5 by group."""
    p = fx.predictions(spark, d).withColumn("changed", (F.col("y_tp15") != F.col("sb")).cast("int"))
    return A.rate(p, "changed", by="incident_nearby")


_KM = """2e0 * 6371000e0 * ATAN2(SQRT(a), SQRT(1e0 - a))"""


@register("distance_cutoffs", with_views(f"""
    SELECT link_id, ROUND(dist, 3) AS dist_m, dist <= 2000e0 AS near, dist > 5000e0 AS far FROM (
        SELECT link_id, {_KM} AS dist FROM (
            SELECT link_id, POW(SIN(RADIANS(1.3e0 - la) / 2), 2) + COS(RADIANS(la)) * COS(RADIANS(1.3e0)) * POW(SIN(RADIANS(103.8e0 - lo) / 2), 2) AS a
            FROM (SELECT link_id, (start_lat + end_lat) / 2 AS la, (start_lon + end_lon) / 2 AS lo FROM links)))""", "links"))
def q_distance_cutoffs(spark, d):
    """F8 on the distance of every link's middle from a fixed point."""
    x = fx.links(spark, d).withColumns({"la": midpoint("start_lat", "end_lat"), "lo": midpoint("start_lon", "end_lon")})
    x = x.withColumn("dist", haversine_m("la", "lo", F.lit(1.3), F.lit(103.8)))
    return x.select("link_id", F.round("dist", 3).alias("dist_m"), FL.within("dist", 2000).alias("near"), FL.beyond("dist", 5000).alias("far"))


@register("message_texts", with_views("SELECT src_id, message FROM incident_snapshots", "incident_snapshots"))
def q_message_texts(spark, d):
    """P5 on every sighting's message."""
    return fx.incident_snapshots(spark, d).select("src_id", text_or_null("message").alias("message"))


@register("required_columns", with_views("""
    SELECT n.missing, COUNT(*) AS rows FROM speedbands, (SELECT UNNEST(['rain_mm', 'is_peak']) AS missing) n GROUP BY n.missing""", "speedbands"))
def q_required_columns(spark, d):
    """Which of the columns a model wants are absent, and from how many rows."""
    s = fx.speedbands(spark, d)
    absent = require_columns(s, ["link_id", "rain_mm", "speed_band", "is_peak"])
    return s.select(F.explode(F.array(*[F.lit(c) for c in absent])).alias("missing")).groupBy("missing").agg(F.count("*").alias("rows"))


_TAKE = "ORDER BY ({h}), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000".format(h=PH_KEYS)


@register("union_class_sample_rows", with_views(f"""
    SELECT * FROM (SELECT {', '.join(KEYS)}, 1 AS changed FROM predictions WHERE y_tp15 <> sb {_TAKE})
    UNION ALL SELECT * FROM (SELECT {', '.join(KEYS)}, 0 AS changed FROM predictions WHERE y_tp15 = sb {_TAKE})""", "predictions"))
def q_union_rows(spark, d):
    """U1 over two fixed-size samples, row by row."""
    p = fx.predictions(spark, d).withColumn("changed", (F.col("y_tp15") != F.col("sb")).cast("int"))
    parts = [R.sample_n(p, 2000, KEYS, F.col("changed") == k, before_filter=False).select(*KEYS, "changed") for k in (1, 0)]
    return R.union_all(*parts)


@register("stream_first_polls", with_views("""
    SELECT station_id, reading_ts, min_by(value_mm, src_id) AS value_mm FROM rain GROUP BY station_id, reading_ts""", "rain"))
def q_stream_first_polls(spark, d):
    """T2 by poll, not by arrival: every reading lands twice, the later poll (of another value) first; the earlier poll's value is kept."""
    root = ST.stream_workspace(spark, "first_polls")
    r = fx.rain(spark, d).withColumn("poll", F.col("src_id"))
    again = r.withColumns({"poll": F.col("poll") + 10 ** 9, "value_mm": F.col("value_mm") + 1000})
    schema = "station_id string, reading_ts long, value_mm double, poll long"
    for part in (again, r):
        ST.land_json(part.select("station_id", "reading_ts", "value_mm", "poll"), f"{root}/in")
        s = spark.readStream.schema(schema).json(f"{root}/in").withColumn("day", F.floor(F.col("reading_ts") / 86400).cast("int"))
        ST.stream_first_per_key(s, ["station_id", "reading_ts"], ["poll"], "day", f"{root}/out", f"{root}/ckpt")
    return ST.first_rows(spark, ["station_id", "reading_ts"], ["poll"], f"{root}/out").select("station_id", "reading_ts", "value_mm")
