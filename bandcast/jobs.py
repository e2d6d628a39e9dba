"""The reference's artifact chain as Spark jobs, on the traffic table schemas
(FIXTURES.md §1): each function builds one artifact from DataFrames, and
``run_all`` writes every artifact as a parquet table in a shared output
folder and reads it back, so each stage starts from a written table (lineage
is cut by storage, and a lost executor never replays the whole chain).

Artifacts: road_links, speedbands export, incidents_cleaned,
link_neighbors_200m, incidents_road_mapped, incident_impacted_links_200m,
incident_nearby_buckets_200m, link_station_mapping, weather_features,
features (21-day), master_features, gatekeeper/router predictions, models,
and the cascade reports.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandcast.functions.scalars import flag, midpoint, parse_utc, time_bucket, to_epoch
from bandcast.operators import cascade as C
from bandcast.operators import spatial as SP
from bandcast.operators import training as M
from bandcast.operators.aggregates import dense_ids, first_per_key
from bandcast.operators.features import FEATURES, feature_table, model_frame
from bandcast.operators.filters import row_class, split_side
from bandcast.operators.joins import broadcast_if_small
from bandcast.operators.lifecycle import incident_lifecycles
from bandcast.operators.sampling import balanced, chrono_split, hash_sample, keep_or_sample
from bandcast.operators.temporal import asof_join, interval_bucket_rollup
from bandcast.session import cut_lineage
from bandcast.sources.tables import write_table

KEYS = ["link_id", "snapshot_ts"]


def road_links_table(road_links: DataFrame) -> DataFrame:
    """Integer link ids and midpoints."""
    return road_links.withColumns({
        "link_id": F.col("link_id").cast("int"),
        "mid_lat": midpoint("start_lat", "end_lat"),
        "mid_lon": midpoint("start_lon", "end_lon"),
    })


def speedbands_export(speedbands: DataFrame) -> DataFrame:
    """Epoch 5-minute bucket, integer link id, first poll per (link, bucket)."""
    s = speedbands.select(F.col("link_id").cast("int").alias("link_id"), "speed_band",
                          to_epoch(parse_utc("snapshot_time")).alias("_t"))
    s = s.withColumn("snapshot_ts", time_bucket("_t"))
    return first_per_key(s, ["link_id", "snapshot_ts"], ["_t", "speed_band"]).select("link_id", "snapshot_ts", "speed_band")


def incidents_cleaned(traffic_incidents: DataFrame, max_gap_min: float = 15.0, max_dist_m: float = 200.0,
                      **kw) -> DataFrame:
    """W5 on the incident snapshots.  Source order inside one poll (the
    store's insertion order) is not in the data, so ties are broken by the
    row content: a row number per poll (one poll per window partition)."""
    t = traffic_incidents.withColumn("ts", to_epoch(parse_utc("snapshot_time")))
    w = Window.partitionBy("ts").orderBy("type", "lat", "lon", "message")
    t = t.withColumn("src_id", F.col("ts") * (1 << 31) + F.row_number().over(w))
    lc = incident_lifecycles(t, max_gap_min, max_dist_m, **kw)
    # 1..N in creation order (first sighting time, then source order)
    return dense_ids(lc, ["start_ts", "incident_id"], out="incident_seq")


def link_neighbors(links: DataFrame, max_m: float = 200.0) -> DataFrame:
    """J10 (the absent producer of link_neighbors_200m), narrowed to int32."""
    n = SP.neighbors_within(links, "link_id", max_m, "mid_lat", "mid_lon")
    return n.select(F.col("link_id").cast("int"), F.col("neighbor_link_id").cast("int"))


def incidents_road_mapped(cleaned: DataFrame, links: DataFrame, max_m: float = 200.0) -> DataFrame:
    """Each incident with its single nearest link within ``max_m``."""
    return SP.nearest_within(cleaned, links, "incident_id", "link_id", max_m, out="nearest_link_id",
                             r_lat="mid_lat", r_lon="mid_lon").drop("nearest_link_id_dist_m")


def impacted_links(cleaned: DataFrame, links: DataFrame, neighbors: DataFrame, k: int = 5,
                   max_m: float = 200.0) -> DataFrame:
    """J9 + J12: the k nearest links within ``max_m`` of each incident plus
    their neighbours, distinct per incident."""
    carry = ["start_ts", "end_ts", "type"]
    a = SP.knn_within(cleaned, links, "incident_id", "link_id", k, max_m, r_lat="mid_lat", r_lon="mid_lon",
                      carry=carry)
    return SP.expand_one_hop(a, neighbors, "incident_id", carry=carry).select("link_id", *carry, "incident_id")


def nearby_buckets(impacted: DataFrame) -> DataFrame:
    """W7 + A3."""
    return interval_bucket_rollup(impacted)


def station_mapping(links: DataFrame, stations: DataFrame) -> DataFrame:
    """Nearest rain station of every link midpoint."""
    m = SP.nearest(links, stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()),
                   "link_id", "station_id", l_lat="mid_lat", l_lon="mid_lon")
    return m.select("link_id", F.col("station_id").alias("nearest_station_id"))


def rain_readings(rainfall: DataFrame) -> DataFrame:
    """S11 + epoch reading time: one reading per (station, time), first poll wins."""
    r = rainfall.withColumns({"reading_ts": to_epoch(parse_utc("reading_time")),
                              "_poll": to_epoch(parse_utc("snapshot_time"))})
    return first_per_key(r.select("station_id", "reading_ts", "value_mm", "_poll"),
                         ["station_id", "reading_ts"], ["_poll", "value_mm"]).drop("_poll")


def weather_features(mapping: DataFrame, rainfall: DataFrame) -> DataFrame:
    """J7 + P7."""
    r = rain_readings(rainfall)
    j = mapping.join(r, mapping["nearest_station_id"] == r["station_id"]).drop("station_id")
    return j.select("link_id", "reading_ts", F.col("value_mm").alias("rain_mm"),
                    flag(F.col("value_mm") > 0).alias("is_raining"))


def features(speed: DataFrame, links: DataFrame, mapped: DataFrame, start_ts: int, days: int = 21,
             **kw) -> DataFrame:
    """The 21-day feature table (range inclusive at both ends)."""
    inc = mapped.select(F.col("nearest_link_id").alias("link_id"), "start_ts", "end_ts", "type")
    return feature_table(speed, links, inc, start_ts, start_ts + days * 86400, **kw)


def master_features(feats: DataFrame, mapping: DataFrame, rainfall: DataFrame, tolerance_s: int = 1800) -> DataFrame:
    """Rain as of each feature row (latest reading at most ``tolerance_s`` old)."""
    m = feats.join(broadcast_if_small(mapping.withColumnRenamed("nearest_station_id", "station_id")), "link_id", "left")
    m = asof_join(m, rain_readings(rainfall), "station_id", "snapshot_ts", "reading_ts", ["value_mm"],
                  tolerance=tolerance_s)
    return m.withColumnRenamed("value_mm", "rain_mm").withColumn("is_raining", flag(F.col("rain_mm") > 0)) \
        .drop("station_id", "reading_ts_matched")


def train_and_score(master: DataFrame, links: DataFrame, buckets: DataFrame, model_dir: str,
                    sample_frac: float = 0.1, per_class: int | None = 500_000, eval_frac: float = 1.0,
                    **gbt) -> dict[str, DataFrame]:
    """Split 80/20 by time, train the gatekeeper (incident rows + a
    ``sample_frac`` hash sample), the router (a ``sample_frac`` sample of
    changed rows) and both specialists (balanced, ``per_class`` each), save
    them, and return the scored test set with the cascade applied.
    ``eval_frac`` < 1 evaluates a hash sample of the test rows (the reference
    used 0.1); the default keeps every test row.  ``per_class`` is the
    reference's own bound on the rows each regressor trains on; None trains on
    every row that moved its way and every stable row."""
    frame, feats = cut_lineage(model_frame(master, links, buckets)), list(FEATURES)     # read by four trainings and the test
    t = chrono_split(frame)
    train, test = split_side(frame, t, "train"), split_side(frame, t, "test")
    if eval_frac < 1.0:
        test = hash_sample(test, KEYS, eval_frac, seed=7)

    def specialist(kind: str, cls: str):
        both = row_class(train, cls).withColumn("_c", F.lit(1)).unionByName(
            row_class(train, "stable").withColumn("_c", F.lit(0)))
        both = both if per_class is None else balanced(both, "_c", per_class, KEYS)
        return M.fit_regressor(M.label(both, kind), feats, **gbt)

    gate, router, descent, ascent = M.fit_together(
        lambda: M.fit_classifier(M.label(keep_or_sample(train, F.col("incident_nearby") == 1, KEYS, sample_frac),
                                         "change"), feats, **gbt),
        lambda: M.fit_classifier(M.label(hash_sample(row_class(train, "change"), KEYS, sample_frac), "direction"),
                                 feats, **gbt),
        lambda: specialist("drop", "fall"), lambda: specialist("rise", "rise"))
    spec = {"descent": descent, "ascent": ascent}
    for name, model in (("gatekeeper", gate), ("router", router), *spec.items()):
        M.save(model, os.path.join(model_dir, name))
    cascade = C.apply_cascade(test, gate, router, spec["descent"], spec["ascent"])
    return {"cascade": cascade}


ROUTER_COLUMNS = ["router_prob", "router_pred", "router_correct", "router_margin", "route"]


def prediction_tables(cascade: DataFrame) -> dict[str, DataFrame]:
    """M13 and M14 as tables of their own: columns of the written cascade, nothing scored again."""
    later = [c for c in cascade.columns if c not in ("pred_mag", "strict_alert", "jam_mag", "rise_mag")]
    return {"gatekeeper_predictions": cascade.select(*[c for c in later if c not in ROUTER_COLUMNS]),
            "router_predictions": cascade.select(*later)}


def cascade_reports(cascade: DataFrame) -> DataFrame:
    """C3 funnel per direction plus E8 alert reports, one table."""
    out = []
    for direction, mag in (("descent", "jam_mag"), ("ascent", "rise_mag")):
        x = cascade.withColumns({"routed": flag(F.col("route") == direction),
                                 "final": flag((F.col("route") == direction) & (F.col("strict_alert") == 1))})
        out.append(C.funnel(x, mag, routed="routed", alert="final").withColumn("direction", F.lit(direction)))
    return out[0].unionByName(out[1])


def run_all(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, start_ts: int, days: int = 21,
            sample_frac: float = 0.1, **gbt) -> dict[str, DataFrame]:
    """Build every artifact in order; each is written to ``out_dir`` and
    re-read before the next stage uses it.  ``tables``: road_links,
    speedbands, traffic_incidents, rainfall_stations, rainfall."""
    def keep(name: str, df: DataFrame) -> DataFrame:
        path = os.path.join(out_dir, name)
        write_table(df, path)
        return spark.read.parquet(path)

    links = keep("road_links", road_links_table(tables["road_links"]))
    speed = keep("speedbands_export", speedbands_export(tables["speedbands"]))
    cleaned = keep("incidents_cleaned", incidents_cleaned(tables["traffic_incidents"]))
    nbrs = keep("link_neighbors_200m", link_neighbors(links))
    mapped = keep("incidents_road_mapped", incidents_road_mapped(cleaned, links))
    impacted = keep("incident_impacted_links_200m", impacted_links(cleaned, links, nbrs))
    buckets = keep("incident_nearby_buckets_200m", nearby_buckets(impacted))
    mapping = keep("link_station_mapping", station_mapping(links, tables["rainfall_stations"]))
    keep("weather_features", weather_features(mapping, tables["rainfall"]))
    feats = keep("features", features(speed, links, mapped, start_ts, days))
    master = keep("master_features", master_features(feats, mapping, tables["rainfall"]))
    scored = train_and_score(master, links, buckets, os.path.join(out_dir, "models"), sample_frac=sample_frac, **gbt)
    out = {k: keep(k, v) for k, v in scored.items()}
    out |= {k: keep(k, v) for k, v in prediction_tables(out["cascade"]).items()}
    out["cascade_reports"] = keep("cascade_reports", cascade_reports(out["cascade"]))
    return out


TABLE_NAMES = ("road_links", "speedbands", "traffic_incidents", "rainfall_stations", "rainfall")


def main(argv: list[str] | None = None) -> None:
    """``python -m bandcast.jobs --input DIR --output DIR --start EPOCH [--days 21]``

    Reads ``DIR/<table>.parquet`` (or a folder / glob of that name) for the
    five traffic tables and builds every artifact under ``--output`` (a
    shared path on a cluster).  The session comes from the launcher."""
    import argparse

    from bandcast.session import get_session
    from bandcast.sources.tables import read_table

    p = argparse.ArgumentParser(prog="bandcast.jobs")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--start", type=int, required=True, help="first snapshot epoch of the feature window")
    p.add_argument("--days", type=int, default=21)
    p.add_argument("--rounds", type=int, default=465, help="boosting rounds")
    a = p.parse_args(argv)
    spark = get_session()
    tables = {n: read_table(spark, a.input, n) for n in TABLE_NAMES}
    out = run_all(spark, tables, a.output, a.start, a.days, maxIter=a.rounds)
    out["cascade_reports"].show(truncate=False)


if __name__ == "__main__":
    main()
