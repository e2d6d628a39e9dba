"""The artifact chain end to end on sf0.001: every artifact is written and
non-empty where the data allows, and stages agree with the operators."""

import os

from bandcast import jobs
from bandcast.plans import fixtures as fx
from tests.conftest import SF001


def test_run_all(spark, tmp_path):
    tables = fx.traffic_tables(spark, SF001)
    out = jobs.run_all(spark, tables, str(tmp_path), start_ts=1704067200, days=21, sample_frac=0.5,
                       maxIter=5, maxDepth=3)
    for name in ["road_links", "speedbands_export", "incidents_cleaned", "link_neighbors_200m",
                 "incidents_road_mapped", "incident_impacted_links_200m", "incident_nearby_buckets_200m",
                 "link_station_mapping", "weather_features", "features", "master_features", "cascade_reports"]:
        assert os.path.isdir(tmp_path / name), name
    assert os.path.isdir(tmp_path / "models" / "gatekeeper")
    cleaned = spark.read.parquet(str(tmp_path / "incidents_cleaned"))
    assert cleaned.count() == jobs.incidents_cleaned(tables["traffic_incidents"]).count()
    links = spark.read.parquet(str(tmp_path / "road_links"))
    assert spark.read.parquet(str(tmp_path / "link_station_mapping")).count() == links.count()
    for r in out["cascade_reports"].collect():
        assert r.total >= r.gate_caught >= r.routed_caught >= r.final_caught
