"""Feed ingest on hand-made files: the unit cases FIXTURES.md §1 asks for."""

import json
import os

from pyspark.sql import functions as F

from bandcast.operators.aggregates import first_per_key
from bandcast.sources import feeds as FD
from bandcast.sources import tables as TB


def write(path, doc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))


def test_read_feed_missing_empty_and_bad_band(spark, tmp_path):
    root = tmp_path / "speed"
    item = {"LinkID": "1", "RoadName": "A", "RoadCategory": None, "SpeedBand": "x", "MinimumSpeed": "",
            "MaximumSpeed": 30, "StartLat": "1.3", "StartLon": "103.8", "EndLat": "1.31", "EndLon": "103.81"}
    write(str(root / "snapshot=100" / "p1.json"), {"value": [item, {**item, "LinkID": "2", "SpeedBand": 4}]})
    write(str(root / "snapshot=100" / "p2.json"), {"value": []})
    write(str(root / "snapshot=200" / "p1.json"), {"odata": "no value here"})
    raw = FD.read_feed(spark, str(root), FD.SPEED_ITEM)
    out = FD.normalize_speedbands(FD.stamp_snapshot(raw, F.col("snapshot").cast("string")))
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == [("1", None, None, 30, "100"), ("2", 4, None, 30, "100")]
    roads = FD.road_link_rows(FD.stamp_snapshot(raw, F.col("snapshot").cast("string"))).collect()
    assert {r.road_category for r in roads} == {"None"}


def test_first_version_wins(spark):
    dim = spark.createDataFrame([("1", "Old")], "link_id string, road_name string")
    new = spark.createDataFrame([("1", "New", "t1"), ("2", "Second", "t2"), ("2", "First", "t1")],
                                "link_id string, road_name string, snapshot_time string")
    out = {r.link_id: r.road_name for r in FD.upsert_first(dim, new, "link_id").collect()}
    assert out == {"1": "Old", "2": "First"}


def test_first_in_feed_order_wins(spark):
    item = {"LinkID": "1", "RoadName": "Zebra", "StartLat": "1", "StartLon": "2", "EndLat": "3", "EndLon": "4"}
    pages = [("t1", 0, json.dumps({"value": [item, {**item, "RoadName": "Alpha"}]})),
             ("t1", 1, json.dumps({"value": [{**item, "RoadName": "Aa"}, {**item, "LinkID": "2", "RoadName": "Two"}]}))]
    raw = FD.parse_feed(spark.createDataFrame(pages, "snapshot_time string, page int, json string"), FD.SPEED_ITEM, position="pos")
    rows = FD.road_link_rows(raw, keep=["page", "pos"])
    out = {r.link_id: r.road_name for r in FD.upsert_first(None, rows, "link_id", ["snapshot_time", "page", "pos"]).collect()}
    assert out == {"1": "Zebra", "2": "Two"}
    doc = {"data": {"readings": [{"timestamp": "r1", "data": [{"stationId": "S1", "value": 7}, {"stationId": "S1", "value": 2}]}]}}
    df = spark.createDataFrame([("t1", json.dumps(doc))], "snapshot_time string, json string")
    rd = FD.normalize_rainfall(df, position="pos")
    assert [r.value_mm for r in first_per_key(rd, ["station_id", "reading_time"], ["snapshot_time", "pos"]).collect()] == [7.0]


def test_replace_table_and_file_count(spark, tmp_path):
    a = spark.range(10).withColumn("snapshot_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert TB.replace_table(a.select("id"), "replaced_by_query").count() == 10
    assert TB.replace_table(a.select("id").filter("id < 3"), "replaced_by_query").count() == 3
    spark.sql("DROP TABLE replaced_by_query")
    TB.append_fact(a.repartition(8), str(tmp_path / "fact"), entity="id", files_per_date=2)
    assert spark.read.parquet(str(tmp_path / "fact")).count() == 10
    assert len(list((tmp_path / "fact").glob("*/*.parquet"))) <= 2


def _alerts(spark, docs):
    df = spark.createDataFrame([(f"t{i}", json.dumps(d)) for i, d in enumerate(docs)], "snapshot_time string, json string")
    return FD.flatten_alerts(df).collect()


def test_alert_shapes(spark):
    obj = {"value": {"Status": 2, "FreePublicBus": "Yes", "FreeMRTShuttle": "No",
                     "Line": [{"Line": "EW", "Direction": "x", "Stations": "A,B", "MRTShuttleDirection": "y"},
                              {"Line": "NS", "Direction": "z", "Stations": "C"}],
                     "Message": [{"Content": "first", "CreatedDate": "d1"}, {"Content": "second", "CreatedDate": "d2"}]}}
    no_msg = {"value": {"Status": 1, "Line": [{"Line": "CC"}]}}
    msg_only = {"value": {"Status": 1, "Line": [], "Message": [{"Content": "m"}]}}
    as_list = {"value": [{"Status": "1", "Line": "DT", "Message": "listed"}]}
    null = {"value": None}
    rows = _alerts(spark, [obj, no_msg, msg_only, as_list, null])
    got = sorted((r.line, r.status, r.message, r.free_bus) for r in rows)
    assert got == [("CC", 1, None, None), ("DT", 1, "listed", None), ("EW", 2, "first", "Yes"),
                   ("NS", 2, "first", "Yes")]


def test_stations_and_rainfall(spark):
    doc = {"data": {"stations": [{"id": "S1", "name": "one", "labelLocation": {"latitude": 1.3, "longitude": 103.8}},
                                 {"id": "S2", "name": "two"}],
                    "readings": [{"timestamp": "r1", "data": [{"stationId": "S1", "value": 0.2},
                                                              {"stationId": "S2", "value": 0}]},
                                 {"timestamp": "r2", "data": [{"stationId": "S1", "value": 1}]}]}}
    again = {"data": {"stations": [], "readings": [{"timestamp": "r2", "data": [{"stationId": "S1", "value": 9}]}]}}
    df = spark.createDataFrame([("t1", json.dumps(doc)), ("t2", json.dumps(again))], "snapshot_time string, json string")
    st = {r.station_id: (r.lat, r.lon) for r in FD.normalize_stations(df).collect()}
    assert st == {"S1": (1.3, 103.8), "S2": (None, None)}
    rd = FD.normalize_rainfall(df)
    assert rd.count() == 4
    dedup = {(r.station_id, r.reading_time): r.value_mm for r in
             first_per_key(rd, ["station_id", "reading_time"], ["snapshot_time", "value_mm"]).collect()}
    assert dedup == {("S1", "r1"): 0.2, ("S2", "r1"): 0.0, ("S1", "r2"): 1.0}


def test_update_by_key_skips_falsy_and_unknown(spark):
    dim = spark.createDataFrame([("S1", 1.0, 2.0), ("S2", 1.0, 2.0), ("S3", 1.0, 2.0)], "station_id string, lat double, lon double")
    upd = spark.createDataFrame([("S1", 5.0, 6.0), ("S2", 0.0, 6.0), ("S3", 5.0, None), ("S9", 5.0, 6.0)],
                                "station_id string, lat double, lon double")
    new, cnt = FD.update_by_key(dim, upd, "station_id", ["lat", "lon"])
    assert {r.station_id: (r.lat, r.lon) for r in new.collect()} == {"S1": (5.0, 6.0), "S2": (1.0, 2.0), "S3": (1.0, 2.0)}
    assert cnt.first().updated == 1


def test_isolate_batches(spark):
    raw = spark.createDataFrame([("t1", "1.0"), ("t1", "bad"), ("t2", "2.0")], "snapshot_time string, Latitude string")
    good, bad = FD.isolate_batches(raw, {"Latitude": "double"})
    assert [r.snapshot_time for r in good.collect()] == ["t2"]
    assert bad.count() == 2


def test_sinks_append_compact_view(spark, tmp_path):
    df = spark.createDataFrame([("1", 3, "2024-01-01T00:05:00+00:00"), ("2", 4, "2024-01-02T00:05:00+00:00")],
                               "link_id string, speed_band int, snapshot_time string")
    df = df.withColumn("snapshot_time", F.to_timestamp("snapshot_time"))
    fact = str(tmp_path / "fact")
    TB.append_fact(df, fact, entity="link_id")
    TB.append_fact(df, fact, entity="link_id")
    back = spark.read.parquet(fact)
    assert back.count() == 4 and "snapshot_date" in back.columns
    slim = TB.compact(back, str(tmp_path / "slim"), {"link_id": "int", "speed_band": "tinyint"}, files=1)
    assert dict(slim.dtypes) == {"link_id": "int", "speed_band": "tinyint"}
    TB.register_view(slim, "slim_v")
    assert spark.sql("SELECT SUM(speed_band) AS s FROM slim_v").first().s == 14
    TB.write_table(slim, str(tmp_path / "snappy"), codec=None)
    assert spark.read.parquet(str(tmp_path / "snappy")).count() == 4


def test_stream_ingest_quarantines_failing_poll(spark, tmp_path):
    from pyspark.sql import types as T
    from bandcast.streaming import streams as ST
    root = tmp_path / "incidents"
    good = {"Type": "Accident", "Latitude": "1.30", "Longitude": "103.8", "Message": "m"}
    write(str(root / "snapshot=100" / "p1.json"), {"value": [good, {**good, "Message": "n"}]})
    write(str(root / "snapshot=200" / "p1.json"), {"value": [good, {**good, "Latitude": "north"}]})
    write(str(root / "snapshot=300" / "p1.json"), {"value": [good]})
    raw = ST.stream_feed(spark, str(root), FD.INCIDENT_ITEM, partition=T.StructField("snapshot", T.LongType()))
    raw = raw.withColumn("snapshot_time", F.to_timestamp(F.col("snapshot").cast("timestamp")))
    ST.stream_ingest(raw, FD.normalize_incidents, {"Latitude": "double", "Longitude": "double"},
                     str(tmp_path / "fact"), str(tmp_path / "quarantine"), str(tmp_path / "ckpt"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    assert fact.count() == 3 and fact.filter(F.col("lat").isNull()).count() == 0
    q = spark.read.parquet(str(tmp_path / "quarantine"))
    assert q.count() == 2 and {r.snapshot for r in q.collect()} == {200}
