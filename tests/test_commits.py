"""Sinks that survive retries: batches visible together, replays, polls over several micro-batches, self-reading replace."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandcast.sources import feeds as FD
from bandcast.sources import tables as TB
from bandcast.sources.commits import BatchLog
from bandcast.streaming import streams as ST

GOOD = {"Type": "Accident", "Latitude": "1.30", "Longitude": "103.8", "Message": "m"}
STRICT = {"Latitude": "double", "Longitude": "double"}


def land(root, poll, name, items):
    folder = root / f"snapshot={poll}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"value": items}))


def ingest(spark, tmp_path, **kw):
    raw = ST.stream_feed(spark, str(tmp_path / "in"), FD.INCIDENT_ITEM, partition=T.StructField("snapshot", T.LongType()),
                         max_files_per_trigger=kw.pop("files", None))
    raw = raw.withColumn("snapshot_time", F.to_timestamp(F.col("snapshot").cast("timestamp")))
    ST.stream_ingest(raw, FD.normalize_incidents, STRICT, str(tmp_path / "fact"), str(tmp_path / "quarantine"), str(tmp_path / "ckpt"), **kw)


def seen(spark, tmp_path):
    facts, bad = ST.ingested(spark, str(tmp_path / "fact"), str(tmp_path / "quarantine"))
    return sorted(r.message for r in facts.collect()), sorted(r.snapshot for r in bad.collect())


def test_a_batch_killed_between_its_writes_leaves_no_duplicate(spark, tmp_path, monkeypatch):
    land(tmp_path / "in", 100, "a.json", [GOOD, {**GOOD, "Message": "n"}])
    land(tmp_path / "in", 200, "a.json", [GOOD, {**GOOD, "Latitude": "north"}])
    whole, write, commit = [], BatchLog.write, BatchLog.commit

    def killed(self, df, table, *a, **kw):
        if table.endswith("quarantine") and not whole:
            whole.append(1)
            raise RuntimeError("killed")
        return write(self, df, table, *a, **kw)
    monkeypatch.setattr(BatchLog, "write", killed)
    with pytest.raises(Exception, match="killed"):
        ingest(spark, tmp_path)
    assert ST.ingested(spark, str(tmp_path / "fact"), str(tmp_path / "quarantine")) == (None, None)
    assert spark.read.parquet(str(tmp_path / "fact")).count() == 2          # written, but not visible to readers
    ingest(spark, tmp_path)
    assert seen(spark, tmp_path) == (["m", "n"], [200, 200])
    # killed after the commit, before the stream's own checkpoint: the batch is not run again
    monkeypatch.setattr(BatchLog, "commit", lambda self, *a, **kw: (commit(self, *a, **kw), whole.append(2), 1 / (len(whole) - 2))[0])
    land(tmp_path / "in", 300, "a.json", [{**GOOD, "Message": "o"}])
    with pytest.raises(Exception, match="division"):
        ingest(spark, tmp_path)
    monkeypatch.setattr(BatchLog, "commit", commit)
    ingest(spark, tmp_path)
    land(tmp_path / "in", 400, "a.json", [{**GOOD, "Message": "p"}])
    ingest(spark, tmp_path, files_per_date=2)
    assert seen(spark, tmp_path) == (["m", "n", "o", "p"], [200, 200])


def test_a_poll_over_several_batches_is_judged_whole(spark, tmp_path):
    for name, items in (("a", [GOOD]), ("b", [{**GOOD, "Longitude": "east"}]), ("c", [GOOD])):
        land(tmp_path / "in", 100, f"{name}.json", items)
        ingest(spark, tmp_path, hold_newest=True)
    land(tmp_path / "in", 200, "a.json", [{**GOOD, "Message": "good"}])
    ingest(spark, tmp_path, hold_newest=True)
    assert seen(spark, tmp_path) == ([], [100, 100, 100])
    land(tmp_path / "in", 200, "b.json", [{**GOOD, "Message": "good too"}])
    ingest(spark, tmp_path, hold_newest=True)
    for _ in range(2):              # a second release finds nothing
        ST.release_held(spark, FD.normalize_incidents, STRICT, str(tmp_path / "fact"), str(tmp_path / "quarantine"))
    assert seen(spark, tmp_path) == (["good", "good too"], [100, 100, 100])
    land(tmp_path / "in", 300, "a.json", [{**GOOD, "Message": "next"}])
    land(tmp_path / "in", 400, "a.json", [{**GOOD, "Message": "held"}])
    ingest(spark, tmp_path, hold_newest=True)
    assert seen(spark, tmp_path) == (["good", "good too", "next"], [100, 100, 100])


def test_later_rows_of_a_failed_poll_are_quarantined(spark, tmp_path):
    land(tmp_path / "in", 100, "a.json", [{**GOOD, "Longitude": "east"}])
    ingest(spark, tmp_path)
    land(tmp_path / "in", 100, "b.json", [GOOD])
    land(tmp_path / "in", 200, "a.json", [GOOD])
    ingest(spark, tmp_path)
    assert seen(spark, tmp_path) == (["m"], [100, 100])


def test_append_by_batch_replaces_its_own_rows(spark, tmp_path):
    df = spark.createDataFrame([("1", 3), ("2", 4)], "link_id string, speed_band int").withColumn("snapshot_time", F.timestamp_seconds(F.lit(86400)))
    for _ in range(2):
        TB.append_fact(df, str(tmp_path / "fact"), entity="link_id", batch_id=7, files_per_date=2)
    TB.append_fact(df, str(tmp_path / "fact"), entity="link_id", batch_id=8)
    assert spark.read.parquet(str(tmp_path / "fact")).groupBy("batch").count().orderBy("batch").collect() == [(7, 2), (8, 2)]


def test_a_table_is_replaced_from_itself(spark, tmp_path):
    spark.range(4).write.mode("overwrite").saveAsTable("self_replaced")
    for n in (5, 6, 7, 8):
        old = spark.table("self_replaced")
        new = TB.replace_table(old.unionByName(spark.range(n - 1, n)), "self_replaced")
        assert sorted(r.id for r in new.collect()) == list(range(n)) and spark.table("self_replaced").count() == n
    wider = TB.replace_table(spark.table("self_replaced").withColumn("twice", F.col("id") * 2), "self_replaced")
    assert wider.columns == ["id", "twice"] and wider.agg(F.sum("twice")).first()[0] == 56
    spark.sql("DROP TABLE self_replaced")


def test_the_first_poll_counts_whatever_arrives_first(spark, tmp_path):
    schema, root = "k long, day int, poll long, v string", str(tmp_path)
    batches = [[(1, 0, 5, "late"), (2, 1, 1, "first"), (1, 0, 4, "later")], [(1, 0, 2, "first"), (2, 1, 3, "late")], [(1, 0, 3, "mid"), (3, 1, 9, "only")], []]
    for rows in batches:
        ST.land_json(spark.createDataFrame(rows, schema), f"{root}/in")
        ST.stream_first_per_key(spark.readStream.schema(schema).json(f"{root}/in"), ["k"], ["poll"], "day", f"{root}/out", f"{root}/ckpt")
    assert sorted((r.k, r.v) for r in ST.first_rows(spark, ["k"], ["poll"], f"{root}/out").collect()) == [(1, "first"), (2, "first"), (3, "only")]
    assert spark.read.parquet(f"{root}/out").count() == 4          # what a batch adds is new or earlier
