"""The distributed lifecycle operator equals a brute-force twin of the
global greedy algorithm (one pass over all rows, every open incident
scanned), on the fixture table and on random inputs."""

import math
import random

import pandas as pd
import pytest

from bandcast.operators.lifecycle import incident_lifecycles
from bandcast.plans import fixtures as fx
from tests.conftest import SF001

R = 6371000.0


def dist(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def twin(rows, gap_min, max_m):
    """rows: (src_id, type, lat, lon, message, ts).  Global, order-faithful."""
    rows = sorted(rows, key=lambda r: (r[5], r[0]))
    live, done = [], []
    for sid, typ, la, lo, msg, t in rows:
        pick, pd_ = None, None
        for inc in live:
            if inc["type"] != typ or (t - inc["last"]) / 60.0 > gap_min:
                continue
            d = dist(la, lo, inc["lat"], inc["lon"])
            if d <= max_m and (pd_ is None or d < pd_):
                pick, pd_ = inc, d
        if pick is None:
            live.append({"id": sid, "type": typ, "lat": la, "lon": lo, "start": t, "last": t, "n": 1,
                         "msg": msg})
        else:
            pick["last"], pick["n"] = t, pick["n"] + 1
        keep = []
        for inc in live:
            (done if (t - inc["last"]) / 60.0 > gap_min else keep).append(inc)
        live = keep
    done += live
    return sorted((i["id"], i["type"], i["start"], i["last"], i["n"], i["msg"]) for i in done)


def spark_result(df, gap, max_m, split=None):
    out = incident_lifecycles(df, gap, max_m, max_group_rows=split).toPandas()
    return sorted((int(r.incident_id), r.type, int(r.start_ts), int(r.end_ts), int(r.sightings), r.message)
                  for r in out.itertuples())


@pytest.mark.parametrize("gap,split", [(15.0, None), (120.0, None), (120.0, 0), (360.0, 50)])
def test_fixture_matches_twin(spark, gap, split):
    """``split`` forces the distance-component split of large groups."""
    snaps = fx.incident_snapshots(spark, SF001)
    rows = [tuple(r) for r in snaps.select("src_id", "type", "lat", "lon", "message", "ts").collect()]
    assert spark_result(snaps, gap, 200.0, split) == twin(rows, gap, 200.0)


def test_random_matches_twin(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        rows.append((i, rnd.choice(["Accident", "Roadwork"]), 1.30 + rnd.random() * 0.01,
                     103.80 + rnd.random() * 0.01, f"m{i}", 1_700_000_000 + rnd.randrange(0, 6 * 3600, 60)))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["src_id", "type", "lat", "lon", "message", "ts"]))
    assert spark_result(df, 15.0, 300.0) == twin(rows, 15.0, 300.0)
    assert spark_result(df, 15.0, 300.0, split=0) == twin(rows, 15.0, 300.0)


def test_equal_distance_goes_to_earlier_incident(spark):
    # two incidents 200 m apart (north/south of a midpoint); a sighting exactly
    # between them is at equal distance and must join the earlier one
    dlat = 100.0 / (R * math.pi / 180.0)
    rows = [(1, "Accident", 1.3 - dlat, 103.8, "a", 0), (2, "Accident", 1.3 + dlat, 103.8, "b", 60),
            (3, "Accident", 1.3, 103.8, "c", 120)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["src_id", "type", "lat", "lon", "message", "ts"]))
    got = spark_result(df, 15.0, 150.0)
    assert got == twin(rows, 15.0, 150.0)
    assert [g[4] for g in got] == [2, 1]


def test_type_sessions_chunked_equal_plain(spark):
    from bandcast.operators.lifecycle import type_sessions
    snaps = fx.incident_snapshots(spark, SF001)
    for gap in (15.0, 120.0):
        a = sorted(tuple(r) for r in type_sessions(snaps, max_gap_min=gap, chunk_seconds=None)
                   .select("type", "ts", "session").collect())
        b = sorted(tuple(r) for r in type_sessions(snaps, max_gap_min=gap, chunk_seconds=3600)
                   .select("type", "ts", "session").collect())
        assert a == b
