"""Growth faults found in round 3: each test fails on the code before its mend."""

import random

import pandas as pd
import pytest

from bandcast.operators import lifecycle as L
from bandcast.operators import temporal as TP


@pytest.mark.parametrize("strategy", ["dyadic", "bucket"])
def test_exploded_intervals_are_never_broadcast(spark, strategy):
    """sizes in the plan do not count exploded rows."""
    points = spark.range(50).selectExpr("id % 5 AS link_id", "id * 600 AS snapshot_ts")
    spans = spark.range(5).selectExpr("id AS link_id", "0L AS start_ts", "20000L AS end_ts")
    got = TP.interval_join(points, spans, how="inner", strategy=strategy)
    assert got.count() == sum(600 * i <= 20000 for i in range(50))
    assert "Broadcast" not in str(got._jdf.queryExecution().executedPlan())


def test_crowded_sites_are_linked_without_pairs(spark, monkeypatch):
    """with a distance that reaches all sites, no two of them need be compared."""
    from bandcast.operators import spatial as SP
    monkeypatch.setattr(SP, "grid_pairs", lambda *a, **kw: pytest.fail("sites were paired"))
    sites = spark.range(500).selectExpr("id AS src_id", "'A' AS type", "0L AS session", "1.3 + id * 1e-5 AS lat", "103.8 + id % 7 * 1e-4 AS lon")
    assert {r.component for r in L.site_components(sites, 2.1e7).collect()} == {0}


def test_components_are_those_of_the_distance(spark):
    """Sites of neighbouring tiles, of tiles in reach and beyond it, across the antimeridian too."""
    rnd = random.Random(5)
    rows = [(i, "AB"[i % 2], 0, 1.3 + rnd.random() * 0.03, (179.985 + rnd.random() * 0.03 + 180) % 360 - 180) for i in range(240)]
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and L._hav(*a[3:], *b[3:]) <= 200.0:
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    got = L.site_components(spark.createDataFrame(rows, "src_id long, type string, session long, lat double, lon double"), 200.0).collect()
    place = {(r[1], r[3], r[4]): root(r[0]) for r in rows}
    assert {(r.type, r.lat, r.lon): r.component for r in got} == place and len(set(place.values())) > 20


def test_a_group_is_not_held_by_its_task():
    """Closed incidents leave a task while it still reads the rows of their group."""
    drawn = []

    def batches():
        for k in range(8):
            drawn.append(k)
            i = range(k * 10_000, (k + 1) * 10_000)
            yield pd.DataFrame({"type": "A", "session": 0, "component": 0, "bin": 0, "src_id": list(i), "lat": 1.3, "lon": 103.8,
                                "ts": [7200 * x for x in i], "message": None})

    out = L.greedy_lifecycles(15.0, 200.0)(batches())
    assert len(next(out)) >= 10_000 and len(drawn) < 8
    slices = L._slice_pieces(15.0, 200.0)((b.assign(slice=1, handed=False, end_ts=None) for b in batches()))
    drawn.clear()
    assert len(next(slices)) >= 10_000 and len(drawn) < 8


@pytest.mark.parametrize("key", ["long", "string"])
def test_buckets_are_rolled_up_without_a_row_for_each_interval(spark, monkeypatch, key):
    """F8: same rows as expanding every interval; long intervals, times before 1970, nulls and empty ranges too."""
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(12)]), rnd.choice(["Accident", "Roadwork", "Vehicle breakdown", "Other", None]), t := rnd.randrange(-90_000, 400_000),
             rnd.choice([None, t - 1000, t, t + rnd.randrange(9000), t + 200_000])) for _ in range(6000)]
    iv = spark.createDataFrame([*rows, (1, "Accident", None, 5)], "link_id long, type string, start_ts long, end_ts long")
    iv = iv.withColumn("link_id", iv.link_id.cast(key))
    want = TP.bucket_rollup(TP.expand_buckets(iv))
    monkeypatch.setattr(TP, "expand_buckets", lambda *a, **kw: pytest.fail("a row for each bucket"))
    got = TP.interval_bucket_rollup(iv)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert min(r.mins_since_nearby_start for r in TP.interval_bucket_rollup(iv, parity=False).collect()) == 0.0
