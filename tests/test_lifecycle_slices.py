"""W5 in time slices inside one component, sightings that can match nothing, the antimeridian and the poles."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandcast.operators import lifecycle as L
from bandcast.operators.joins import broadcast_if_small
from tests.test_lifecycle import twin

COLUMNS = "src_id long, type string, lat double, lon double, message string, ts long"


def result(df, gap, dist, **kw):
    out = L.incident_lifecycles(df, gap, dist, **kw).collect()
    return sorted((r.incident_id, r.type, r.start_ts, r.end_ts, r.sightings, r.message) for r in out)


def one_place(n, seed, sites=6, spread=0.004, step=60):
    """A feed without any silence, all of it one distance component: few sites sighted again and again, and noise."""
    rnd = random.Random(seed)
    spots = [(1.3 + rnd.random() * spread, 103.8 + rnd.random() * spread) for _ in range(sites)]
    rows = []
    for i in range(n):
        la, lo = rnd.choice(spots) if rnd.random() < 0.8 else (1.3 + rnd.random() * spread, 103.8 + rnd.random() * spread)
        rows.append((i, "Accident", la, lo, f"m{i}", 1_700_000_000 + (i // 3) * step))
    return rows


@pytest.mark.parametrize("split,slice_rows,seed", [(0, 40, 1), (None, 25, 2), (None, 7, 3)])
def test_one_component_in_slices_equals_twin(spark, split, slice_rows, seed):
    rows = one_place(240, seed)
    df = spark.createDataFrame(rows, COLUMNS)
    assert result(df, 15.0, 200.0, max_group_rows=split, slice_rows=slice_rows) == twin(rows, 15.0, 200.0)


def test_slices_are_tasks_of_their_own_and_settle_early(spark, monkeypatch):
    """Incidents that stay open through all slices do not make the slices run one after the other."""
    rounds, cut = [], L._slice_pieces
    monkeypatch.setattr(L, "_slice_pieces", lambda *a: (rounds.append(0), cut(*a))[1])
    signatures = L._signatures
    monkeypatch.setattr(L, "_signatures", lambda df, name: (rounds.append(name), signatures(df, name))[1])
    spots = [(1.3 + 0.003 * k, 103.8) for k in range(4)]
    rows = [(4 * t + k, "Accident", *spots[k], f"{t}", 1000 + 60 * t) for t in range(60) for k in range(4)]
    got = result(spark.createDataFrame(rows, COLUMNS), 15.0, 400.0, slice_rows=24)
    assert got == twin(rows, 15.0, 400.0) and [g[4] for g in got] == [120, 120]
    assert rounds.count("new") <= 4              # 10 slices


def test_ties_across_slices(spark):
    dlat = 100.0 / 111_194.93
    rows = [(1, "A", 1.3 + dlat, 103.8, "a", 0), (2, "A", 1.3 - dlat, 103.8, "b", 60)]
    rows += [(10 + i, "A", 1.3 + (dlat if i % 2 else -dlat), 103.8, None, 300 + 60 * i) for i in range(20)]
    rows += [(50 + i, "A", 1.3, 103.8, "mid", 1600 + i) for i in range(10)]
    got = result(spark.createDataFrame(rows, COLUMNS), 15.0, 150.0, slice_rows=4)
    assert got == twin(rows, 15.0, 150.0)


def test_sightings_that_match_nothing_are_kept(spark):
    nan = float("nan")
    rows = [(1, None, 1.3, 103.8, "no type", 0), (2, None, 1.3, 103.8, None, 60), (3, "A", None, 103.8, "no lat", 0),
            (4, "A", 1.3, nan, "nan", 0), (5, "A", 1.3, 103.8, "no time", None), (6, "A", 1.3, 103.8, "x", 0), (7, "A", 1.3, 103.8, "y", 60)]
    got = L.incident_lifecycles(spark.createDataFrame(rows, COLUMNS)).orderBy("incident_id").collect()
    assert [(r.incident_id, r.sightings, r.message) for r in got] == \
        [(1, 1, "no type"), (2, 1, None), (3, 1, "no lat"), (4, 1, "nan"), (5, 1, "no time"), (6, 2, "x")]
    assert L.incident_lifecycles(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("split", [None, 0])
def test_antimeridian_and_poles(spark, split):
    rnd = random.Random(11)
    rows = []
    for i in range(200):
        place = rnd.randrange(3)
        lat, lon = ((-17.0 + rnd.random() * 0.004, rnd.choice([179.999, -179.999]) + rnd.random() * 0.0009),
                    (89.9985 + rnd.random() * 0.001, rnd.random() * 360 - 180), (60.0 + rnd.random() * 0.004, rnd.random() * 0.008))[place]
        rows.append((i, "A", lat, max(-180.0, min(180.0, lon)), None, 60 * (i // 4)))
    if split is not None:           # the component split blocks by cells that reach 89 degrees
        rows = [r for r in rows if r[2] < 89]
    assert result(spark.createDataFrame(rows, COLUMNS), 15.0, 200.0, max_group_rows=split) == twin(rows, 15.0, 200.0)


def test_broadcast_goes_by_measured_bytes(spark):
    plan = lambda df: str(spark.range(9).join(df, "id")._jdf.queryExecution().optimizedPlan())
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("a" * 100), F.lit(None).cast("string")).alias("a"))
    assert "broadcast" in plan(broadcast_if_small(wide)) and "broadcast" not in plan(broadcast_if_small(wide, max_bytes=100_000))
    assert "broadcast" in plan(broadcast_if_small(wide, max_bytes=200_000)) and "broadcast" not in plan(broadcast_if_small(wide, max_rows=99))
    assert "broadcast" in plan(broadcast_if_small(wide.limit(0), persist=True))
