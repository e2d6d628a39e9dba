"""T3 over out-of-order micro-batches, restarts and replays equals W5; one type runs in several groups; late rows are kept."""

import random

import pytest

from bandcast.operators.lifecycle import incident_lifecycles
from bandcast.sources.commits import BatchLog
from bandcast.streaming import lifecycles as S
from bandcast.streaming import streams as ST

COLUMNS = ["incident_id", "type", "start_ts", "end_ts", "sightings", "message"]
HOUR = 3600


def run(spark, root, rows, **kw):
    ST.land_json(spark.createDataFrame(rows, S.SIGHTING_SCHEMA), f"{root}/in")
    schema = spark.createDataFrame([], S.SIGHTING_SCHEMA).schema
    S.start_lifecycles(ST.stream_rows(spark, f"{root}/in", schema), f"{root}/out", f"{root}/ckpt", **kw)


def closed(spark, root):
    return sorted(map(tuple, S.closed_lifecycles(spark, f"{root}/out").filter("type is null or type <> 'beat'").select(*COLUMNS).collect()), key=str)


def batch(spark, rows):
    return sorted(map(tuple, incident_lifecycles(spark.createDataFrame(rows, S.SIGHTING_SCHEMA)).select(*COLUMNS).collect()), key=str)


def feed(seed, n=180):
    """Sightings of four sites (two far apart) over three hours, dealt out of order into six batches, at most 15 minutes late."""
    rnd = random.Random(seed)
    sites = [(1.3, 103.8), (1.3005, 103.8008), (1.4, 103.9), (1.302, 103.801)]
    rows = [(i, "Accident", *rnd.choice(sites), f"m{i}", HOUR + 60 * i) for i in range(n)]
    parts = [[] for _ in range(6)]
    for r in rows:
        k = (r[0] * 6) // n
        parts[min(5, k + (1 if k < 5 and r[0] % (n // 6) >= n // 6 - 10 and rnd.random() < 0.6 else 0))].append(r)
    for p in parts:
        rnd.shuffle(p)
    return rows, parts


@pytest.mark.parametrize("seed,kw", [(2, {"max_group_rows": 5, "slice_rows": 12})])
def test_out_of_order_batches_with_a_kill_and_restarts_equal_w5(spark, monkeypatch, seed, kw):
    root = ST.stream_workspace(spark, "t3")
    rows, parts = feed(seed)
    commit = BatchLog.commit
    for k, part in enumerate([*parts, [(9999, "beat", 1.3, 103.8, None, 100 * HOUR)]]):
        if k == 3:                              # killed before the commit, then restarted over the same batch
            def killed(*a, **b):
                raise RuntimeError("killed")
            monkeypatch.setattr(BatchLog, "commit", killed)
            with pytest.raises(Exception, match="killed"):
                run(spark, root, part, **kw)
            monkeypatch.setattr(BatchLog, "commit", commit)
            part = [(-1, None, 1.0, 2.0, "no type", 5)]
            rows.append(part[0])
        run(spark, root, part, **kw)            # every run is a restart from the checkpoint
    assert S.late_sightings(spark, f"{root}/out").count() == 0
    assert closed(spark, root) == batch(spark, rows)


def test_one_type_runs_in_several_groups(spark, monkeypatch):
    root = ST.stream_workspace(spark, "t3_groups")
    seen, settled = [], S.settled_pieces

    def spy(rows, *a):
        seen.append(rows.select("component").distinct().count())
        return settled(rows, *a)
    monkeypatch.setattr(S, "settled_pieces", spy)
    rows, _ = feed(3, 60)
    run(spark, root, [*rows, (9999, "beat", 1.3, 103.8, None, 100 * HOUR)], max_group_rows=5)
    assert max(seen) >= 2 and closed(spark, root) == batch(spark, rows)


def test_late_and_odd_sightings_are_kept(spark):
    root = ST.stream_workspace(spark, "t3_late")
    run(spark, root, [(1, "A", 1.3, 103.8, "a", 10 * HOUR), (2, "A", None, 103.8, "no place", 10 * HOUR), (3, "A", 1.3, 103.8, "no time", None)])
    run(spark, root, [(4, "A", 1.3, 103.8, "too late", 9 * HOUR), (5, "A", 1.3, 103.8, "in time", 10 * HOUR - 600)])
    run(spark, root, [(6, "beat", 1.3, 103.8, None, 100 * HOUR)])
    assert [r.message for r in S.late_sightings(spark, f"{root}/out").collect()] == ["too late"]
    assert [(r[0], r[4]) for r in closed(spark, root)] == sorted([(2, 1), (3, 1), (5, 2)], key=lambda r: r[0])


def test_large_types_are_split_by_cells_without_comparing_sites(spark, monkeypatch):
    """Sites some 89 m apart are linked through the cells they lie in, so the work follows the cells and not the pairs of sites in reach."""
    from bandcast.operators import spatial

    def compared(*a, **k):
        raise AssertionError("sites are compared")
    monkeypatch.setattr(spatial, "grid_pairs", compared)
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["Accident", "Roadwork"]), 1.3 + 8e-4 * rnd.randrange(8) + 0.5 * (i % 2), 103.8 + 8e-4 * rnd.randrange(8), f"m{i}", HOUR + 20 * i)
            for i in range(400)]
    root = ST.stream_workspace(spark, "t3cells")
    run(spark, root, [*rows, (9999, "beat", 1.3, 103.8, None, 100 * HOUR)], max_group_rows=20, slice_rows=60)
    assert closed(spark, root) == batch(spark, rows)


def test_cells_part_no_sites_within_the_distance(spark):
    """Sites within the distance share a component across cells, bands, the antimeridian and near a pole; far ones are parted."""
    from bandcast.functions.geo import haversine_m
    from bandcast.operators.lifecycle import cell_components, cells_of_sites
    from pyspark.sql import functions as F
    rnd = random.Random(7)
    spots = [(1.3, 103.8), (0.0, 0.0), (60.2, 179.9995), (60.2, -179.9995), (-33.0, -70.0), (89.9995, 10.0), (89.9995, -170.0)]
    rows = [(i, "a" if i % 3 else "b", 0, la + rnd.uniform(-4e-3, 4e-3) if la < 89 else la, lo + rnd.uniform(-6e-3, 6e-3))
            for i, (la, lo) in enumerate(spots * 25)]
    df = spark.createDataFrame(rows, "src_id long, type string, session long, lat double, lon double")
    groups = df.select("type", "session").distinct()
    got = df.withColumns(cells_of_sites("lat", "lon", 200.0)).join(cell_components(df, 200.0, groups), ["type", "session", "cy", "cx"]) \
        .select("src_id", "type", "lat", "lon", "component")
    assert got.count() == len(rows)
    l, r = (got.select(*[F.col(c).alias(f"{p}_{c}") for c in got.columns]) for p in "lr")
    near = l.join(r, (F.col("l_type") == F.col("r_type")) & (F.col("l_src_id") < F.col("r_src_id"))) \
        .filter(haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= 200.0)
    assert near.count() > 100 and near.filter("l_component <> r_component").count() == 0
    assert got.filter("type = 'a'").select("component").distinct().count() >= 5
