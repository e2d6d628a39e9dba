"""Lag/lead with a halo, the packed k-d tree, as-of over distinct ticks, and the plans they allow."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from bandcast.operators import spatial as SP
from bandcast.operators import temporal as TM
from bandcast.operators.kdtree import Tree
from tests.conftest import SF001
from tests.test_plans import plan

SPEC = ({"a": 1, "b": 2, "c": 5}, {"d": 1, "e": 4})


@pytest.mark.parametrize("chunk", [1, 60, 1000, 10 ** 9])
@pytest.mark.parametrize("strict", [None, 60])
def test_halo_equals_window(spark, chunk, strict):
    """Chunks of one row each too: an offset then crosses many edges."""
    rnd = random.Random(chunk)
    rows = [(k, t, rnd.choice([None, *range(9)]), "x") for k in ("p", "q", None) for t in sorted(rnd.sample(range(0, 6000, 60), 40)) + [None]]
    df = spark.createDataFrame(rows, "k string, t long, v int, _chunk string")
    want = TM.lag_lead(df, "k", "t", "v", *SPEC, strict)
    got = TM.lag_lead(df, "k", "t", "v", *SPEC, strict, chunk_seconds=chunk)
    assert got.columns == want.columns
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_keep_chunk(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 90_000, 6)], "k long, t long, v int")
    got = TM.lag_lead(df, "k", "t", "v", {"p": 1}, chunk_seconds="auto", keep_chunk="day", null_keys=False).orderBy("t").collect()
    assert [(r.day, r.p) for r in got] == [(0, None), (1, 5)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.integers(0, 10 ** 6), st.sampled_from(["globe", "cluster", "ties", "one"]))
def test_tree_finds_all_nearest(n, seed, kind):
    rnd = np.random.default_rng(seed)
    lat, lon = {"globe": (rnd.uniform(-90, 90, n), rnd.uniform(-180, 180, n)), "cluster": (rnd.uniform(1, 1.01, n), rnd.uniform(179.99, 180.01, n)),
                "ties": (rnd.integers(0, 3, n) * 1.0, rnd.integers(0, 3, n) * 1.0), "one": (np.zeros(n), np.zeros(n))}[kind]
    q_lat, q_lon = rnd.uniform(-90, 90, 20), rnd.uniform(-180, 180, 20)
    if kind in ("cluster", "ties"):
        q_lat, q_lon = rnd.integers(0, 4, 20) / 2, rnd.integers(0, 4, 20) / 2 + (178 if kind == "cluster" else 0)
    probe, point = Tree(lat, lon).candidates(q_lat, q_lon)
    d = SP.haversine_arrays(q_lat[:, None], q_lon[:, None], lat[None], lon[None])
    for i in range(20):
        nearest = set(np.flatnonzero(d[i] <= d[i].min()).tolist())
        assert nearest <= set(point[probe == i].tolist())


def test_nearest_by_tree_equals_grid_and_handles_nulls(spark):
    rnd = random.Random(2)
    left = spark.createDataFrame([(i, rnd.choice([None, float("nan"), 1.0, 1.5]) if i < 8 else rnd.uniform(-89, 89), rnd.uniform(-180, 180))
                                  for i in range(200)], "l long, lat double, lon double")
    right = spark.createDataFrame([(f"r{i:02}", rnd.choice([1.0, 2.0, 3.0]), float(rnd.randrange(-180, 180, 60))) for i in range(60)]
                                  + [("r99", None, 1.0)], "r string, lat double, lon double")
    tree = {x.l: (x.r, x.dist_m) for x in SP.nearest(left, right, "l", "r").collect()}
    grid = {x.l: (x.r, x.dist_m) for x in SP.nearest(left.filter("lat is null or not isnan(lat)"), right, "l", "r", tree_bytes=0).collect()}
    assert len(tree) == 200 and {k: v[0] for k, v in tree.items() if k in grid} == {k: v[0] for k, v in grid.items()}
    assert all(abs(tree[k][1] - v[1]) < 1e-6 for k, v in grid.items() if v[1] is not None)
    assert {x.r for x in SP.nearest(left, right.limit(0), "l", "r").collect()} == {None}
    assert SP.nearest(left.limit(0), right, "l", "r").count() == 0


def test_expand_one_hop_keeps_the_groups_partitioning(spark):
    anchors = spark.createDataFrame([(g, k, g * 10) for g in range(5) for k in (g, g + 1)], "incident_id long, link_id long, start_ts long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "link_id long, neighbor_link_id long")
    got = SP.expand_one_hop(anchors.repartition("incident_id"), edges, carry=["start_ts"])
    nbr = {1: {2}, 2: {1, 3}, 3: {2}}
    assert sorted(map(tuple, got.select("incident_id", "link_id", "start_ts").collect())) == \
        sorted((g, x, g * 10) for g in range(5) for x in set().union(*({k} | nbr.get(k, set()) for k in (g, g + 1))))
    assert plan(got).count("hashpartitioning(incident_id") == 1


def test_feature_table_shuffles_facts_once_without_broadcasts(spark):
    """The registered plan: windows, joins by interval and the rollup run by (link, day); no measuring job, no second shuffle of facts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = plan(E.queries()["feature_table"](spark, SF001))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_day = [x for x in p.split("\n") if x.startswith("Arguments: hashpartitioning(link_id") and "_day" in x]
    assert 0 < len(by_day) <= 4                 # the facts (for the windows and, reused, for the halo), the halo, the intervals


def test_asof_windows_ticks_not_facts(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None, (i // 10) * 60 if i % 11 else None) for i in range(300)], "id long, k long, t long")
    right = spark.createDataFrame([(k, t, float(t)) for k in (0, 1, 2) for t in range(0, 1800, 240)], "k long, rt long, v double")
    got = TM.asof_join(left, right, "k", "t", "rt", ["v"], tolerance=300)
    assert got.columns == ["id", "k", "t", "v", "rt_matched"] and got.count() == 300
    for r in got.collect():
        best = max((x for x in range(0, 1800, 240) if r.k is not None and r.t is not None and x <= r.t <= x + 300), default=None)
        assert r.rt_matched == best and r.v == best
    inputs = [x for part in plan(got).split(") Window")[1:] for x in part.split("\n") if x.startswith("Input")]
    assert inputs and not any("id#" in x for x in inputs[:1])
