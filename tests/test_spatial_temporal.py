"""Brute-force twins and properties for the spatial and temporal joins."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from bandcast.operators import spatial as SP
from bandcast.operators import temporal as TM
from bandcast.operators.aggregates import first_per_key

R = 6371000.0


def hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def points(spark, n, seed, lat0=1.3, span=0.02, prefix="p"):
    rnd = random.Random(seed)
    rows = [(i, lat0 + rnd.random() * span, 103.8 + rnd.random() * span) for i in range(n)]
    return rows, spark.createDataFrame(pd.DataFrame(rows, columns=[f"{prefix}id", "lat", "lon"]))


def test_knn_within_matches_brute_force(spark):
    L, ldf = points(spark, 120, 1, prefix="l")
    Rr, rdf = points(spark, 300, 2, prefix="r")
    got = SP.knn_within(ldf, rdf, "lid", "rid", k=5, max_m=300.0).select("lid", "rid", "rank").collect()
    want = []
    for i, la, lo in L:
        c = sorted((hav(la, lo, b, c2), j) for j, b, c2 in Rr if hav(la, lo, b, c2) <= 300.0)[:5]
        want += [(i, j, k + 1) for k, (_, j) in enumerate(c)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_knn_in_crowded_cells_matches_brute_force(spark):
    rnd = random.Random(41)
    def cloud(n, lat, lon, width):
        return [(lat + rnd.uniform(-width, width), (lon + rnd.uniform(-width, width) + 180) % 360 - 180) for _ in range(n)]
    spots = [(1.3, 103.8), (60.0, 10.0), (0.0, 180.0)]
    Rr = [p for at in spots for w, n in ((2e-3, 40), (2e-4, 60), (2e-6, 80)) for p in cloud(n, *at, w)] + [(1.3, 103.8)] * 60
    Rr = [(i, *p) for i, p in enumerate(rnd.sample(Rr, len(Rr)))]
    Ll = [p for at in spots for w in (4e-3, 4e-4, 4e-6) for p in cloud(25, *at, w)] + [(1.3, 103.8)] * 2
    Ll = [(i, *p) for i, p in enumerate(Ll)]
    rdf = spark.createDataFrame(Rr + [(9999, None, 1.0)], "rid long, lat double, lon double")
    ldf = spark.createDataFrame(Ll + [(9999, None, 1.0)], "lid long, lat double, lon double")
    got = SP.knn_within(ldf, rdf, "lid", "rid", k=5, max_m=200.0).select("lid", "rid", "rank").collect()
    want = []
    for i, la, lo in Ll:
        c = sorted((hav(la, lo, b, c2), j) for j, b, c2 in Rr if hav(la, lo, b, c2) <= 200.0)[:5]
        want += [(i, j, n + 1) for n, (_, j) in enumerate(c)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_knn_forms_few_pairs_in_a_crowded_cell(spark):
    rnd = random.Random(42)
    rows = [(i, 1.3 + rnd.uniform(0, 1e-3), 103.8 + rnd.uniform(0, 1e-3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    L, R = SP._prefixed(df, "id", "lat", "lon", "l_"), SP._prefixed(df, "id", "lat", "lon", "r_")
    dense, radii, sizes = SP._dense_cells(R, 5, 200.0, 1.31)
    depth = dense.agg(F.max("c.n")).first()[0]
    formed = SP._density_pairs(L, R, dense, depth, 5, radii, sizes, 1.31).count()
    assert depth >= 2 and formed < 2000 * 2000 / 3


def test_neighbors_symmetric_and_complete_at_high_latitude(spark):
    # at 60 degrees a longitude degree is half as long: the grid must widen
    P, df = points(spark, 200, 3, lat0=60.0, span=0.01, prefix="")
    df = df.withColumnRenamed("id", "link_id")
    got = {(r.link_id, r.neighbor_link_id) for r in
           SP.neighbors_within(df, "link_id", 150.0, "lat", "lon").collect()}
    want = {(i, j) for i, a, b in P for j, c, d in P if i != j and hav(a, b, c, d) <= 150.0}
    assert got == want
    assert all((j, i) in got for i, j in got)


def test_neighbors_form_each_pair_once_across_the_antimeridian(spark):
    rnd = random.Random(31)
    P = [(i, rnd.uniform(-0.01, 0.01), (180 + rnd.uniform(-0.01, 0.01) + 180) % 360 - 180) for i in range(250)]
    P += [(900, 0.001, 180.0), (901, 0.001, -180.0), (902, 0.001, 179.9999), (903, 0.002, 179.9999), (904, None, 1.0)]
    P += [(5, 0.0, -179.9999)]                                 # an id at two places
    df = spark.createDataFrame(P, "link_id long, lat double, lon double")
    got = sorted((r[0], r[1]) for r in SP.neighbors_within(df, "link_id", 150.0, "lat", "lon").collect())
    whole = [p for p in P if p[1] is not None]
    want = sorted((i, j) for i, a, b in whole for j, c, d in whole if i != j and hav(a, b, c, d) <= 150.0)
    assert got == want
    polar = spark.createDataFrame([(1, 88.9999, 0.0), (2, 88.9999, 0.001), (3, 88.9999, 179.0)], "link_id long, lat double, lon double")
    assert sorted((r[0], r[1]) for r in SP.neighbors_within(polar, "link_id", 150.0, "lat", "lon").collect()) == [(1, 2), (2, 1)]


def test_nearest_escalates_to_far_points(spark):
    L, ldf = points(spark, 50, 4, prefix="l")
    # stations: a tight cluster plus one 40 km away
    st = pd.DataFrame([(0, 1.5, 104.1), (1, 1.31, 103.81), (2, 1.312, 103.815)], columns=["rid", "lat", "lon"])
    far = pd.DataFrame([(999, 2.0, 103.0)], columns=["lid", "lat", "lon"])
    ldf = ldf.unionByName(spark.createDataFrame(far))
    got = {r.lid: r.rid for r in SP.nearest(ldf, spark.createDataFrame(st), "lid", "rid", start_m=500.0).collect()}
    allL = L + [(999, 2.0, 103.0)]
    for i, a, b in allL:
        want = min((hav(a, b, c, d), j) for j, c, d in st.itertuples(index=False))[1]
        assert got[i] == want
    assert len(got) == len(allL)


def test_interval_join_strategies_agree(spark):
    rnd = random.Random(5)
    pts = [(rnd.randrange(3), rnd.randrange(0, 50000)) for _ in range(400)]
    iv = [(k, rnd.randrange(3), s, s + rnd.randrange(0, 8000)) for k, s in
          enumerate(rnd.randrange(0, 50000) for _ in range(120))]
    p = spark.createDataFrame(pts, "link_id long, snapshot_ts long")
    i = spark.createDataFrame(iv, "iid long, link_id long, start_ts long, end_ts long")
    a = TM.interval_join(p, i, strategy="merge").select("link_id", "snapshot_ts", "iid").collect()
    b = TM.interval_join(p, i, strategy="bucket", bucket_seconds=1000).select("link_id", "snapshot_ts", "iid").collect()
    want = [(l, t, k) for l, t in pts for k, l2, s, e in iv if l == l2 and s <= t <= e]
    want += [(l, t, None) for l, t in pts if not any(l == l2 and s <= t <= e for _, l2, s, e in iv)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key) == sorted(want, key=key)


def test_dyadic_interval_join_equals_brute_force(spark):
    rnd = random.Random(15)
    year = 366 * 86400
    pts = [(rnd.choice([0, 1, 2, None]), rnd.choice([None, *range(-9, 9)]) if rnd.random() < 0.2 else rnd.randrange(-5 * year, 5 * year))
           for _ in range(500)] + [(1, 7)] * 3
    iv = [(0, 1, -4 * year, 4 * year), (1, 1, -20 * year, 20 * year), (2, 0, 5, 4), (3, 0, None, 9), (4, None, 0, year),
          (5, 1, 7, 7), (5, 1, 7, 7), (6, 2, -1, 0), (7, 9, 0, year)]
    iv += [(k, rnd.randrange(3), s, s + rnd.choice([0, 59, 60, 3600, year // 3])) for k, s in
           enumerate((rnd.randrange(-5 * year, 5 * year) for _ in range(80)), 10)]
    p = spark.createDataFrame(pts, "link_id long, snapshot_ts long").withColumn("_at", F.lit("mine"))
    i = spark.createDataFrame(iv, "iid long, link_id long, start_ts long, end_ts long").withColumn("_cell", F.lit("theirs"))
    key = lambda r: tuple(-10**12 if x is None else x for x in r)
    inside = [(l, t, k) for l, t in pts for k, l2, s, e in iv if None not in (l, t, l2, s) and l == l2 and s <= t <= e]
    alone = [(l, t, None) for l, t in pts if not any(None not in (l, t, l2, s) and l == l2 and s <= t <= e for _, l2, s, e in iv)]
    for how, want in (("inner", inside), ("left", inside + alone)):
        got = TM.interval_join(p, i, how=how, strategy="dyadic", bucket_seconds=60)
        assert set(got.columns) == {"link_id", "snapshot_ts", "_at", "iid", "start_ts", "end_ts", "_cell"}
        assert sorted(map(tuple, got.select("link_id", "snapshot_ts", "iid").collect()), key=key) == sorted(want, key=key)
    assert TM.interval_join(p, i.limit(0), strategy="dyadic").count() == len(pts)
    assert TM.interval_join(p.limit(0), i, strategy="dyadic").count() == 0


def test_dyadic_cover_is_exact_and_small(spark):
    rnd = random.Random(16)
    rows = [(a, a + rnd.choice([-1, 0, 1, 2, 7, 100, 5000])) for a in (rnd.randrange(-9000, 9000) for _ in range(200))]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", TM.dyadic_cover(F.col("a"), F.col("b"), 6).alias("c"))
    for r in df.collect():
        held = [x for c in r.c for x in range(c.block << c.level, (c.block + 1) << c.level)]
        assert sorted(held) == list(range(r.a, r.b + 1))
        assert len([c for c in r.c if c.level < 6]) <= 12
    long = spark.createDataFrame([(3, 366 * 288)], "a long, b long").select(F.size(TM.dyadic_cover(F.col("a"), F.col("b"))).alias("n"))
    assert long.first().n <= 32         # a year of 5-minute buckets


def test_chunked_lags_equal_plain_with_a_hot_key(spark):
    rnd = random.Random(6)
    rows = [(0, t, rnd.randrange(1, 9)) for t in range(0, 300 * 3000, 300)]          # hot key
    rows += [(k, rnd.randrange(0, 10 ** 6) // 300 * 300, rnd.randrange(1, 9)) for k in range(1, 40)
             for _ in range(30)]
    df = spark.createDataFrame(rows, "link_id long, snapshot_ts long, sb int").dropDuplicates(["link_id", "snapshot_ts"])
    spec = ({"a": 1, "b": 2, "c": 3}, {"y": 3})
    plain = TM.lag_lead(df, "link_id", "snapshot_ts", "sb", *spec)
    chunked = TM.lag_lead(df, "link_id", "snapshot_ts", "sb", *spec, chunk_seconds=7200)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, chunked.collect()), key=key)


def test_asof_chunked_equals_brute_force(spark):
    rnd = random.Random(8)
    left = [(rnd.randrange(3), rnd.randrange(0, 20000)) for _ in range(300)]
    right = {(rnd.randrange(3), rnd.randrange(0, 20000)): rnd.random() for _ in range(200)}
    l = spark.createDataFrame(left, "k long, t long")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k long, rt long, v double")
    got = TM.asof_join(l, r, "k", "t", "rt", ["v"], tolerance=900).select("k", "t", "v").collect()
    want = []
    for k, t in left:
        c = [(rt, v) for (k2, rt), v in right.items() if k2 == k and rt <= t]
        best = max(c) if c else None
        want.append((k, t, best[1] if best and t - best[0] <= 900 else None))
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_bucket_count_property(spark):
    iv = spark.createDataFrame([(1, 0, 0), (2, 299, 301), (3, 1000, 4000), (4, 600, 500)],
                               "incident_id long, start_ts long, end_ts long")
    c = {r.incident_id: r.n for r in TM.expand_buckets(iv).groupBy("incident_id").agg(F.count("*").alias("n")).collect()}
    assert c == {1: 1, 2: 2, 3: (3900 - 900) // 300 + 1}     # 4 ends a bucket before it starts: no rows


def test_first_per_key_struct_and_hash_paths(spark):
    df = spark.createDataFrame([(1, 5, "b", 2.0), (1, 3, "a", 1.0), (2, 9, "z", 3.0)], "k long, o long, s string, v double")
    a = {r.k: (r.s, r.v) for r in first_per_key(df, ["k"], ["o"]).collect()}
    b = {r.k: r.v for r in first_per_key(df.drop("s"), ["k"], ["o"]).collect()}
    assert a == {1: ("a", 1.0), 2: ("z", 3.0)} and b == {1: 1.0, 2: 3.0}


def test_auto_chunking_switches_on_a_hot_key(spark):
    rows = [(0, t, (t // 300) % 8 + 1) for t in range(0, 300 * 500, 300)] + [(1, 0, 3), (1, 300, 4)]
    df = spark.createDataFrame(rows, "link_id long, snapshot_ts long, sb int")
    assert TM.hot_key_rows(df, "link_id") == 500
    spec = ({"a": 1, "b": 3}, {"y": 3})
    plain = TM.lag_lead(df, "link_id", "snapshot_ts", "sb", *spec, chunk_seconds=None).collect()
    auto = TM.lag_lead(df, "link_id", "snapshot_ts", "sb", *spec, chunk_seconds="auto", hot_rows=100).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, plain), key=key) == sorted(map(tuple, auto), key=key)


def test_asof_unbounded_chunked_equals_brute_force(spark):
    rnd = random.Random(11)
    left = [(rnd.randrange(3), rnd.randrange(0, 50000)) for _ in range(300)]
    right = {(rnd.randrange(3), rnd.randrange(0, 50000)): rnd.random() for _ in range(40)}   # sparse: long carries
    l = spark.createDataFrame(left, "k long, t long")
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k long, rt long, v double")
    want = []
    for k, t in left:
        c = [(rt, v) for (k2, rt), v in right.items() if k2 == k and rt <= t]
        want.append((k, t, max(c)[1] if c else None))
    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    for chunk in (None, 1000, 7000):
        got = TM.asof_join(l, r, "k", "t", "rt", ["v"], chunk_seconds=chunk).select("k", "t", "v").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key), chunk


def test_components_of_a_long_chain(spark):
    """400 sites in a row whose second-smallest id sits in the middle are one component."""
    from bandcast.operators.spatial import connected_components
    ids = [0, *range(1000, 1199), 1, *range(2000, 2199)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*ids, 5]], "id long")
    got = {r.id: r.component for r in connected_components(nodes, edges).collect()}
    assert got == {i: 0 for i in ids} | {5: 5}


def test_nearest_edge_cases(spark):
    left = spark.createDataFrame([(1, 0.0, 179.999), (2, 10.0, 10.0), (3, None, 1.0)], "id int, lat double, lon double")
    right = spark.createDataFrame([(7, 0.0, -179.999), (8, 0.0, 179.9)], "rid int, rlat double, rlon double")
    from bandcast.operators.spatial import nearest
    got = {r.id: r.rid for r in nearest(left, right, "id", "rid", r_lat="rlat", r_lon="rlon").collect()}
    assert got == {1: 7, 2: 8, 3: None}
    assert {r.rid for r in nearest(left, right.limit(0), "id", "rid", r_lat="rlat", r_lon="rlon").collect()} == {None}


def test_balanced_keeps_null_class_and_full_counts(spark):
    from bandcast.operators.sampling import balanced
    rows = [(i, None if i % 7 == 0 else i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, c int")
    got = {r[0]: r[1] for r in balanced(df, "c", 250, ["k"]).groupBy("c").count().collect()}
    assert got == {None: 250, 0: 250, 1: 250}


def test_null_keys_and_unknown_strategies(spark):
    import pytest
    left = spark.createDataFrame([(None, 10), (1, 10)], "k int, t long")
    right = spark.createDataFrame([(None, 5, 2.0), (1, 6, 3.0)], "k int, rt long, v double")
    got = {r.k: r.v for r in TM.asof_join(left, right, "k", "t", "rt", ["v"]).collect()}
    assert got == {None: None, 1: 3.0}
    with pytest.raises(ValueError):
        TM.interval_join(left, right, strategy="typo")


def test_last_update_wins(spark):
    from bandcast.sources.feeds import update_by_key
    dim = spark.createDataFrame([(1, 0.5)], "id int, lat double")
    upd = spark.createDataFrame([(1, 5.0, 0), (1, 2.0, 1)], "id int, lat double, pos int")
    assert update_by_key(dim, upd, "id", ["lat"], order="pos")[0].first().lat == 2.0
