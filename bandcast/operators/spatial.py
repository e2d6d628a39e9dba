"""Spatial joins J8-J12, J15 without a tree index and without cross joins.

Blocking: points are put in grid cells at least as wide as the search radius
(longitude cells widened by 1/cos of the largest latitude present, so a
point two or more cells away is provably farther than the radius).  The
probe side is exploded to its 3x3 cell neighbourhood and equi-joined on the
cell; the exact haversine test runs on the candidates.  Dense cells are
ordinary skewed join keys, which AQE's skew-join handling splits.
Right points near the antimeridian are also entered one turn away, so cells
meet across it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandcast.functions.geo import EARTH_R_M, M_PER_DEG, haversine_m
from bandcast.operators.joins import broadcast_if_small
from bandcast.operators.kdtree import Tree
from bandcast.session import cut_lineage

_NEIGHBOURHOOD = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
_FORWARD = [(0, 0), (1, -1), (1, 0), (0, 1), (1, 1)]       # one of each two opposite neighbours, and the cell itself
LEVELS = 6                    # finer grids where right points are dense: each a quarter of the radius before
HALF_GLOBE_M = 20_100_000.0   # more than any distance on the globe
_MARGIN = 1.001   # covers chord-vs-arc for separations up to ~1 radian


def max_abs_lat(*frames_and_cols) -> float:
    """Largest |latitude| over (df, lat_col) pairs: one small aggregate each."""
    m = 0.0
    for df, lat in frames_and_cols:
        v = df.agg(F.max(F.abs(F.col(lat)))).first()[0]
        if v is not None:
            m = max(m, float(v))
    return min(m, 89.0)


def _cell_sizes(cell_m: float, lat_bound: float) -> tuple[float, float]:
    dlat = cell_m * _MARGIN / M_PER_DEG
    dlon = cell_m * _MARGIN / (M_PER_DEG * math.cos(math.radians(lat_bound)))
    return dlat, dlon


def _cells(df: DataFrame, lat: str, lon: str, dlat: float, dlon: float) -> DataFrame:
    return df.withColumns({
        "_cy": F.floor(F.col(lat) / F.lit(dlat)).cast("bigint"),
        "_cx": F.floor(F.col(lon) / F.lit(dlon)).cast("bigint"),
    })


def grid_pairs(left: DataFrame, right: DataFrame, cell_m: float, lat_bound: float,
               l_lat: str = "lat", l_lon: str = "lon", r_lat: str = "lat", r_lon: str = "lon",
               dist: str = "dist_m", keys: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All (left, right) pairs in neighbouring cells, with their distance.

    Column names of the two sides must be disjoint; ``keys`` adds equality
    conditions (left column, right column), e.g. to pair only within a group.
    """
    dlat, dlon = _cell_sizes(cell_m, lat_bound)
    reach = min(2 * dlon, 180.0)          # a copy is needed if the point's neighbourhood crosses 180 degrees
    turn = F.filter(F.array(F.when(F.col(r_lon) + reach > 180, -360.0), F.lit(0.0), F.when(F.col(r_lon) - reach < -180, 360.0)),
                    lambda x: x.isNotNull())
    r = right.withColumn("_turn", F.explode(turn)).withColumn("_rlon", F.col(r_lon) + F.col("_turn")).drop("_turn")
    r = _cells(r, r_lat, "_rlon", dlat, dlon).drop("_rlon")
    nb = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                             for dx, dy in _NEIGHBOURHOOD]))
    l = (_cells(left, l_lat, l_lon, dlat, dlon)
         .withColumn("_nb", nb)
         .withColumns({"_py": F.col("_cy") + F.col("_nb.dy"), "_px": F.col("_cx") + F.col("_nb.dx")})
         .drop("_cy", "_cx", "_nb"))
    cond = (l["_py"] == r["_cy"]) & (l["_px"] == r["_cx"])
    for a, b in keys:
        cond = cond & (l[a] == r[b])
    j = l.join(r, cond, "inner").drop("_py", "_px", "_cy", "_cx")
    return j.withColumn(dist, haversine_m(F.col(l_lat), F.col(l_lon), F.col(r_lat), F.col(r_lon)))


def _prefixed(df: DataFrame, id_col: str, lat: str, lon: str, p: str, carry=()) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{p}id"), F.col(lat).alias(f"{p}lat"), F.col(lon).alias(f"{p}lon"),
                     *[F.col(c) for c in carry])


def _dense_cells(R: DataFrame, k: int, max_m: float, lat_bound: float) -> tuple[DataFrame, list[float], list[tuple[float, float]]]:
    """Cells that split by measured density: those of each finer level with at least ``k`` right points.

    Level ``n`` has the radius ``max_m / 4**n`` and cells whose diagonal is no longer than it, so a left point
    in such a cell has its ``k`` nearest within that radius.  Returns the cells, radii and cell sizes by level."""
    radii = [max_m / 4 ** n for n in range(LEVELS + 1)]
    shape = math.hypot(1.0, 1.0 / math.cos(math.radians(lat_bound))) * _MARGIN ** 2     # diagonal of a cell of width 1
    sizes = [_cell_sizes(r / shape, lat_bound) for r in radii]
    cells = R.select(F.explode(F.array(*[_at_level(n, "r_lat", "r_lon", *sizes[n]) for n in range(1, LEVELS + 1)])).alias("c"))
    return cells.groupBy("c").count().filter(F.col("count") >= k).select("c"), radii, sizes


def _at_level(n: int, lat: str, lon: str, dlat: float, dlon: float):
    return F.struct(F.lit(n).alias("n"), F.floor(F.col(lat) / F.lit(dlat)).cast("bigint").alias("y"),
                    F.floor(F.col(lon) / F.lit(dlon)).cast("bigint").alias("x"))


def _density_pairs(L: DataFrame, R: DataFrame, dense: DataFrame, depth: int, k: int, radii: list[float],
                   sizes: list[tuple[float, float]], lat_bound: float) -> DataFrame:
    """Pairs of left points with the right points around them, as far as the finest dense cell they lie in
    asks for.  Of right points at one place the ``k`` with the smallest ids can be among the nearest."""
    place = Window.partitionBy("r_lat", "r_lon").orderBy("r_id")
    R = R.withColumn("_nth", F.row_number().over(place)).filter(F.col("_nth") <= k).drop("_nth")
    dense = broadcast_if_small(dense)
    for n in range(1, depth + 1):
        d = dense.filter(F.col("c.n") == n).select(F.col("c").alias("_c"), F.lit(n).alias(f"_in{n}"))
        L = L.join(d, _at_level(n, "l_lat", "l_lon", *sizes[n]) == F.col("_c"), "left").drop("_c")
    level = F.coalesce(*[F.col(f"_in{n}") for n in range(depth, 0, -1)], F.lit(0))
    L = L.withColumn("_level", level).drop(*[f"_in{n}" for n in range(1, depth + 1)])
    grids = [_cell_sizes(r, lat_bound) for r in radii[:depth + 1]]
    reach = min(2 * grids[0][1], 180.0)
    turn = F.filter(F.array(F.when(F.col("r_lon") + reach > 180, -360.0), F.lit(0.0), F.when(F.col("r_lon") - reach < -180, 360.0)),
                    lambda x: x.isNotNull())
    R = R.withColumn("_turn", F.explode(turn)).withColumn("_rlon", F.col("r_lon") + F.col("_turn"))
    R = R.withColumn("_cell", F.explode(F.array(*[_at_level(n, "r_lat", "_rlon", *g) for n, g in enumerate(grids)]))).drop("_turn", "_rlon")
    around = [_at_level(n, "l_lat", "l_lon", *g) for n, g in enumerate(grids)]
    L = L.withColumn("_own", F.element_at(F.array(*around), F.col("_level") + 1)) \
        .withColumn("_nb", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _NEIGHBOURHOOD]))) \
        .withColumn("_look", F.struct(F.col("_own.n").alias("n"), (F.col("_own.y") + F.col("_nb.dy")).alias("y"),
                                      (F.col("_own.x") + F.col("_nb.dx")).alias("x"))).drop("_own", "_nb", "_level")
    j = L.join(R, L["_look"] == R["_cell"]).drop("_look", "_cell")
    return j.withColumn("dist_m", haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))


def _knn(L: DataFrame, R: DataFrame, k: int, max_m: float, lat_bound: float | None, carry=()) -> DataFrame:
    if lat_bound is None:
        lat_bound = max_abs_lat((L, "l_lat"), (R, "r_lat"))
    R = R.filter(F.col("r_lat").isNotNull() & F.col("r_lon").isNotNull())
    dense, radii, sizes = _dense_cells(R, k, max_m, lat_bound)
    dense = cut_lineage(dense)
    depth = dense.agg(F.max("c.n")).first()[0]
    pairs = _density_pairs(L, R, dense, depth, k, radii, sizes, lat_bound) if depth else \
        grid_pairs(L, R, max_m, lat_bound, "l_lat", "l_lon", "r_lat", "r_lon")
    pairs = pairs.filter(F.col("dist_m") <= F.lit(float(max_m)))
    w = Window.partitionBy("l_id").orderBy("dist_m", "r_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("l_id", "r_id", "dist_m", "rank", *carry)


def knn_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int = 5,
               max_m: float = 200.0, l_lat: str = "lat", l_lon: str = "lon",
               r_lat: str = "lat", r_lon: str = "lon", lat_bound: float | None = None,
               out_right: str | None = None, carry=()) -> DataFrame:
    """The k nearest right points within ``max_m`` of each left point.

    Returns (left_id, right id, dist_m, rank, *carry); ties broken by right
    id; ``carry`` left columns ride along (no join back afterwards).  A left
    point with nothing in range yields no rows.  Cutting at the radius
    before ranking equals ranking then cutting.

    Where at least ``k`` right points share a small cell, the radius shrinks to what such a cell
    guarantees (levels of a quarter each, by one measured count), so a crowded cell is not paired as a
    whole with every point beside it; of points at one place only the ``k`` smallest ids take part.
    """
    L = _prefixed(left, left_id, l_lat, l_lon, "l_", carry)
    R = _prefixed(right, right_id, r_lat, r_lon, "r_")
    return _knn(L, R, k, max_m, lat_bound, carry).select(
        F.col("l_id").alias(left_id), F.col("r_id").alias(out_right or right_id), "dist_m", "rank", *carry)


def neighbors_within(points: DataFrame, id_col: str = "link_id", max_m: float = 200.0,
                     lat: str = "mid_lat", lon: str = "mid_lon", out: str = "neighbor_link_id",
                     lat_bound: float | None = None) -> DataFrame:
    """Symmetric neighbour pairs within ``max_m``, no self pairs.

    Each unordered pair is formed and measured once, from the cell that comes first (a point looks into
    four of the eight cells around its own, and at the larger places of its own cell), then mirrored.
    Points just east of the antimeridian are looked for one turn further on as well.
    Two rows with one id are no pair, as before; equal ids at two places each pair with the others.
    """
    if lat_bound is None:
        lat_bound = max_abs_lat((points, lat))
    dlat, dlon = _cell_sizes(max_m, lat_bound)
    if dlon > 60.0:         # a cell goes round the pole: both ways round could meet
        L = _prefixed(points, id_col, lat, lon, "l_")
        R = _prefixed(points, id_col, lat, lon, "r_")
        pairs = grid_pairs(L, R, max_m, lat_bound, "l_lat", "l_lon", "r_lat", "r_lon")
        pairs = pairs.filter((F.col("dist_m") <= F.lit(float(max_m))) & (F.col("l_id") != F.col("r_id")))
        return pairs.select(F.col("l_id").alias(id_col), F.col("r_id").alias(out), "dist_m")
    R = _cells(_prefixed(points, id_col, lat, lon, "r_"), "r_lat", "r_lon", dlat, dlon).withColumn("_turned", F.lit(False))
    turned = _prefixed(points, id_col, lat, lon, "r_").filter(F.col("r_lon") - 2 * dlon < -180)
    turned = _cells(turned.withColumn("_east", F.col("r_lon") + 360.0), "r_lat", "_east", dlat, dlon).drop("_east") \
        .withColumn("_turned", F.lit(True))
    looks = [(dx, dy, False) for dx, dy in _FORWARD] + [(dx, dy, True) for dx, dy in _NEIGHBOURHOOD]
    look = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(t).alias("t")) for dx, dy, t in looks])
    near_edge = F.col("l_lon") + 2 * dlon > 180         # only these can meet a turned point
    L = _cells(_prefixed(points, id_col, lat, lon, "l_"), "l_lat", "l_lon", dlat, dlon) \
        .withColumn("_nb", F.explode(F.filter(look, lambda x: ~x["t"] | near_edge))) \
        .withColumns({"_py": F.col("_cy") + F.col("_nb.dy"), "_px": F.col("_cx") + F.col("_nb.dx")}) \
        .withColumns({"_t": F.col("_nb.t"), "_own": ~F.col("_nb.t") & (F.col("_nb.dx") == 0) & (F.col("_nb.dy") == 0)}) \
        .drop("_cy", "_cx", "_nb")
    R = R.unionByName(turned)
    pairs = L.join(R, (L["_py"] == R["_cy"]) & (L["_px"] == R["_cx"]) & (L["_t"] == R["_turned"])
                   & (L["l_id"] != R["r_id"]) & (~L["_own"] | (L["l_id"] < R["r_id"])))
    pairs = pairs.withColumn("dist_m", haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))) \
        .filter(F.col("dist_m") <= F.lit(float(max_m)))
    both = F.array(F.struct(F.col("l_id").alias("a"), F.col("r_id").alias("b")), F.struct(F.col("r_id").alias("a"), F.col("l_id").alias("b")))
    return pairs.select("dist_m", F.explode(both).alias("_p")).select(
        F.col("_p.a").alias(id_col), F.col("_p.b").alias(out), "dist_m")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, max_m: float,
                   out: str = "nearest_id", l_lat: str = "lat", l_lon: str = "lon",
                   r_lat: str = "lat", r_lon: str = "lon", lat_bound: float | None = None) -> DataFrame:
    """Every left row plus its single nearest right id within ``max_m``
    (null beyond the cutoff)."""
    L = _prefixed(left, left_id, l_lat, l_lon, "l_")
    R = _prefixed(right, right_id, r_lat, r_lon, "r_")
    best = _knn(L, R, 1, max_m, lat_bound).select(
        F.col("l_id").alias(left_id), F.col("r_id").alias(out), F.col("dist_m").alias(f"{out}_dist_m"))
    return left.join(best, left_id, "left")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
            l_lat: str = "lat", l_lon: str = "lon", r_lat: str = "lat", r_lon: str = "lon",
            start_m: float = 2000.0, growth: float = 4.0, lat_bound: float | None = None,
            tree_bytes: int = 64 << 20) -> DataFrame:
    """Nearest right point for every left point, exact, unbounded radius.

    Returns (left_id, right_id, dist_m); ties go to the smaller right id.  A left
    point without coordinates, or any left point if the right side has
    none, gets null id and distance.  The right side is measured; up to ``tree_bytes`` it is packed into
    a k-d tree, which is broadcast and probed batch by batch: one narrow
    pass over the left side, planned lazily.  A larger right side is searched by :func:`nearest_by_grid`.
    """
    R = right.select(F.col(right_id).alias("r_id"), F.col(r_lat).cast("double").alias("r_lat"), F.col(r_lon).cast("double").alias("r_lon"))
    R = R.filter(F.col("r_lat").isNotNull() & F.col("r_lon").isNotNull() & ~F.isnan("r_lat") & ~F.isnan("r_lon"))
    from bandcast.operators.joins import row_bytes
    R = cut_lineage(R)
    if (R.agg(F.sum(row_bytes(R))).first()[0] or 0) > tree_bytes:
        return nearest_by_grid(left, right, left_id, right_id, l_lat, l_lon, r_lat, r_lon, start_m, growth, lat_bound)
    points = R.orderBy("r_id").toArrow()            # at most tree_bytes
    ids, lat, lon = (points.column(c).combine_chunks() for c in range(3))
    lat, lon = lat.to_numpy(), lon.to_numpy()
    shared = left.sparkSession.sparkContext.broadcast((ids, lat, lon, Tree(lat, lon) if len(lat) else None))
    types = dict(left.dtypes)[left_id], dict(R.dtypes)["r_id"]

    def probe(batches):
        right_ids, r_la, r_lo, tree = shared.value
        for b in batches:
            x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:])
            known = np.flatnonzero(~np.isnan(x) & ~np.isnan(y)) if tree else np.zeros(0, np.int64)
            place, dist = np.full(b.num_rows, -1), np.full(b.num_rows, np.nan)
            if len(known):
                row, point = tree.candidates(x[known], y[known])
                d = haversine_arrays(x[known][row], y[known][row], r_la[point], r_lo[point])
                order = np.lexsort((point, d, row))         # points are in the order of their ids
                first = order[np.unique(row[order], return_index=True)[1]]
                place[known[row[first]]], dist[known[row[first]]] = point[first], d[first]
            yield pa.RecordBatch.from_arrays([b.column(0), right_ids.take(pa.array(place, mask=place < 0)), pa.array(dist, mask=place < 0)],
                                             ["l", "r", "d"])

    out = left.select(left_id, F.col(l_lat).cast("double").alias("_lat"), F.col(l_lon).cast("double").alias("_lon")) \
        .mapInArrow(probe, f"l {types[0]}, r {types[1]}, d double")
    return out.toDF(left_id, right_id, "dist_m")


def haversine_arrays(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``haversine_m`` on arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_R_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def nearest_by_grid(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                    l_lat: str = "lat", l_lon: str = "lon", r_lat: str = "lat", r_lon: str = "lon",
                    start_m: float = 2000.0, growth: float = 4.0, lat_bound: float | None = None) -> DataFrame:
    """J8 where the right side is too large for one tree.  Level ``i`` searches the 3x3 neighbourhood of cells of width
    ``start_m * growth**i``; a left point is settled once its best candidate
    is no farther than the cell width (anything outside the neighbourhood is
    farther).  Only unsettled points go on to the next, coarser level, so the
    pairs formed per point stay near the local density.  The last level's
    cells are wider than half the globe, so every point settles there; levels
    are written by reliable checkpoints.  Results are those of :func:`nearest`.
    """
    L = _prefixed(left, left_id, l_lat, l_lon, "l_")
    R = _prefixed(right, right_id, r_lat, r_lon, "r_").filter("r_lat is not null and r_lon is not null")
    if lat_bound is None:
        lat_bound = max_abs_lat((L, "l_lat"), (R, "r_lat"))
    nothing = L.select("l_id", F.lit(None).cast(dict(R.dtypes)["r_id"]).alias("r_id"), F.lit(None).cast("double").alias("dist_m"),
                       (F.col("l_lat").isNull() | F.col("l_lon").isNull()).alias("_lost"))
    if R.isEmpty():
        out = nothing.drop("_lost")
    else:
        remaining, cell = L.filter("l_lat is not null and l_lon is not null"), float(start_m)
        out = nothing.filter("_lost").drop("_lost")
        while not remaining.isEmpty():
            last = cell > HALF_GLOBE_M
            pairs = grid_pairs(remaining, R, cell, lat_bound, "l_lat", "l_lon", "r_lat", "r_lon")
            best = pairs.groupBy("l_id").agg(
                F.min_by(F.struct("r_id", "dist_m"), F.struct("dist_m", "r_id")).alias("b"))
            settled = cut_lineage(best.filter(F.lit(last) | (F.col("b.dist_m") <= F.lit(cell)))
                                  .select("l_id", F.col("b.r_id").alias("r_id"), F.col("b.dist_m").alias("dist_m")))
            out = out.unionByName(settled)
            if last:
                break
            remaining = cut_lineage(remaining.join(settled.select("l_id"), "l_id", "left_anti"))
            cell *= growth
    return out.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "dist_m")


def expand_one_hop(anchors: DataFrame, edges: DataFrame, group: str = "incident_id",
                   link: str = "link_id", neighbor: str = "neighbor_link_id", carry=()) -> DataFrame:
    """Anchors plus their neighbours, distinct per group (not across).

    The edge list becomes an adjacency table (A7, one bounded row per
    link, broadcast if its measured bytes are small); a group's
    few anchors bring their neighbours together as one array, made distinct
    and exploded.  Anchors that come partitioned by group (as from a ranking) are not
    shuffled again, and the expanded rows never are.
    ``carry`` columns are functions of the group and ride along.
    """
    from bandcast.operators.joins import broadcast_if_small
    adj = edges.groupBy(F.col(link)).agg(F.collect_set(F.col(neighbor)).alias("_nbrs"))
    j = anchors.select(group, link, *carry).join(broadcast_if_small(adj, persist=True), link, "left")
    own = F.array(F.col(link))
    links = F.array_distinct(F.flatten(F.collect_list(F.array_union(own, F.coalesce(F.col("_nbrs"), own)))))
    found = j.groupBy(group).agg(links.alias("_links"), *[F.first(c).alias(c) for c in carry])
    return found.select(group, *carry, F.explode("_links").alias(link))


def mapping_check(dim: DataFrame, mapping: DataFrame, key: str = "link_id") -> DataFrame:
    """Inner merge of a dimension with its mapping (rows that map)."""
    return dim.join(mapping, key, "inner")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Component label (smallest node id) of every node: star rounds until
    nothing changes (``graph.connected_components``); a node without an edge
    is its own component."""
    from bandcast.operators.graph import connected_components as star_components
    linked = star_components(edges, src, dst, "_node", "_label")
    own = nodes.select(F.col(node)).distinct()
    return own.join(linked, F.col(node) == F.col("_node"), "left") \
        .select(node, F.coalesce("_label", F.col(node)).alias("component"))
