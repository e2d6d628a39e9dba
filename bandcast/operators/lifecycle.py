"""Incident lifecycles from repeated snapshot sightings.

Semantics (greedy, online): rows are taken in time order (ties by source
row id).  A row joins the nearest *open* incident of the same type whose
first position is within ``max_dist_m`` and whose last sighting is at most
``max_gap_min`` earlier; an equal distance goes to the earlier incident.
Otherwise the row opens a new incident.  An incident keeps its first
position and first message; its end is its last sighting.

Distribution, exact by construction:
* state never crosses types, so ``type`` partitions the problem;
* a type-wide silence longer than the gap closes every open incident, so
  (type, session) partitions it too.  Sessions are found natively from the
  distinct (type, ts) pairs — one row per poll and type, small — with a
  lag + running sum, and joined back;
* inside a (type, session), sightings farther than ``max_dist_m`` apart never
  interact directly: an incident only takes sightings within the distance
  of its first position, and the nearest-incident choice is among those.
  So connected components of the distance graph over distinct sighting
  positions ("sites") partition it exactly as well.  When a (type, session)
  holds more than ``max_group_rows`` rows, the sites of those groups are
  linked by tiles (``site_components``) and split into components
  (``spatial.connected_components``), and each component is its own group;
  inside a component a silence longer than the gap closes all of its
  incidents, so components are cut again at their own time gaps;
* each group runs the greedy pass over its rows as a sorted stream of batches (a task holds a
  batch and the open incidents, never a group), with a grid of cells
  at least ``max_dist_m`` wide so a sighting is compared only with open
  incidents in its 3x3 neighbourhood; small consecutive sessions of a type
  go to one task (bin-packed by their row counts);
* a group that is still larger than ``slice_rows`` is cut into time slices, which run at
  once, each as if nothing were open before it.  A slice whose open
  incidents at the start turn out to be others (positions and last
  sightings, as handed over by the slice before) runs again with those, until no
  slice's change.  Who founded an incident does not change what
  a slice does (only a tie does, and then it counts), so an incident open
  through many slices is settled by joining its slices' pieces, not by running them
  one after the other.

A sighting without type, position or time can match nothing and is an
incident of its own.

``incident_id`` is the source id of an incident's first sighting: unique,
stable across re-runs and ordered like the creation order, with no global
numbering pass through one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandcast.functions.geo import EARTH_R_M, M_PER_DEG, haversine_m
from bandcast.functions.scalars import to_iso
from bandcast.operators.joins import broadcast_if_small
from bandcast.session import cut_lineage

SWEEP_ROWS = 20_000     # incidents a task holds, besides the open ones, before it hands on the closed ones

LIFECYCLE_SCHEMA = ("incident_id long, type string, lat double, lon double, start_ts long, end_ts long, "
                    "sightings long, message string")


def _hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_R_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


class OpenIncidents:
    """The greedy matching core of W5 and T3: each sighting joins the nearest
    incident (ties: the earlier one) that is near enough and not yet silent
    for longer than the gap, or founds a new one.  Time only moves forward.

    Incidents are indexed by bands of latitude, each cut into cells around
    the globe that are at least as wide as the distance anywhere in the band and its neighbours (one
    cell near the poles), so cells meet across the antimeridian."""

    def __init__(self, max_gap_min: float, max_dist_m: float):
        self.gap_s, self.max_dist_m = max_gap_min * 60.0, max_dist_m
        self.dlat = max(max_dist_m, 1.0) * 1.001 / M_PER_DEG
        self.rows: list[list] = []              # id, type, lat, lon, start, end, sightings, message
        self.grid: dict[tuple[int, int], list[int]] = {}
        self.cells: dict[int, int] = {}         # by band
        self.made = 0                           # incidents put so far; the last value of a row is its number
        self.swept = 0                          # rows that the last sweep left
        self.tied = False                       # whether a sighting had two nearest incidents

    def _cells(self, band: int) -> int:
        """Cells of a band: widths hold for latitudes up to a band beyond it."""
        top = (max(abs(band), abs(band + 1)) + 1) * self.dlat
        return max(1, int(360.0 * math.cos(math.radians(top)) / self.dlat)) if top < 89.9 else 1

    def put(self, row: list) -> None:
        if len(row) == 8:
            row.append(self.made)
            self.made += 1
        band = math.floor(row[2] / self.dlat)
        n = self._cells(band)
        self.grid.setdefault((band, math.floor((row[3] + 180.0) / 360.0 * n) % n), []).append(len(self.rows))
        self.rows.append(row)

    def sweep(self, ts) -> list[list]:
        """Incidents that no sighting from ``ts`` on can join; they leave.  Those that stay keep their order.

        Nothing is done until as many incidents again were founded as the last sweep left, so sweeps cost little."""
        if len(self.rows) < 2 * self.swept + SWEEP_ROWS:
            return []
        rows, self.rows, self.grid, closed = self.rows, [], {}, []
        for r in rows:
            if ts - r[5] > self.gap_s:
                closed.append(r)
            else:
                self.put(r)
        self.swept = len(self.rows)
        return closed

    def sight(self, sid, typ, lat, lon, ts, message) -> None:
        band, near, rows = math.floor(lat / self.dlat), [], self.rows
        for y in (band - 1, band, band + 1):
            n = self.cells.get(y)
            if n is None:
                n = self.cells[y] = self._cells(y)
            x = math.floor((lon + 180.0) / 360.0 * n)
            for cell in {(y, (x + dx) % n) for dx in (-1, 0, 1)}:
                if members := self.grid.get(cell):
                    members[:] = [k for k in members if ts - rows[k][5] <= self.gap_s]
                    if not members:
                        del self.grid[cell]
                    near += [(d, k) for k in members if abs(lat - rows[k][2]) < self.dlat
                             and (d := _hav(lat, lon, rows[k][2], rows[k][3])) <= self.max_dist_m]
        if near:
            best = min(near)
            self.tied = self.tied or sum(d == best[0] for d, _ in near) > 1
            row = self.rows[best[1]]
            row[5], row[6] = ts, row[6] + 1
        else:
            self.put([sid, typ, lat, lon, ts, ts, 1, message if isinstance(message, str) else None])


def lifecycle_frame(rows: list[list]) -> pd.DataFrame:
    names = ["incident_id", "type", "lat", "lon", "start_ts", "end_ts", "sightings", "message"]
    kinds = ["int64", object, float, float, "int64", "int64", "int64", object]
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=t) for k, (n, t) in enumerate(zip(names, kinds))}, columns=names)


def _in_segments(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[tuple, bool, pd.DataFrame]]:
    """The rows of sorted batches cut where a key changes: its key, whether a new one begins, and the rows."""
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        change = np.zeros(len(pdf), bool)
        change[0] = True
        for c in keys:
            x = pdf[c].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        starts = np.append(np.flatnonzero(change), len(pdf))
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(pdf[c].iat[a] for c in keys)
            yield key, key != last, pdf.iloc[a:b]
            last = key


def greedy_lifecycles(max_gap_min: float, max_dist_m: float):
    """The greedy pass over batches sorted by ``GROUP``, time and source id; each group starts from an empty state.

    A task holds a batch and the open incidents, not its groups: closed incidents are handed on as time passes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        incidents, found = None, []
        for (typ, *_), new, rows in _in_segments(batches, GROUP):
            if new:
                if incidents is not None:
                    found += incidents.rows
                incidents = OpenIncidents(max_gap_min, max_dist_m)
            for x in zip(*(rows[c].tolist() for c in ("src_id", "type", "lat", "lon", "ts", "message"))):
                incidents.sight(*x)
            found += incidents.sweep(x[4])
            if len(found) >= SWEEP_ROWS:
                yield lifecycle_frame(found)
                found = []
        yield lifecycle_frame(found + (incidents.rows if incidents is not None else []))

    return run


def _sorted_groups(rows: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """Rows with the groups ``by`` dealt whole to tasks and in order, so that a task can read them as a stream."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by, *order)


def type_sessions(snapshots: DataFrame, type_col: str = "type", ts: str = "ts",
                  max_gap_min: float = 15.0, chunk_seconds: int | str | None = "auto") -> DataFrame:
    """(type, ts, rows) -> session number; a new session after a silence >
    gap.  One row per poll and type: small for polled feeds.

    With continuous timestamps a busy type could dominate this table, so
    ``chunk_seconds`` (or ``"auto"``, measured) numbers sessions by time
    chunk: the previous time comes from the exact chunked ``lag_lead``, the
    session number is a running sum inside the chunk plus the total of the
    type's earlier chunks (a small per-(type, chunk) table).
    """
    from bandcast.operators.temporal import DAY, HOT_KEY_ROWS, hot_key_rows, lag_lead
    d = snapshots.groupBy(type_col, ts).agg(F.count(F.lit(1)).alias("rows"))
    if chunk_seconds == "auto":
        d = cut_lineage(d)                                 # measured, then used: computed once
        chunk_seconds = DAY if hot_key_rows(d, type_col) > HOT_KEY_ROWS else None
    gap = F.lit(float(max_gap_min))
    if not chunk_seconds:
        w = Window.partitionBy(type_col).orderBy(ts)
        new = F.when(F.lag(ts).over(w).isNull() | ((F.col(ts) - F.lag(ts).over(w)) / F.lit(60.0) > gap), 1).otherwise(0)
        return d.withColumn("_new", new).withColumn(
            "session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    x = lag_lead(d, type_col, ts, ts, {"_prev": 1}, chunk_seconds=chunk_seconds)
    x = x.withColumns({
        "_new": F.when(F.col("_prev").isNull() | ((F.col(ts) - F.col("_prev")) / F.lit(60.0) > gap), 1).otherwise(0),
        "_chunk": F.floor(F.col(ts) / F.lit(int(chunk_seconds))),
    })
    wi = Window.partitionBy(type_col, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_within", F.sum("_new").over(wi))
    tot = x.groupBy(type_col, "_chunk").agg(F.sum("_new").alias("_tot"))
    wo = Window.partitionBy(type_col).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_tot").over(wo), F.lit(0))).drop("_tot")
    return x.join(off, [type_col, "_chunk"]).withColumn("session", F.col("_off") + F.col("_within")) \
        .drop("_prev", "_new", "_chunk", "_within", "_off")


def component_sessions(rows: DataFrame, max_gap_min: float) -> DataFrame:
    """(type, session, component, ts) -> ``sub``: a time session of the
    component (new after a silence > gap), numbered from one distinct
    (component, ts) row per poll — small."""
    d = rows.select("type", "session", "component", "ts").distinct()
    w = Window.partitionBy("type", "session", "component").orderBy("ts")
    new = F.when(F.lag("ts").over(w).isNull() |
                 ((F.col("ts") - F.lag("ts").over(w)) / F.lit(60.0) > F.lit(float(max_gap_min))), 1).otherwise(0)
    return d.withColumn("_new", new).withColumn(
        "sub", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


PAIRS_OF_TILES = 1_000_000      # sites of two tiles that are compared one by one


def site_components(rows: DataFrame, max_dist_m: float, groups: DataFrame | None = None) -> DataFrame:
    """(type, session, lat, lon) -> component id (smallest site id) within
    the (type, session).  ``groups`` limits the work to listed sessions.

    Sites lie in tiles so small that all sites of a tile and of those around it are within the distance, so
    tiles are linked instead of sites, however crowded they are.  Sites are compared only where two tiles
    in reach are not linked through others; two tiles with more than ``PAIRS_OF_TILES`` pairs of sites are
    linked without that (a component may be larger than it must be then, which changes no lifecycle)."""
    from bandcast.operators.spatial import connected_components, grid_pairs, max_abs_lat
    sites = rows.select("type", "session", "lat", "lon", "src_id")
    if groups is not None:
        sites = sites.join(groups, ["type", "session"], "left_semi")
    side = max(max_dist_m, 1e-3) / (2 * math.sqrt(2) * 1.01) / M_PER_DEG          # degrees; four of them side by side fit the distance
    tile_of = lambda c: F.floor(F.col(c) / F.lit(side)).cast("bigint")
    sites = cut_lineage(sites.groupBy("type", "session", "lat", "lon").agg(F.min("src_id").alias("site"))
                        .withColumns({"ty": tile_of("lat"), "tx": tile_of("lon")}))
    tile = ["type", "session", "ty", "tx"]
    tiles = cut_lineage(sites.groupBy(*tile).agg(F.min(F.struct("site", "lat", "lon")).alias("first"), F.count("*").alias("n")))
    ahead = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    looks = tiles.select("type", "session", "ty", "tx", F.col("first.site").alias("src"), ahead.alias("_o")) \
        .select("type", "session", (F.col("ty") + F.col("_o.dy")).alias("ty"), (F.col("tx") + F.col("_o.dx")).alias("tx"), "src")
    edges = looks.join(tiles.select(*tile, F.col("first.site").alias("dst")).hint("merge"), tile).select("src", "dst")
    comp = connected_components(tiles.select(F.col("first.site").alias("id")), edges)
    tiles = cut_lineage(tiles.join(comp, F.col("first.site") == F.col("id")).drop("id"))
    apart = tiles.groupBy("type", "session").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b")
    lone = cut_lineage(tiles.join(apart, ["type", "session"], "left_semi"))
    joined = None
    if not lone.isEmpty():
        side_of = lambda p: lone.select(*[F.col(c).alias(f"{p}_{c}") for c in (*tile, "component", "n")], F.col("first.lat").alias(f"{p}_lat"),
                                        F.col("first.lon").alias(f"{p}_lon"))
        L, R = side_of("l"), side_of("r")
        pairs = grid_pairs(L, R, 2 * max_dist_m, max_abs_lat((L, "l_lat")), "l_lat", "l_lon", "r_lat", "r_lon",
                           keys=(("l_type", "r_type"), ("l_session", "r_session")))
        pairs = cut_lineage(pairs.filter((F.col("l_component") < F.col("r_component")) & (F.col("dist_m") <= F.lit(2.0 * max_dist_m)))
                            .select(*[f"{p}_{c}" for p in "lr" for c in (*tile, "component", "n")]))
        crowded = F.col("l_n") * F.col("r_n") > F.lit(PAIRS_OF_TILES)
        found = pairs.filter(~crowded)
        for p in "lr":
            found = found.join(sites.select(*[F.col(c).alias(f"{p}_{c}") for c in (*tile, "lat", "lon")]), [f"{p}_{c}" for c in tile])
        found = found.filter(haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= F.lit(float(max_dist_m)))
        links = found.unionByName(pairs.filter(crowded), allowMissingColumns=True) \
            .select(F.col("l_component").alias("src"), F.col("r_component").alias("dst")).distinct()
        joined = connected_components(lone.select(F.col("component").alias("id")).distinct(), links).withColumnRenamed("component", "_joined")
    out = sites.join(tiles.select(*tile, "component"), tile)
    if joined is not None:
        out = out.join(joined, F.col("component") == F.col("id"), "left").withColumn("component", F.coalesce("_joined", "component"))
    return out.select("type", "session", "lat", "lon", "component")


def cells_of_sites(lat: str, lon: str, max_dist_m: float) -> dict[str, Column]:
    """Cell of a position as in ``OpenIncidents``: its band ``cy``, its cell there ``cx``, and ``ux``, the
    cell that its longitude has in the band above (bands are cut into different numbers of cells)."""
    dlat = max(max_dist_m, 1.0) * 1.001 / M_PER_DEG
    band = F.floor(F.col(lat) / F.lit(dlat)).cast("bigint")

    def cell(y: Column) -> Column:
        n = _cells_of_band(y, dlat)
        return F.pmod(F.floor((F.col(lon) + F.lit(180.0)) / F.lit(360.0) * n).cast("bigint"), n)
    return {"cy": band, "cx": cell(band), "ux": cell(band + 1)}


def _cells_of_band(band: Column, dlat: float) -> Column:
    top = (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * F.lit(dlat)
    n = F.floor(F.lit(360.0) * F.cos(F.radians(top)) / F.lit(dlat)).cast("bigint")
    return F.when(top < F.lit(89.9), F.greatest(F.lit(1).cast("bigint"), n)).otherwise(F.lit(1).cast("bigint"))


def cell_components(rows: DataFrame, max_dist_m: float, groups: DataFrame) -> DataFrame:
    """(type, session, cy, cx) -> component id of the listed ``groups`` (few): cells that touch are linked, no sites are compared.

    Two sites within the distance lie in one cell or in touching ones, so no component parts them; one may be
    larger than it must be, which changes no lifecycle.  The work follows the cells, not the sites or their pairs."""
    from bandcast.operators.spatial import connected_components
    cell = ["type", "session", "cy", "cx"]
    spots = rows.join(F.broadcast(groups), ["type", "session"], "left_semi").withColumns(cells_of_sites("lat", "lon", max_dist_m))
    spots = cut_lineage(spots.groupBy(*cell, "ux").agg(F.min("src_id").alias("id")))
    cells = cut_lineage(spots.groupBy(*cell).agg(F.min("id").alias("id")))
    dlat = max(max_dist_m, 1.0) * 1.001 / M_PER_DEG
    here, above = _cells_of_band(F.col("cy"), dlat), _cells_of_band(F.col("cy") + 1, dlat)
    ahead = F.array(F.struct(F.col("cy").alias("y"), F.pmod(F.col("cx") + 1, here).alias("x")),
                    *[F.struct((F.col("cy") + 1).alias("y"), F.pmod(F.col("ux") + dx, above).alias("x")) for dx in (-1, 0, 1)])
    looks = spots.join(cells.withColumnRenamed("id", "src"), cell).select("type", "session", "src", F.explode(ahead).alias("_a")) \
        .select("type", "session", F.col("_a.y").alias("cy"), F.col("_a.x").alias("cx"), "src").distinct()
    edges = looks.join(cells.withColumnRenamed("id", "dst"), cell).filter("src <> dst").select("src", "dst")
    return cells.join(connected_components(cells.select("id"), edges), "id").select(*cell, "component")


GROUP = ["type", "session", "component", "bin"]
SLICE = [*GROUP, "slice"]
_KEYS = "type string, session long, component long, bin long, slice long"
OPEN_SCHEMA = f"{_KEYS}, lat double, lon double, end_ts long, start_ts long, incident_id long"
PIECE_SCHEMA = (f"{_KEYS}, seq long, inherited boolean, incident_id long, lat double, lon double, start_ts long, end_ts long, "
                "sightings long, message string, open boolean, tied boolean")


def _slice_pieces(max_gap_min: float, max_dist_m: float):
    """What slices do to the incidents handed to them, and what they found.  Batches are sorted by ``SLICE``; a slice has
    its incidents first (``handed``), then its sightings.  A task holds a batch and the open incidents, no whole slice."""
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    kinds = [{"string": object, "long": "Int64", "double": float, "boolean": bool}[f.split()[1]] for f in PIECE_SCHEMA.split(", ")]

    def pieces(key: tuple, incidents: OpenIncidents, rows: list[list], n: int, last) -> list[list]:
        return [[*key, r[8], r[8] < n, None if r[8] < n else r[0], r[2], r[3], None if r[8] < n else r[4], r[5], r[6], r[7],
                 bool(last - r[5] <= incidents.gap_s), incidents.tied] for r in rows]

    def frame(out: list[list]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=t) for k, (n, t) in enumerate(zip(names, kinds))}, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, incidents, n, last, out = None, None, 0, None, []
        for key, new, rows in _in_segments(batches, SLICE):
            if new:
                if last is not None:
                    out += pieces(at, incidents, incidents.rows, n, last)
                at, incidents, n, last = key, OpenIncidents(max_gap_min, max_dist_m), 0, None
            for handed, sid, lat, lon, ts, end, message in zip(*(rows[c].tolist() for c in ("handed", "src_id", "lat", "lon", "ts", "end_ts", "message"))):
                if handed:
                    incidents.put([sid, key[0], lat, lon, ts, end, 0, None])
                    n += 1
                else:
                    incidents.sight(sid, key[0], lat, lon, ts, message)
                    last = ts
            if last is not None:
                out += pieces(key, incidents, incidents.sweep(last), n, last)
            if len(out) >= SWEEP_ROWS:
                yield frame(out)
                out = []
        yield frame(out + (pieces(at, incidents, incidents.rows, n, last) if last is not None else []))

    return run


def _with_founders(pieces: DataFrame) -> DataFrame:
    """Every piece with the id and start of the incident it belongs to: open incidents lie further apart than the
    distance, so a piece that a slice inherited at a position continues the last one before it there."""
    w = Window.partitionBy(*GROUP, "lat", "lon").orderBy("slice", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumns({"incident_id": F.last("incident_id", ignorenulls=True).over(w),
                               "start_ts": F.last("start_ts", ignorenulls=True).over(w)})


def _signatures(handed: DataFrame, name: str) -> DataFrame:
    """Order-free marks of the incidents handed to each slice: of where and how old they are, and of who they are too."""
    state = F.xxhash64("lat", "lon", "end_ts")
    return handed.groupBy(*SLICE).agg(F.struct(F.count("*"), F.bit_xor(state), F.sum(F.hash("lat", "lon", "end_ts").cast("long"))).alias(f"{name}_state"),
                                      F.bit_xor(F.xxhash64("lat", "lon", "end_ts", "start_ts", "incident_id")).alias(f"{name}_who"))


def with_slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """``rows`` with a ``slice`` (1, 2, ... in time, without holes) of about ``slice_rows`` rows of their group."""
    at = rows.groupBy(*GROUP, "ts").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select(*GROUP, "ts", F.floor(F.coalesce(F.sum("n").over(w), F.lit(0)) / F.lit(int(slice_rows))).alias("start"))
    at = at.withColumn("slice", F.dense_rank().over(Window.partitionBy(*GROUP).orderBy("start")).cast("long")).drop("start")
    return rows.join(at, [*GROUP, "ts"])


def settled_pieces(rows: DataFrame, max_gap_min: float, max_dist_m: float, seeds: DataFrame | None = None) -> DataFrame:
    """What each slice of ``rows`` (``SLICE`` columns) does to each incident (``PIECE_SCHEMA``), incident ids settled.

    ``seeds`` are pieces of slice 0: incidents open before the first slice.
    Each round runs the slices whose handed-over incidents changed and
    writes the pieces; the driver gets the number of such slices.  The
    first slice never changes, so the second settles in the first round, and so on:
    the rounds end after as many as there are slices at most."""
    spark = rows.sparkSession
    state = [f.split()[0] for f in OPEN_SCHEMA.split(", ")]
    rows = cut_lineage(rows)
    slices = cut_lineage(rows.select(*SLICE).distinct())
    run = _slice_pieces(max_gap_min, max_dist_m)

    def handed_over(pieces: DataFrame) -> DataFrame:
        found = _with_founders(pieces).filter("open").withColumn("slice", F.col("slice") + 1)
        return cut_lineage(found.join(slices, SLICE, "left_semi").select(*state))

    pieces = spark.createDataFrame([], PIECE_SCHEMA) if seeds is None else cut_lineage(seeds)
    used = spark.createDataFrame([], OPEN_SCHEMA)
    changed, handed = slices, handed_over(pieces)
    while True:
        both = rows.select(*SLICE, F.lit(False).alias("handed"), "src_id", "lat", "lon", "ts", F.lit(None).cast("long").alias("end_ts"), "message") \
            .unionByName(handed.select(*SLICE, F.lit(True).alias("handed"), F.col("incident_id").alias("src_id"), "lat", "lon",
                                       F.col("start_ts").alias("ts"), F.coalesce("end_ts", F.lit(0)).alias("end_ts"), F.lit(None).cast("string").alias("message")))
        both = _sorted_groups(both.join(F.broadcast(changed), SLICE, "left_semi").withColumn("_later", ~F.col("handed")), SLICE, "_later", "ts", "src_id")
        new = both.mapInPandas(run, PIECE_SCHEMA)
        pieces = cut_lineage(pieces.join(changed, SLICE, "left_anti").unionByName(new))
        used = cut_lineage(used.join(changed, SLICE, "left_anti").unionByName(handed.join(changed, SLICE, "left_semi")))
        handed = handed_over(pieces)
        ties = pieces.filter("tied").select(*SLICE).distinct().withColumn("tied", F.lit(True))
        x = slices.join(_signatures(used, "old"), SLICE, "left").join(_signatures(handed, "new"), SLICE, "left").join(ties, SLICE, "left")
        changed = cut_lineage(x.filter(~F.col("old_state").eqNullSafe(F.col("new_state"))
                                       | (F.col("tied") & ~F.col("old_who").eqNullSafe(F.col("new_who")))).select(*SLICE))
        if changed.isEmpty():
            return _with_founders(pieces)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Lifecycles from settled pieces."""
    return pieces.groupBy(*GROUP, "incident_id").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.sum("sightings").alias("sightings"), F.max(F.when(~F.col("inherited"), F.col("message"))).alias("message")) \
        .select("incident_id", "type", "lat", "lon", "start_ts", "end_ts", "sightings", "message")


def sliced_lifecycles(rows: DataFrame, max_gap_min: float, max_dist_m: float, slice_rows: int) -> DataFrame:
    """Lifecycles of groups (``GROUP`` columns) whose rows run in time slices of about ``slice_rows`` rows."""
    return joined_pieces(settled_pieces(with_slices(rows, slice_rows), max_gap_min, max_dist_m))


def sightings_of(snapshots: DataFrame, type_col: str = "type", ts: str = "ts", src: str = "src_id") -> DataFrame:
    """Sightings under the names and types used here."""
    return snapshots.select(F.col(src).cast("long").alias("src_id"), F.col(type_col).cast("string").alias("type"),
                            F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                            F.col("message").cast("string").alias("message"), F.col(ts).cast("long").alias("ts"))


def can_match() -> Column:
    """Whether a sighting has a type, a time and a position."""
    ok = F.col("type").isNotNull() & F.col("ts").isNotNull()
    for c in ("lat", "lon"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def alone(sightings: DataFrame) -> DataFrame:
    """Sightings as incidents of their own."""
    return sightings.select(F.col("src_id").alias("incident_id"), "type", "lat", "lon", F.col("ts").alias("start_ts"),
                            F.col("ts").alias("end_ts"), F.lit(1).cast("long").alias("sightings"), "message")


def incident_lifecycles(snapshots: DataFrame, max_gap_min: float = 15.0, max_dist_m: float = 200.0,
                        type_col: str = "type", ts: str = "ts", src: str = "src_id",
                        max_group_rows: int | None = 2_000_000, rows_per_call: int = 200_000,
                        slice_rows: int | None = 2_000_000) -> DataFrame:
    """Snapshots (src_id, type, lat, lon, message, ts epoch seconds) ->
    lifecycles (incident_id, type, lat, lon, start/end epoch and ISO text,
    duration_min, message, sightings).  Every sighting is counted in one
    lifecycle; one without type, position (null or NaN) or time founds its own.

    ``max_group_rows``: (type, session) groups above it are split into
    distance components (0 splits every group; None never splits).
    ``slice_rows``: groups that are larger all the same run in time slices of about so many rows (None: never).
    ``rows_per_call``: consecutive sessions of a type are packed into one
    pandas call of about this many rows (from the small per-session size
    table), so thousands of tiny sessions do not pay a call each."""
    every = sightings_of(snapshots, type_col, ts, src)
    rows = every.filter(can_match())
    sess = type_sessions(rows, "type", "ts", max_gap_min)
    sizes = sess.groupBy("type", "session").agg(F.sum("rows").alias("rows"))
    w = Window.partitionBy("type").orderBy("session")
    sizes = sizes.withColumn("bin", F.floor((F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, 0))
                                             - F.col("rows")) / F.lit(int(rows_per_call))))
    sess = cut_lineage(sess.join(sizes.select("type", "session", "bin", F.col("rows").alias("session_rows")), ["type", "session"]))
    largest = sess.agg(F.max("session_rows")).first()[0] or 0
    rows = rows.join(broadcast_if_small(sess.select("type", "ts", "session", "bin", "session_rows")), ["type", "ts"])
    rows = rows.withColumn("component", F.lit(-1).cast("long"))
    if max_group_rows is not None and largest > max_group_rows:
        big = sess.filter(F.col("session_rows") > F.lit(max_group_rows)).select("type", "session").distinct()
        comp = site_components(rows, max_dist_m, big)
        rows = rows.drop("component").join(comp, ["type", "session", "lat", "lon"], "left") \
            .withColumn("component", F.coalesce(F.col("component"), F.lit(-1).cast("long")))
        # Inside a component a silence longer than the gap closes all of its
        # incidents too: split each component by its own time sessions.
        sub = cut_lineage(component_sessions(rows.filter(F.col("component") >= 0), max_gap_min))
        rows = rows.join(broadcast_if_small(sub), ["type", "session", "component", "ts"], "left")
        # a split session's (component, sub-session) pieces are groups of their own
        rows = rows.withColumn("bin", F.when(F.col("component") >= 0, -1 - F.col("sub")).otherwise(F.col("bin"))) \
            .drop("sub")
    rows = rows.drop("session_rows").withColumns({"session": F.col("session").cast("long"), "bin": F.col("bin").cast("long")})
    gap, dist = float(max_gap_min), float(max_dist_m)
    sliced = None
    if slice_rows is not None and largest > slice_rows:
        rows = cut_lineage(rows)
        over = cut_lineage(rows.groupBy(*GROUP).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(int(slice_rows))).select(*GROUP))
        if not over.isEmpty():
            sliced = sliced_lifecycles(rows.join(over, GROUP, "left_semi"), gap, dist, slice_rows)
            rows = rows.join(over, GROUP, "left_anti")

    rows = rows.select(*GROUP, "src_id", "lat", "lon", "ts", "message")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "type", "bin", "component").sortWithinPartitions(*GROUP, "ts", "src_id")
    out = rows.mapInPandas(greedy_lifecycles(gap, dist), LIFECYCLE_SCHEMA).unionByName(alone(every.filter(~can_match())))
    out = out if sliced is None else out.unionByName(sliced)
    return out.select(
        "incident_id", "type", "lat", "lon", "start_ts", "end_ts",
        to_iso(F.timestamp_seconds("start_ts")).alias("start_time_utc"),
        to_iso(F.timestamp_seconds("end_ts")).alias("end_time_utc"),
        ((F.col("end_ts") - F.col("start_ts")) / F.lit(60.0)).alias("duration_min"),
        "message", "sightings")
