"""Incident lifecycles on a stream of sightings, distributed below the type.

Every micro-batch is a time slice of W5.  The sink's state, two tables that
are versioned by batch (:mod:`bandcast.sources.commits`), holds the open incidents and the sightings that
the watermark has not passed; a micro-batch runs the sightings that it now passes, in event-time
order, against the open incidents, emits those that no
later sighting can join, and commits output and state together.  A restarted
or replayed micro-batch therefore changes nothing twice.

Within a micro-batch the work is W5's: groups of many sightings are split
into components of touching cells at least as wide as the distance (positions of sightings and of open incidents; no
sites are compared), a component that is still too large runs in time slices, and each is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandcast.operators.joins import broadcast_if_small
from bandcast.operators.lifecycle import (GROUP, LIFECYCLE_SCHEMA, PIECE_SCHEMA, alone, can_match, cell_components, cells_of_sites,
                                          joined_pieces, settled_pieces, sightings_of, with_slices)
from bandcast.session import cut_lineage
from bandcast.sources.commits import BatchLog

SIGHTING_SCHEMA = "src_id long, type string, lat double, lon double, message string, ts long"


class LifecycleSink:
    """The ``foreachBatch`` function of :func:`start_lifecycles`; its tables lie under ``root``."""

    def __init__(self, root: str, max_gap_min: float = 15.0, max_dist_m: float = 200.0, lateness_s: int = 900,
                 max_group_rows: int = 200_000, slice_rows: int = 2_000_000):
        self.gap, self.dist, self.lateness = float(max_gap_min), float(max_dist_m), int(lateness_s)
        self.max_group_rows, self.slice_rows = max_group_rows, slice_rows
        root = root.rstrip("/")
        self.log_path, self.closed, self.late = f"{root}/commits", f"{root}/closed", f"{root}/late"
        self.open, self.pending = f"{root}/open", f"{root}/pending"

    def _state(self, spark: SparkSession, log: BatchLog, before: tuple[int, dict] | None) -> tuple[DataFrame, DataFrame]:
        if before is None:
            return spark.createDataFrame([], LIFECYCLE_SCHEMA), spark.createDataFrame([], SIGHTING_SCHEMA)
        return tuple(log.read(t, before[0]).drop("batch") for t in (self.open, self.pending))

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        log = BatchLog(spark, self.log_path)
        if log.has(batch_id):
            return
        before = log.last(batch_id)
        open_, pending = self._state(spark, log, before)
        newest = None if before is None else before[1]["newest"]
        rows = cut_lineage(sightings_of(df))
        late = F.lit(False) if newest is None else can_match() & (F.col("ts") < F.lit(newest - self.lateness))
        top = rows.filter(can_match()).agg(F.max("ts")).first()[0]
        newest = max((x for x in (newest, top) if x is not None), default=None)
        waiting = pending.unionByName(rows.filter(can_match() & ~late))
        passed = F.lit(False) if newest is None else F.col("ts") < F.lit(newest - self.lateness)
        found = self._run(cut_lineage(waiting.filter(passed)), cut_lineage(open_))
        # a later sighting is at the watermark at the earliest
        over = F.lit(False) if newest is None else F.lit(newest - self.lateness) - F.col("end_ts") > F.lit(self.gap * 60.0)
        done = found.filter(over).unionByName(alone(rows.filter(~can_match())))
        tables = {self.closed: done, self.late: rows.filter(late), self.open: found.filter(~over), self.pending: waiting.filter(~passed)}
        for path, table in tables.items():
            log.write(table, path, batch_id)
        log.commit(batch_id, {path: table.schema for path, table in tables.items()}, newest=newest)
        if before is not None:
            log.forget(self.open, before[0])
            log.forget(self.pending, before[0])

    def _run(self, ready: DataFrame, open_: DataFrame) -> DataFrame:
        """All incidents (open before or founded now) after the sightings of ``ready``."""
        one = {"session": F.lit(0).cast("long"), "component": F.lit(-1).cast("long"), "bin": F.lit(0).cast("long")}
        ready, open_ = ready.withColumns(one), open_.withColumns(one)
        large = ready.groupBy("type").agg(F.count("*").alias("n")).filter(F.col("n") > self.max_group_rows).select("type", F.lit(0).cast("long").alias("session"))
        if not (large := cut_lineage(large)).isEmpty():
            # ids are unique over sightings, and an incident has the id of its founder
            places = ready.select("type", "session", "lat", "lon", "src_id").unionByName(
                open_.select("type", "session", "lat", "lon", F.col("incident_id").alias("src_id")))
            parts = broadcast_if_small(cell_components(places, self.dist, large), persist=True)
            cell = cells_of_sites("lat", "lon", self.dist)
            ready, open_ = (t.drop("component").withColumns({"cy": cell["cy"], "cx": cell["cx"]}).join(parts, ["type", "session", "cy", "cx"], "left")
                            .withColumn("component", F.coalesce("component", F.lit(-1).cast("long"))).drop("cy", "cx") for t in (ready, open_))
        names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
        seeds = open_.withColumns({"slice": F.lit(0).cast("long"), "seq": F.lit(0).cast("long"), "inherited": F.lit(False),
                                   "open": F.lit(True), "tied": F.lit(False)}).select(*names)
        rows = with_slices(ready, self.slice_rows).select(*GROUP, "slice", "src_id", "lat", "lon", "message", "ts")
        return cut_lineage(joined_pieces(settled_pieces(rows, self.gap, self.dist, seeds)))


def start_lifecycles(df: DataFrame, root: str, checkpoint: str, max_gap_min: float = 15.0, max_dist_m: float = 200.0,
                     lateness_s: int = 900, max_group_rows: int = 200_000, slice_rows: int = 2_000_000,
                     available_now: bool = True, interval: str = "5 minutes"):
    """A stream of sightings (src_id, type, lat, lon, message, ts epoch seconds) into closed incidents under ``root``.

    The watermark is ``lateness_s`` behind the newest sighting.  Sightings that it has not passed when they land
    are taken in event-time order, whatever their batch; those it has passed are
    kept in a table of their own (:func:`late_sightings`), never dropped.  An incident is
    emitted once the watermark is more than the gap past its last
    sighting.  A sighting without type, position or time is emitted at once as an incident of its own.
    Results equal W5 over all sightings that were not late."""
    sink = LifecycleSink(root, max_gap_min, max_dist_m, lateness_s, max_group_rows, slice_rows)
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def _read(spark: SparkSession, root: str, name: str, schema: str, latest: bool = False) -> DataFrame:
    log = BatchLog(spark, f"{root.rstrip('/')}/commits")
    last = log.last()
    rows = None if last is None else log.read(f"{root.rstrip('/')}/{name}", last[0] if latest else None)
    return spark.createDataFrame([], T._parse_datatype_string(schema)) if rows is None else rows.drop("batch")


def closed_lifecycles(spark: SparkSession, root: str) -> DataFrame:
    """Incidents emitted so far."""
    return _read(spark, root, "closed", LIFECYCLE_SCHEMA)


def open_lifecycles(spark: SparkSession, root: str) -> DataFrame:
    """Incidents that a later sighting could still join, as of the newest committed batch."""
    return _read(spark, root, "open", LIFECYCLE_SCHEMA, latest=True)


def late_sightings(spark: SparkSession, root: str) -> DataFrame:
    """Sightings that landed after the watermark had passed them."""
    return _read(spark, root, "late", SIGHTING_SCHEMA)
