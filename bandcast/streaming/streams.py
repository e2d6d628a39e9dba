"""Structured Streaming operators T1-T6.

Landed feed files are the source (file source, schema given up front); jobs
use ``trigger(availableNow=True)`` or a processing-time trigger, and every
sink has a checkpoint in the shared checkpoint folder, so a restarted or
retried query resumes exactly where it stopped.

* T1 ``stream_feed``: poll pages -> items (one micro-batch per trigger).
* T2 ``stream_dedupe``: ``dropDuplicatesWithinWatermark`` (bounded state).
* T3 ``stream_lifecycles``: ``applyInPandasWithState`` keyed by type; rows
  are buffered until the watermark passes them, then applied in event-time
  order, so the result equals the batch operator unless a row comes later
  than the allowed lateness; such rows are dropped.
* T4 ``stream_rollup``: tumbling event-time windows with a watermark.
* T5 ``stream_enrich``: stream-static joins (dimension, interval table).
* T6 ``stream_sessions``: ``session_window`` per key (gap rule only).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bandcast.operators.aggregates import first_per_key
from bandcast.operators.lifecycle import OpenIncidents, lifecycle_frame
from bandcast.session import checkpoint_dir, cut_lineage
from bandcast.sources.commits import BatchLog
from bandcast.sources.feeds import envelope, isolate_batches
from bandcast.sources.tables import fact_rows


# Plumbing -------------------------------------------------------------------------
def stream_workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one stream run."""
    root = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")
    return root


def land_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write rows as JSON lines (a stand-in for a collector landing files).
    Rows of one partition value are written by one task: one file per folder."""
    w = (df.repartition(partition) if partition else df).write.mode("append")
    if partition:
        w = w.partitionBy(partition)
    w.json(path)


def land_text(df: DataFrame, path: str, col: str = "json", partition: str | None = None) -> None:
    """Write one JSON document per line (feed pages), one file per folder."""
    x = df.select(col, *([partition] if partition else []))
    w = (x.repartition(partition) if partition else x).write.mode("append")
    if partition:
        w = w.partitionBy(partition)
    w.text(path)


def run_available_now(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, then stop (parquet sink + checkpoint)."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def start_every(df: DataFrame, out: str, checkpoint: str, interval: str = "5 minutes", mode: str = "append"):
    """T1 in production: a micro-batch every poll interval; returns the query."""
    return (df.writeStream.format("parquet").outputMode(mode).option("path", out)
            .option("checkpointLocation", checkpoint).trigger(processingTime=interval).start())


def stream_ingest(raw: DataFrame, normalize, strict: dict[str, str], fact_path: str, quarantine_path: str,
                  checkpoint: str, batch: Sequence[str] = ("snapshot_time",), entity: str | None = None,
                  available_now: bool = True, interval: str = "5 minutes", files_per_date: int | None = None,
                  hold_newest: bool = False):
    """S14 + S15 as one streaming query per feed: every micro-batch is split
    into polls that pass the strict casts (normalised, to the fact
    table) and polls that fail (raw, to the quarantine table, with the
    batch's id).  A failing feed never stops the other feeds' queries.

    Both tables are written into the micro-batch's own folders and become
    visible by one commit (:class:`~bandcast.sources.commits.BatchLog` at ``fact_path/_commits``; read them by
    :func:`ingested`), so a micro-batch that is retried after a failure
    between the two writes leaves no duplicate.

    A poll that has failed stays failed: rows of it that land later are
    quarantined too.  With ``hold_newest`` the rows of the newest poll
    wait (as state of the sink) until a newer poll lands, so a poll
    whose files arrive over several micro-batches is judged whole;
    :func:`release_held` ends the wait."""
    ingest = _Ingest(normalize, strict, fact_path, quarantine_path, batch, entity, files_per_date)
    w = raw.writeStream.foreachBatch(lambda df, i: ingest(df, i, hold_newest)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


class _Ingest:
    """One micro-batch of :func:`stream_ingest`."""

    def __init__(self, normalize, strict, fact_path, quarantine_path, batch=("snapshot_time",), entity=None, files_per_date=None):
        self.normalize, self.strict, self.batch, self.entity, self.files = normalize, strict, list(batch), entity, files_per_date
        self.facts, self.quarantine = fact_path.rstrip("/"), quarantine_path.rstrip("/")
        self.held = f"{self.facts}/_held"

    def __call__(self, df: DataFrame, batch_id: int, hold_newest: bool) -> None:
        log = BatchLog(df.sparkSession, f"{self.facts}/_commits")
        if log.has(batch_id):                     # committed, but the stream's own checkpoint had not seen it
            return
        before = log.last(batch_id)
        old = None if before is None else log.read(self.held, before[0])
        rows = cut_lineage(df if old is None else old.drop("batch").unionByName(df))
        poll = F.struct(*self.batch)
        newest = rows.agg(F.max(poll)).first()[0] if hold_newest else None
        held = rows.filter(poll == F.struct(*[F.lit(newest[c]) for c in self.batch])) if newest is not None else rows.limit(0)
        ready = rows.filter(poll != F.struct(*[F.lit(newest[c]) for c in self.batch])) if newest is not None else rows
        good, bad = isolate_batches(ready, self.strict, self.batch)
        known = log.read(self.quarantine)
        if known is not None:
            known = known.select(*self.batch).distinct()                       # a row per failed poll
            late = good.join(known, self.batch, "left_semi")
            good, bad = good.join(known, self.batch, "left_anti"), bad.unionByName(late)
        facts = fact_rows(self.normalize(good), entity=self.entity, files_per_date=self.files)
        bad = bad.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        log.write(facts, self.facts, batch_id, ["snapshot_date"], ([self.entity] if self.entity else []) + ["snapshot_time"])
        log.write(bad, self.quarantine, batch_id)
        log.write(held, self.held, batch_id)
        log.commit(batch_id, {self.facts: facts.schema, self.quarantine: bad.schema, self.held: held.schema})
        if before is not None:
            log.forget(self.held, before[0])


def release_held(spark: SparkSession, normalize, strict: dict[str, str], fact_path: str, quarantine_path: str,
                 batch: Sequence[str] = ("snapshot_time",), entity: str | None = None, files_per_date: int | None = None) -> None:
    """Judge the polls that still wait, as a batch of their own (numbered below 0, where no micro-batch is)."""
    ingest = _Ingest(normalize, strict, fact_path, quarantine_path, batch, entity, files_per_date)
    log = BatchLog(spark, f"{ingest.facts}/_commits")
    last = log.last()
    held = None if last is None else log.read(ingest.held, last[0])
    if held is None or held.isEmpty():
        return
    number = log.commits().agg(F.least(F.min("batch"), F.lit(0)).alias("n")).first()["n"] - 1
    ingest(cut_lineage(held.drop("batch")), number, False)
    log.forget(ingest.held, last[0])
    log.write(held.drop("batch").limit(0), ingest.held, last[0])


def ingested(spark: SparkSession, fact_path: str, quarantine_path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The committed fact and quarantine rows of :func:`stream_ingest` (None before the first commit)."""
    log = BatchLog(spark, f"{fact_path.rstrip('/')}/_commits")
    return tuple(None if t is None else t.drop("batch") for t in (log.read(fact_path), log.read(quarantine_path)))


# T1 ---------------------------------------------------------------------------------
def stream_feed(spark: SparkSession, path: str, item: T.StructType, partition: T.StructField | None = None,
                max_files_per_trigger: int | None = None, stamp: T.StructField | None = None,
                multi_line: bool = False) -> DataFrame:
    """Landed page lines ``{"value": [...]}`` -> one streaming row per item.

    The poll stamp comes from the folder (``partition``, e.g. ``poll=<epoch>``)
    or from a field of the page document (``stamp``)."""
    schema = envelope(item)
    if stamp is not None:
        schema = schema.add(stamp)
    if partition is not None:
        schema = schema.add(partition)
    r = spark.readStream.schema(schema)
    if multi_line:                      # one pretty-printed document per file
        r = r.option("multiLine", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.json(path)
    items = df.select(*[c for c in df.columns if c != "value"], F.explode("value").alias("item"))
    return items.select(*[c for c in items.columns if c != "item"], "item.*")


def stream_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


# T2 ---------------------------------------------------------------------------------
def stream_dedupe(df: DataFrame, keys: Sequence[str], event_time: str, horizon: str = "1 hour") -> DataFrame:
    """First arrival per key wins; state kept only for ``horizon`` past the
    watermark (the reference keeps every key forever; bounded here)."""
    return df.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))


def stream_first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, root: str, checkpoint: str,
                         available_now: bool = True, interval: str = "5 minutes"):
    """T2 by poll: of the rows of a key the first by ``order`` counts, however late it arrives.

    Every micro-batch reduces its rows per key and keeps those that are new
    or earlier than what is committed (looked up in the batch's ``day``
    partitions only); :func:`first_rows` reads the first of all.  Batches commit
    as in :func:`stream_ingest`, so a retried one adds nothing twice, and no row is forgotten after a horizon."""
    root = root.rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        log = BatchLog(batch.sparkSession, f"{root}/_commits")
        if log.has(batch_id):
            return
        new, known = first_per_key(batch, keys, order), log.read(root)
        if known is not None:
            new = cut_lineage(new)
            days = F.broadcast(new.select(day).distinct())              # a row per day of the batch
            old = first_per_key(known.join(days, day, "left_semi").drop("batch"), keys, order)
            old = old.select(*keys, F.struct(*order).alias("_known"))
            new = new.join(old, list(keys), "left").filter(F.col("_known").isNull() | (F.struct(*order) < F.col("_known"))).drop("_known")
        log.write(new, root, batch_id, [day])
        log.commit(batch_id, {root: new.schema})

    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
    if available_now:
        q.awaitTermination()
    return q


def first_rows(spark: SparkSession, keys: Sequence[str], order: Sequence[str], root: str) -> DataFrame | None:
    """The rows that :func:`stream_first_per_key` keeps, so far."""
    rows = BatchLog(spark, f"{root.rstrip('/')}/_commits").read(root)
    return None if rows is None else first_per_key(rows.drop("batch"), keys, order)


# T4 ---------------------------------------------------------------------------------
def stream_rollup(df: DataFrame, event_time: str, keys: Sequence[str], aggs: Sequence[Column],
                  window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling window rollup; rows later than the watermark are dropped;
    a window is emitted once the watermark passes its end (append mode)."""
    out = df.withWatermark(event_time, lateness).groupBy(F.window(event_time, window).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[c for c in out.columns if c != "w"])


# T5 ---------------------------------------------------------------------------------
def stream_enrich(stream: DataFrame, dim: DataFrame, key: str, intervals: DataFrame | None = None,
                  ts: str = "snapshot_ts") -> DataFrame:
    """Stream-static inner join to the dimension, then a left interval join
    (key equal, start <= ts <= end) to a static interval table."""
    out = stream.join(dim, key, "inner")
    if intervals is not None:
        iv = intervals.withColumnRenamed(key, "_ikey")
        out = out.join(iv, (out[key] == iv["_ikey"]) & out[ts].between(iv["start_ts"], iv["end_ts"]), "left") \
            .drop("_ikey")
    return out


# T6 ---------------------------------------------------------------------------------
def stream_sessions(df: DataFrame, event_time: str, keys: Sequence[str], gap: str = "15 minutes",
                    lateness: str = "15 minutes") -> DataFrame:
    """Session windows per key: a new session after a silence longer than the gap."""
    return (df.withWatermark(event_time, lateness)
            .groupBy(F.session_window(event_time, gap).alias("s"), *keys)
            .agg(F.count(F.lit(1)).alias("sightings"))
            .select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "sightings"))


# T3 ---------------------------------------------------------------------------------
LIFECYCLE_OUT = T.StructType([
    T.StructField("incident_id", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("start_ts", T.LongType()), T.StructField("end_ts", T.LongType()),
    T.StructField("sightings", T.LongType()), T.StructField("message", T.StringType()),
])
LIFECYCLE_STATE = T.StructType([T.StructField("buffer", T.StringType()), T.StructField("open", T.StringType())])


def _lifecycle_step(max_gap_min: float, max_dist_m: float):
    gap_s = max_gap_min * 60.0

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (typ,) = key
        buf, live = ([], []) if not state.exists else (json.loads(state.get[0]), json.loads(state.get[1]))
        for pdf in pdfs:
            buf += [[int(r.src_id), float(r.lat), float(r.lon), r.message if isinstance(r.message, str) else None,
                     int(r.ts)] for r in pdf.itertuples()]
        wm = state.getCurrentWatermarkMs() / 1000.0
        buf.sort(key=lambda r: (r[4], r[0]))
        ready = [r for r in buf if r[4] <= wm]
        buf = [r for r in buf if r[4] > wm]
        incidents = OpenIncidents(max_gap_min, max_dist_m)
        for row in live:
            incidents.put(row)
        for sid, lat, lon, message, t in ready:
            incidents.sight(sid, typ, lat, lon, t, message)
        frontier = min([wm] + [r[4] for r in buf])
        closed = [r for r in incidents.rows if frontier - r[5] > gap_s]
        live = [r for r in incidents.rows if frontier - r[5] <= gap_s]
        if buf or live:
            state.update((json.dumps(buf), json.dumps(live)))
            nxt = [r[4] for r in buf] + [r[5] + gap_s + 1 for r in live]
            state.setTimeoutTimestamp(int(max(min(nxt), wm) * 1000) + 1)
        else:
            state.remove()
        if closed:
            yield lifecycle_frame(closed)

    return step


def stream_lifecycles(df: DataFrame, max_gap_min: float = 15.0, max_dist_m: float = 200.0,
                      lateness: str = "15 minutes") -> DataFrame:
    """Incident lifecycles on a stream of sightings (src_id, type, lat,
    lon, message, ts epoch).  State per type: the open incidents and the
    rows not yet passed by the watermark.  An incident is emitted once the
    watermark is more than the gap past its last sighting.  Rows up to
    ``lateness`` behind the newest sighting of earlier micro-batches are taken
    in event-time order; rows later than that are dropped."""
    x = df.withColumn("_et", F.timestamp_seconds("ts")).withWatermark("_et", lateness)
    return x.groupBy("type").applyInPandasWithState(
        _lifecycle_step(float(max_gap_min), float(max_dist_m)), LIFECYCLE_OUT, LIFECYCLE_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)
