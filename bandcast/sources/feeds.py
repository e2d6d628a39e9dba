"""Feed ingest: S1-S13, S15.

A poll of one feed lands as JSON page files (``{"value": [...]}``, at most
one page per file) under ``<root>/<feed>/snapshot=<epoch>/``; the directory
value becomes the ``snapshot`` column (S13: one stamp per poll cycle shared
by every feed).  Pages are parsed in parallel, one task per file; nothing
is read on the driver.  The same normalisers also accept JSON text already
in a DataFrame (``parse_feed``), which is what the streaming path uses.

Fields are read as STRING so that the reference's two cast disciplines can be
kept apart: ``safe_int`` never fails, strict casts fail the batch — and with
``isolate_batches`` a failing batch is quarantined instead of failing every
feed (S15).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandcast.functions.scalars import safe_int, text_or_none
from bandcast.operators.aggregates import first_per_key
from bandcast.operators.joins import broadcast_if_small


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# The item fields of each feed (the public API's names).
SPEED_ITEM = _struct("LinkID", "RoadName", "RoadCategory", "SpeedBand", "MinimumSpeed", "MaximumSpeed",
                     "StartLat", "StartLon", "EndLat", "EndLon")
INCIDENT_ITEM = _struct("Type", "Latitude", "Longitude", "Message")
TRAVEL_ITEM = _struct("Name", "Direction", "FarEndPoint", "StartPoint", "EndPoint", "EstTime")
FAULTY_ITEM = _struct("AlarmID", "NodeID", "Type", "StartDate", "EndDate", "Message")
SIGN_ITEM = _struct("EquipmentID", "Latitude", "Longitude", "Message")
ALERT_ROW = _struct("Status", "Line", "Direction", "Stations", "FreePublicBus", "FreeMRTShuttle",
                    "MRTShuttleDirection", "Message", "CreatedDate")
ALERT_OBJECT = T.StructType([
    T.StructField("Status", T.StringType()),
    T.StructField("FreePublicBus", T.StringType()),
    T.StructField("FreeMRTShuttle", T.StringType()),
    T.StructField("Line", T.ArrayType(_struct("Line", "Direction", "Stations", "MRTShuttleDirection"))),
    T.StructField("Message", T.ArrayType(_struct("Content", "CreatedDate"))),
])
_LOC = _struct("latitude", "longitude")
RAIN_DOC = T.StructType([T.StructField("data", T.StructType([
    T.StructField("stations", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("labelLocation", _LOC), T.StructField("location", _LOC)]))),
    T.StructField("readings", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("data", T.ArrayType(_struct("stationId", "value")))]))),
]))])


def envelope(item: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("value", T.ArrayType(item))])


# S1 -----------------------------------------------------------------------------
def read_feed(spark: SparkSession, path: str, item: T.StructType, corrupt: bool = False) -> DataFrame:
    """Page files -> one row per item; a missing or empty ``value`` gives no
    rows.  ``corrupt`` keeps unparsable files as ``_corrupt_record`` rows."""
    schema = envelope(item)
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    if corrupt:
        schema = schema.add("_corrupt_record", T.StringType())
        r = r.option("columnNameOfCorruptRecord", "_corrupt_record")
    df = r.schema(schema).json(path).withColumn("_file", F.input_file_name())
    items = df.select(*[c for c in df.columns if c != "value"], F.explode("value").alias("item"))
    return items.select(*[c for c in items.columns if c != "item"], "item.*")


def parse_feed(text: DataFrame, item: T.StructType, col: str = "json", position: str | None = None) -> DataFrame:
    """JSON page text in a column -> one row per item (same rules as S1).
    ``position`` names a column for the item's place in its page (from 0), which
    with a page column gives the feed order that first-wins rules need."""
    doc = text.withColumn("_doc", F.from_json(F.col(col), envelope(item))).drop(col)
    keep = [c for c in doc.columns if c != "_doc"]
    items = doc.select(*keep, F.posexplode("_doc.value").alias(position, "item") if position
                       else F.explode("_doc.value").alias("item"))
    return items.select(*[c for c in items.columns if c != "item"], "item.*")


def stamp_snapshot(df: DataFrame, ts, col: str = "snapshot_time") -> DataFrame:
    """One stamp for every row of a poll cycle (a literal or a column)."""
    return df.withColumn(col, ts if isinstance(ts, Column) else F.lit(ts))


# S2-S7 ------------------------------------------------------------------------------
def normalize_speedbands(raw: DataFrame, ts: str = "snapshot_time") -> DataFrame:
    """Speed fact; band and speeds by safe int cast."""
    return raw.select(F.col("LinkID").alias("link_id"), safe_int("SpeedBand").alias("speed_band"),
                      safe_int("MinimumSpeed").alias("min_speed"), safe_int("MaximumSpeed").alias("max_speed"),
                      F.col(ts).alias("snapshot_time"))


def road_link_rows(raw: DataFrame, ts: str = "snapshot_time", parity: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """S3 input: the road dimension as seen in one speed poll (strict floats); ``keep`` lists
    further columns, such as page and position, for ``upsert_first``'s order."""
    return raw.select(F.col("LinkID").alias("link_id"), F.col("RoadName").alias("road_name"),
                      text_or_none("RoadCategory", parity).alias("road_category"),
                      F.col("StartLat").cast("double").alias("start_lat"),
                      F.col("StartLon").cast("double").alias("start_lon"),
                      F.col("EndLat").cast("double").alias("end_lat"),
                      F.col("EndLon").cast("double").alias("end_lon"),
                      F.col(ts).alias("snapshot_time"), *keep)


def upsert_first(dim: DataFrame | None, new: DataFrame, key: str | Sequence[str],
                 order: Sequence[str] = ("snapshot_time",)) -> DataFrame:
    """S3 insert-or-ignore: existing keys keep their row; among new rows the
    first (by ``order``) of each key wins.  Anti-join + union, no update."""
    keys = [key] if isinstance(key, str) else list(key)
    first = first_per_key(new, keys, list(order))
    if dim is None:
        return first
    fresh = first.join(dim.select(*keys), keys, "left_anti")
    return dim.unionByName(fresh.select(*dim.columns))


def normalize_incidents(raw: DataFrame, ts: str = "snapshot_time") -> DataFrame:
    """Incidents; latitude/longitude strict floats."""
    return raw.select(F.col("Type").alias("type"), F.col("Latitude").cast("double").alias("lat"),
                      F.col("Longitude").cast("double").alias("lon"), F.col("Message").alias("message"),
                      F.col(ts).alias("snapshot_time"))


def normalize_travel_times(raw: DataFrame, ts: str = "snapshot_time", parity: bool = True) -> DataFrame:
    """Direction and est_time safe ints; three point texts via str()."""
    return raw.select(F.col("Name").alias("name"), safe_int("Direction").alias("direction"),
                      text_or_none("FarEndPoint", parity).alias("far_end_point"),
                      text_or_none("StartPoint", parity).alias("start_point"),
                      text_or_none("EndPoint", parity).alias("end_point"),
                      safe_int("EstTime").alias("est_time"), F.col(ts).alias("snapshot_time"))


def normalize_faulty_lights(raw: DataFrame, ts: str = "snapshot_time") -> DataFrame:
    """Type is a strict int; dates and message optional."""
    return raw.select(F.col("AlarmID").alias("alarm_id"), F.col("NodeID").alias("node_id"),
                      F.col("Type").cast("int").alias("type"), F.col("StartDate").alias("start_date"),
                      F.col("EndDate").alias("end_date"), F.col("Message").alias("message"),
                      F.col(ts).alias("snapshot_time"))


def normalize_signs(raw: DataFrame, ts: str = "snapshot_time") -> DataFrame:
    """Message signs; coordinates strict floats."""
    return raw.select(F.col("EquipmentID").alias("equipment_id"), F.col("Latitude").cast("double").alias("lat"),
                      F.col("Longitude").cast("double").alias("lon"), F.col("Message").alias("message"),
                      F.col(ts).alias("snapshot_time"))


# S8 -----------------------------------------------------------------------------
def flatten_alerts(text: DataFrame, col: str = "json", ts: str = "snapshot_time") -> DataFrame:
    """``value`` as an object -> one row per ``Line[]`` element carrying the
    top-level Status/bus/shuttle and the first message; as a list -> rows as
    they are; null or anything else -> nothing.  No segments, no rows."""
    doc = text.withColumn("_v", F.get_json_object(F.col(col), "$.value"))
    kind = F.when(F.trim("_v").startswith("{"), "object").when(F.trim("_v").startswith("["), "list")
    doc = doc.withColumn("_kind", kind)
    obj = doc.filter(F.col("_kind") == "object").withColumn("_o", F.from_json("_v", ALERT_OBJECT))
    first_msg = F.get(F.col("_o.Message"), 0)
    seg = obj.select(F.col(ts), "_o", first_msg.alias("_m"), F.explode("_o.Line").alias("_s")).filter(
        F.col("_s").isNotNull())
    from_obj = seg.select(
        F.col("_o.Status").alias("Status"), F.col("_s.Line").alias("Line"), F.col("_s.Direction").alias("Direction"),
        F.col("_s.Stations").alias("Stations"), F.col("_o.FreePublicBus").alias("FreePublicBus"),
        F.col("_o.FreeMRTShuttle").alias("FreeMRTShuttle"),
        F.col("_s.MRTShuttleDirection").alias("MRTShuttleDirection"),
        F.col("_m.Content").alias("Message"), F.col("_m.CreatedDate").alias("CreatedDate"), F.col(ts))
    lst = doc.filter(F.col("_kind") == "list").select(
        F.col(ts), F.explode(F.from_json("_v", T.ArrayType(ALERT_ROW))).alias("_r"))
    from_list = lst.select(*[F.col(f"_r.{f.name}").alias(f.name) for f in ALERT_ROW.fields], F.col(ts))
    rows = from_obj.unionByName(from_list)
    return rows.select(safe_int("Status").alias("status"), F.col("Line").alias("line"),
                       F.col("Direction").alias("direction"), F.col("Stations").alias("stations"),
                       F.col("FreePublicBus").alias("free_bus"), F.col("FreeMRTShuttle").alias("free_shuttle"),
                       F.col("MRTShuttleDirection").alias("shuttle_direction"), F.col("Message").alias("message"),
                       F.col("CreatedDate").alias("created_time"), F.col(ts).alias("snapshot_time"))


# S9, S10, S12 ---------------------------------------------------------------------
def normalize_stations(text: DataFrame, col: str = "json", ts: str = "snapshot_time",
                       loc_field: str = "labelLocation") -> DataFrame:
    """``data.stations[]``; coordinates from ``labelLocation``, null when
    missing.  Apply ``upsert_first`` for first-wins."""
    doc = text.select(F.col(ts), F.from_json(F.col(col), RAIN_DOC).alias("_d"))
    st = doc.select(F.col(ts), F.explode("_d.data.stations").alias("_s"))
    return st.select(F.col("_s.id").alias("station_id"), F.col("_s.name").alias("loc_name"),
                     F.col(f"_s.{loc_field}.latitude").cast("double").alias("lat"),
                     F.col(f"_s.{loc_field}.longitude").cast("double").alias("lon"),
                     F.col(ts).alias("snapshot_time"))


def normalize_rainfall(text: DataFrame, col: str = "json", ts: str = "snapshot_time",
                       position: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Double explode ``readings[] x data[]`` carrying the outer timestamp;
    value is a strict float.  ``position`` names a struct column with the places
    of the reading and of its value, for first-wins inside a poll (S11);
    ``keep`` lists further columns of ``text``, such as the page."""
    doc = text.select(F.col(ts), *keep, F.from_json(F.col(col), RAIN_DOC).alias("_d"))
    rd = doc.select(F.col(ts), *keep, F.posexplode("_d.data.readings").alias("_rp", "_r"))
    e = rd.select(F.col(ts), *keep, "_rp", F.col("_r.timestamp").alias("reading_time"), F.posexplode("_r.data").alias("_ep", "_e"))
    return e.select(F.col("_e.stationId").alias("station_id"), F.col("_e.value").cast("double").alias("value_mm"),
                    "reading_time", F.col(ts).alias("snapshot_time"),
                    *keep, *([F.struct("_rp", "_ep").alias(position)] if position else []))


def update_by_key(dim: DataFrame, upd: DataFrame, key: str, cols: Sequence[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE dim SET cols WHERE key matches, only for update rows whose
    listed values are all truthy (0.0 and '' are skipped, as the reference's
    ``if lat and lon``).  Of several updates of a key the last in ``order``
    (a column; default: row order) wins.  Returns (new dim, one-row count of the updates
    that hit an existing row)."""
    cols = list(cols)
    truthy = F.lit(True)
    for c in cols:
        truthy = truthy & F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("double") != 0.0)
    ok = upd.withColumn("_pos", F.monotonically_increasing_id() if order is None else F.col(order)).filter(truthy) \
        .select(F.col(key), "_pos", *[F.col(c).alias(f"_u_{c}") for c in cols])
    u = first_per_key(ok, [key], ["_pos"], desc=True).drop("_pos")       # a key updated twice: the last one wins
    j = dim.join(u, key, "left")
    new = j.select(*[F.coalesce(F.col(f"_u_{c}").cast(t), F.col(c)).alias(c) if c in cols else F.col(c)
                     for c, t in dim.dtypes])
    # one count per UPDATE that hit an existing row (a key listed twice counts twice)
    cnt = ok.join(dim.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("updated"))
    return new, cnt


# S15 -------------------------------------------------------------------------------
def strict_violations(df: DataFrame, strict: Mapping[str, str]) -> Column:
    """True where a strict cast of a listed (raw text) column would fail; a missing value fails too."""
    bad = F.lit(False)
    for c, t in strict.items():
        bad = bad | F.col(c).try_cast(t).isNull()
    return bad


def isolate_batches(raw: DataFrame, strict: Mapping[str, str], batch: Sequence[str] = ("snapshot_time",)
                    ) -> tuple[DataFrame, DataFrame]:
    """A batch (one poll of one feed) with any strict-cast failure is
    quarantined whole; every other batch proceeds.  The set of bad batches is
    tiny (one row per failed poll) and joins back by broadcast behind a
    size check.  Returns (good rows, quarantined rows)."""
    keys = list(batch)
    flagged = raw.withColumn("_bad", strict_violations(raw, strict))
    bad = flagged.filter("_bad").select(*keys).distinct()
    b = broadcast_if_small(bad, persist=True)
    good = flagged.join(b, keys, "left_anti").drop("_bad")
    quarantined = flagged.join(b, keys, "left_semi").drop("_bad")
    return good, quarantined
