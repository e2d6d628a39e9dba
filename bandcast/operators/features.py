"""Feature-table operators: traffic windows, A2 incident rollup, the full
feature table, and the model frame the trainers and the cascade read.

Plan shape of ``feature_table``: one shuffle of the speed facts by
``link_id`` for the window; the road dimension is broadcast behind a size
check; the interval join and the final GROUP BY both reuse the
``link_id`` hash partitioning (their keys contain it), so only the interval
side is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandcast.functions.scalars import (flag, grid_bin, is_peak, is_weekend, length_proxy, local_dow,
                                        local_hour, midpoint, minutes_between, momentum)
from bandcast.operators.filters import between_ts, valid_bands
from bandcast.operators.joins import BUCKET_DEFAULTS, enrich, join_buckets
from bandcast.operators.temporal import DAY, chunk_of, enter_intervals, interval_join, lag_lead
from bandcast.sources.tables import write_bucketed

# The model's feature list (21 columns) and the 8-class list (15).
FEATURES = [
    "sb", "sb_tm5", "sb_tm10", "sb_tm15",
    "delta_0_5", "delta_5_10", "delta_10_15",
    "mid_lat", "mid_lon",
    "acceleration", "link_dist_proxy",
    "rain_mm", "is_raining",
    "road_category", "is_weekend", "is_peak",
    "incident_nearby", "mins_since_nearby_start",
    "nearby_accident", "nearby_roadwork", "nearby_breakdown",
]
MULTICLASS_FEATURES = [
    "sb", "sb_tm5", "sb_tm10", "sb_tm15",
    "delta_0_5", "delta_5_10", "delta_10_15",
    "road_category", "is_weekend", "is_peak",
    "incident_nearby", "mins_since_nearby_start",
    "nearby_accident", "nearby_roadwork", "nearby_breakdown",
]


def traffic_windows(speed: DataFrame, lo=None, hi=None, key: str = "link_id", ts: str = "snapshot_ts",
                    band: str = "speed_band", strict_step: int | None = None,
                    chunk_seconds: int | str | None = "auto", keep_chunk: str | None = None, null_keys: bool = True,
                    chunk_col: str | None = None) -> DataFrame:
    """The ``traffic`` stage: time range first (F1, pushed to the scan), then
    lags 1-3 and lead 3 over one window, local hour and day of week.  By
    default the window runs by link and day with a halo (no link is hot)."""
    if lo is not None and hi is not None:
        speed = between_ts(speed, lo, hi, ts)
    base = speed.select(key, ts, *([chunk_col] if chunk_col else []), F.col(band).alias("sb"))
    out = lag_lead(base, key, ts, "sb", {"sb_tm5": 1, "sb_tm10": 2, "sb_tm15": 3}, {"y_tp15": 3},
                   strict_step, chunk_seconds, keep_chunk=keep_chunk, null_keys=null_keys, chunk_col=chunk_col)
    return out.withColumns({"hour_sg": local_hour(F.col(ts)), "dow_sg": local_dow(F.col(ts))})


def incident_rollup(joined: DataFrame, keys: Sequence[str], ts: str = "snapshot_ts",
                    kind: str = "kind", began: str = "began") -> DataFrame:
    """A2: per feature row, the incident count, any-flag, minutes since the
    latest start and one max-flag per category."""
    agg = joined.groupBy(*keys).agg(
        F.count(kind).alias("incident_count_on_link"),
        F.max(began).alias("_max_start"),
        F.max(flag(F.col(kind) == "Accident")).alias("has_accident"),
        F.max(flag(F.col(kind) == "Roadwork")).alias("has_roadwork"),
        F.max(flag(F.col(kind) == "Vehicle breakdown")).alias("has_breakdown"),
    )
    return agg.withColumns({
        "incident_on_link": flag(F.col("incident_count_on_link") > 0),
        "mins_since_inc_start": minutes_between(F.col(ts), F.col("_max_start")),
    }).drop("_max_start")


FEATURE_KEYS = ["link_id", "snapshot_ts", "sb", "sb_tm5", "sb_tm10", "sb_tm15", "hour_sg", "dow_sg",
                "y_tp15", "road_category", "mid_lat", "mid_lon", "lat_bin", "lon_bin"]


def feature_table(speed: DataFrame, links: DataFrame, incidents: DataFrame, lo=None, hi=None,
                  interval_strategy: str = "auto", chunk_seconds: int | str | None = "auto",
                  day_col: str | None = None) -> DataFrame:
    """The 21-day feature table.

    ``incidents`` carries (link_id, start_ts, end_ts, type); rows with a null
    link are dropped (F3).  Road links join inner (J1: facts without a road
    are dropped); incidents join left by interval (J3).

    By default everything runs by (link, day): the facts are shuffled once for the
    windows, intervals are entered under each day they touch, and join
    and rollup reuse that partitioning, so no link can be too large for a task.
    ``chunk_seconds=None`` or ``interval_strategy="merge"`` run by link.

    ``day_col`` names a column of both ``speed`` and ``incidents`` that holds the day (``bucketed_inputs``):
    facts from tables bucketed by (link, day) are not shuffled, only the first and last rows of each day are.
    """
    if day_col and (not chunk_seconds or interval_strategy == "merge"):
        raise ValueError("a day column needs the run by (link, day)")
    chunk = DAY if chunk_seconds == "auto" else chunk_seconds
    by_day = bool(chunk) and interval_strategy != "merge"
    speed = speed.filter(F.col("link_id").isNotNull())      # a fact without a link has no road
    day = day_col or ("_day" if by_day else None)
    t = valid_bands(traffic_windows(speed, lo, hi, chunk_seconds=chunk, keep_chunk=day, null_keys=False, chunk_col=day_col))
    roads = links.select(
        "link_id", "road_category",
        midpoint("start_lat", "end_lat").alias("mid_lat"),
        midpoint("start_lon", "end_lon").alias("mid_lon"),
    ).withColumns({"lat_bin": grid_bin("mid_lat"), "lon_bin": grid_bin("mid_lon")})
    inc = incidents.filter(F.col("link_id").isNotNull()).select(
        "link_id", "start_ts", "end_ts", F.col("type").alias("kind"), *([F.col(day_col).alias("_entered")] if day_col else []))
    j = enrich(t, roads, "link_id", "inner")
    j = interval_join(j, inc, strategy="bucket", bucket_seconds=chunk, bucket=day, entered="_entered" if day_col else None) if by_day else \
        interval_join(j, inc, strategy=interval_strategy)
    j = j.withColumnRenamed("start_ts", "began").drop("end_ts")
    return incident_rollup(j, FEATURE_KEYS + ([day] if day else [])).drop(day or "_day")


def bucketed_inputs(speed: DataFrame, incidents: DataFrame, name: str, buckets: int, path: str | None = None,
                    by_day: bool = True, chunk_seconds: int = DAY) -> tuple[DataFrame, DataFrame]:
    """Write the facts and the intervals of a feature table once as bucketed tables ``<name>_facts`` and ``<name>_intervals``.

    ``by_day`` buckets by (link, day), the day in ``_day``, for ``feature_table(day_col="_day")``: no link can
    be too large for a bucket.  Without it the tables are bucketed by link, for ``chunk_seconds=None`` and
    ``interval_strategy="merge"``: window, join and rollup need no exchange at all, but a bucket holds whole
    links.  Rows without a link are left out, as the feature table has no place for them.
    """
    s, i = speed.filter(F.col("link_id").isNotNull()), incidents.filter(F.col("link_id").isNotNull())
    by = ["link_id"]
    if by_day:
        s, i, by = s.withColumn("_day", chunk_of("snapshot_ts", chunk_seconds)), enter_intervals(i, chunk_seconds, out="_day"), ["link_id", "_day"]
    place = (lambda t: f"{path.rstrip('/')}/{t}") if path else (lambda t: None)
    return (write_bucketed(s, f"{name}_facts", by, buckets, [*by, "snapshot_ts"], place("facts")),
            write_bucketed(i, f"{name}_intervals", by, buckets, [*by, "start_ts"], place("intervals")))


def model_frame(features: DataFrame, links: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Features + road geometry (J2, left) + incident buckets (J4 with
    defaults) + momentum, distance proxy and time context (P13, P18-P20)."""
    roads = links.select("link_id", "start_lat", "end_lat", "start_lon", "end_lon")
    f = enrich(features, roads, "link_id", "left")
    if buckets is not None:
        f = join_buckets(f, buckets, defaults=BUCKET_DEFAULTS)
    f = momentum(f.withColumn("road_category", F.col("road_category").cast("int")))
    return f.withColumns({
        "link_dist_proxy": length_proxy("start_lat", "start_lon", "end_lat", "end_lon"),
        "is_weekend": is_weekend("dow_sg"),
        "is_peak": is_peak("hour_sg"),
    })
