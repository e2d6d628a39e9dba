"""Scalar column functions (projections).

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none is a Python UDF.  Epoch arguments are seconds (BIGINT or DOUBLE).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
SGT_OFFSET_HOURS = 8                     # Singapore local time, UTC+8, no DST
PEAK_HOURS = (7, 8, 9, 17, 18, 19)       # local hours counted as peak
WEEKEND_DOWS = (0, 6)                    # Sunday = 0, Saturday = 6
ACTIVE_START_HOUR = 4                    # polling window start, local hour
ACTIVE_END_HOUR = 22                     # polling window end (exclusive)
TICK_SECONDS = 300                       # 5-minute poll / bucket step
GRID_BIN_SCALE = 200                     # lat/lon bin = floor(mid * 200)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P1 ------------------------------------------------------------------------
def safe_int(c) -> Column:
    """null, '' or unparsable -> null; never fails the batch."""
    return _c(c).try_cast("int")


# P2 ------------------------------------------------------------------------
def strict_cast(c, type_: str) -> Column:
    """ANSI cast: an unparsable value fails the batch (quarantine upstream)."""
    return _c(c).cast(type_)


# P3 / P5 -------------------------------------------------------------------
def text_or_none(c, parity: bool = False) -> Column:
    """``str(x)``; in parity mode a missing value becomes the text 'None'."""
    s = _c(c).cast("string")
    return F.coalesce(s, F.lit("None")) if parity else s


def text_or_null(c) -> Column:
    """Text guard: keep a string, anything missing stays null."""
    return _c(c).cast("string")


# P4 ------------------------------------------------------------------------
def narrow(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Numeric downcast, e.g. {'link_id': 'int', 'flag': 'tinyint'}."""
    return df.withColumns({k: F.col(k).cast(v) for k, v in casts.items()})


# P6-P8 ---------------------------------------------------------------------
def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """COALESCE(col, default) for each listed column, keeping its type."""
    types = dict(df.dtypes)
    return df.withColumns({
        k: F.coalesce(F.col(k), F.lit(v).cast(types[k])) for k, v in defaults.items()})


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN 1 ELSE 0 END (null counts as 0)."""
    return F.when(cond, 1).otherwise(0).cast("int")


def category_flags(df: DataFrame, col: str, flags: Mapping[str, str]) -> DataFrame:
    """One 0/1 column per {out_name: category value}."""
    return df.withColumns({k: flag(F.col(col) == F.lit(v)) for k, v in flags.items()})


# P9-P13 --------------------------------------------------------------------
def midpoint(a, b) -> Column:
    return (_c(a) + _c(b)) / F.lit(2.0)


def grid_bin(c, scale: int = GRID_BIN_SCALE) -> Column:
    return F.floor(_c(c) * F.lit(float(scale))).cast("bigint")


def length_proxy(lat1, lon1, lat2, lon2) -> Column:
    """Planar link length in degrees, sqrt(dlat^2 + dlon^2)."""
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), 2) + F.pow(_c(lon1) - _c(lon2), 2))


# P14-P17 -------------------------------------------------------------------
def time_bucket(c, seconds: int = TICK_SECONDS) -> Column:
    """Floor an epoch to the step: ts // 300 * 300."""
    return (F.floor(_c(c) / F.lit(seconds)) * F.lit(seconds)).cast("bigint")


def parse_utc(c) -> Column:
    """ISO-8601 text (with or without offset) -> TIMESTAMP."""
    return F.to_timestamp(_c(c))


def to_epoch(c) -> Column:
    """TIMESTAMP -> epoch seconds (BIGINT)."""
    return F.unix_timestamp(_c(c)).cast("bigint")


def to_iso(c) -> Column:
    """TIMESTAMP -> ISO-8601 text with a numeric offset, ``+00:00`` in UTC
    (Python's ``isoformat``; the ``X`` pattern would print ``Z``)."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ssxxx")


def local_hour(epoch, offset_hours: int = SGT_OFFSET_HOURS, tz: str | None = None) -> Column:
    """Local hour of an epoch.  Fixed offset by default; a zone name uses tzdata."""
    e = _c(epoch)
    if tz:
        return F.hour(F.from_utc_timestamp(F.timestamp_seconds(e), tz))
    return F.pmod(F.floor((e + F.lit(offset_hours * 3600)) / 3600), F.lit(24)).cast("int")


def local_dow(epoch, offset_hours: int = SGT_OFFSET_HOURS, tz: str | None = None) -> Column:
    """Local day of week, Sunday = 0 (1970-01-01 was a Thursday = 4)."""
    e = _c(epoch)
    if tz:
        return (F.dayofweek(F.from_utc_timestamp(F.timestamp_seconds(e), tz)) - 1).cast("int")
    day = F.floor((e + F.lit(offset_hours * 3600)) / 86400)
    return F.pmod(day + F.lit(4), F.lit(7)).cast("int")


# P18-P20 -------------------------------------------------------------------
def is_weekend(dow) -> Column:
    return flag(_c(dow).isin(*WEEKEND_DOWS))


def is_peak(hour, hours: Sequence[int] = PEAK_HOURS) -> Column:
    return flag(_c(hour).isin(*hours))


def momentum(df: DataFrame, sb="sb", tm5="sb_tm5", tm10="sb_tm10", tm15="sb_tm15") -> DataFrame:
    """Band deltas over the three lags and their acceleration."""
    d0 = F.col(sb) - F.col(tm5)
    d1 = F.col(tm5) - F.col(tm10)
    return df.withColumns({
        "delta_0_5": d0,
        "delta_5_10": d1,
        "delta_10_15": F.col(tm10) - F.col(tm15),
        "acceleration": d0 - d1,
    })


# P21-P26 -------------------------------------------------------------------
def minutes_between(later, earlier) -> Column:
    return (_c(later) - _c(earlier)) / F.lit(60.0)


def clip_low(c, low: float = 0.0) -> Column:
    """max(x, low); null stays null (Spark's greatest would skip it)."""
    c = _c(c)
    return F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(low).cast("double")))


def round_half_even(c) -> Column:
    """numpy.rint / Python round: ties go to the even integer."""
    return F.bround(_c(c), 0)


def projected_band(sb, mag, sign: int = -1, floor: int | None = 1) -> Column:
    """round(sb + sign * mag), optionally floored at ``floor``."""
    v = round_half_even(_c(sb) + F.lit(sign) * _c(mag)).cast("int")
    return F.greatest(F.lit(floor), v) if floor is not None else v


def margin(c, mid: float = 0.5) -> Column:
    return F.abs(_c(c) - F.lit(mid))


# Right-closed bins of the specialist reports (fixed values).
SEVERITY_EDGES = (-0.001, 0.75, 1.5, 3.0, 10.0)
JAM_LABELS = ("Noise (Vetoed)", "Minor Jam (1-band)", "Significant Jam (2-3)", "Major Jam (4+)")


def cut_right(c, edges: Sequence[float] = SEVERITY_EDGES, labels: Sequence[str] | None = None) -> Column:
    """pandas.cut semantics: bins (e[i], e[i+1]], value outside -> null.

    Without labels the bin text is '(lo, hi]'.
    """
    c = _c(c)
    names = list(labels) if labels else [f"({lo}, {hi}]" for lo, hi in zip(edges, edges[1:])]
    out = F.lit(None).cast("string")
    for (lo, hi), name in reversed(list(zip(zip(edges, edges[1:]), names))):
        out = F.when((c > F.lit(float(lo))) & (c <= F.lit(float(hi))), F.lit(name)).otherwise(out)
    return out


# P27-P31 -------------------------------------------------------------------
def require_columns(df: DataFrame, names: Iterable[str], strict: bool = False) -> list[str]:
    """Columns of ``names`` absent from ``df``; raise if ``strict`` and any."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if strict and missing:
        raise ValueError(f"Missing features: {missing}")
    return missing


def in_active_window(epoch, start: int = ACTIVE_START_HOUR, end: int = ACTIVE_END_HOUR,
                     offset_hours: int = SGT_OFFSET_HOURS) -> Column:
    h = local_hour(epoch, offset_hours)
    return (h >= F.lit(start)) & (h < F.lit(end))


def next_window_start(epoch, start: int = ACTIVE_START_HOUR, end: int = ACTIVE_END_HOUR,
                      offset_hours: int = SGT_OFFSET_HOURS) -> Column:
    """Epoch of the local ``start`` o'clock of today, or tomorrow once past ``end``."""
    e = _c(epoch)
    off = offset_hours * 3600
    day = F.floor((e + F.lit(off)) / 86400)
    day = day + F.when(local_hour(e, offset_hours) >= F.lit(end), 1).otherwise(0)
    return (day * 86400 + F.lit(start * 3600 - off)).cast("bigint")


def next_tick(epoch, seconds: int = TICK_SECONDS) -> Column:
    """Next multiple of ``seconds`` at or after the epoch."""
    return (F.ceil(_c(epoch) / F.lit(seconds)) * F.lit(seconds)).cast("bigint")


def keep(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Select the listed columns that exist, in the listed order."""
    have = set(df.columns)
    return df.select([n for n in names if n in have])
