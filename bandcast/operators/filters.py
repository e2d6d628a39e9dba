"""Filters and predicates (F1-F8).  Plain ``filter`` so Catalyst pushes what it
can into the parquet scan (F1 on a scanned column shows in PushedFilters)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND_COLUMNS = ("sb", "sb_tm5", "sb_tm10", "sb_tm15", "y_tp15")


def between_ts(df: DataFrame, lo, hi, ts: str = "snapshot_ts") -> DataFrame:
    """lo <= ts <= hi, inclusive at both ends."""
    return df.filter(F.col(ts).between(lo, hi))


def valid_bands(df: DataFrame, cols: Sequence[str] = BAND_COLUMNS, lo: int = 1, hi: int = 8) -> DataFrame:
    """every listed band in [lo, hi]; null fails."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).between(lo, hi)
    return df.filter(F.coalesce(cond, F.lit(False)))


def not_null(df: DataFrame, key: str) -> DataFrame:
    """F3."""
    return df.filter(F.col(key).isNotNull())


def split_side(df: DataFrame, split_ts, side: str, ts: str = "snapshot_ts") -> DataFrame:
    """'train' is ts < split, 'test' is ts >= split."""
    c = F.col(ts) < split_ts if side == "train" else F.col(ts) >= split_ts
    return df.filter(c)


def row_class_cond(kind: str, y: str = "y_tp15", sb: str = "sb") -> Column:
    return {
        "change": F.col(y) != F.col(sb),
        "stable": F.col(y) == F.col(sb),
        "rise": F.col(y) > F.col(sb),
        "fall": F.col(y) < F.col(sb),
    }[kind]


def row_class(df: DataFrame, kind: str, y: str = "y_tp15", sb: str = "sb") -> DataFrame:
    """change / stable / rise / fall rows."""
    return df.filter(row_class_cond(kind, y, sb))


def routed(df: DataFrame, gate: int | None = 1, router: int | None = None,
           gate_col: str = "gk_pred_25", router_col: str = "router_pred") -> DataFrame:
    """rows passed by the gate and/or with a given router decision."""
    cond = F.lit(True)
    if gate is not None:
        cond = cond & (F.col(gate_col) == gate)
    if router is not None:
        cond = cond & (F.col(router_col) == router)
    return df.filter(cond)


def above(df: DataFrame, col: str, t: float) -> DataFrame:
    """score at or above a threshold (inclusive)."""
    return df.filter(F.col(col) >= F.lit(float(t)))


def within(dist, max_m: float) -> Column:
    """F8: distance cutoff, inclusive."""
    return (F.col(dist) if isinstance(dist, str) else dist) <= F.lit(float(max_m))


def beyond(gap, max_v: float) -> Column:
    """F8: gap strictly greater than the limit."""
    return (F.col(gap) if isinstance(gap, str) else gap) > F.lit(float(max_v))
