"""Cascade operators C1-C5: route rows to the specialists, score only the
routed rows, and report the stage funnel.

Scoring never joins back and nothing is shuffled.  ``apply_cascade`` scores
all stages in one vectorised pass.  ``score_routed`` takes any scorers: the
frame is split by route with filters, each part is scored by its own model (a
narrow map), and the parts are unioned; its input is computed once per branch,
so write or checkpoint an expensive one first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandcast.functions.scalars import clip_low, flag, projected_band
from bandcast.operators.boosting import BoostedModel, cascade_column
from bandcast.operators.evaluation import cumulative_severities, safe_div, segment_column
from bandcast.operators.names import fresh
from bandcast.operators.training import GATE_THRESHOLDS, gate_table, router_table

STRICT_THRESHOLD = 0.75


def route(gate: str = "gk_pred_25", router: str = "router_pred") -> Column:
    """Pass & down -> 'descent'; pass & not down -> 'ascent'; else 'none'."""
    g, r = F.col(gate), F.col(router)
    return F.when((g == 1) & (r == 1), "descent").when(g == 1, "ascent").otherwise("none")


Scorer = Callable[[DataFrame], DataFrame]   # adds a raw ``score`` column


def score_routed(df: DataFrame, scorers: Mapping[str, Scorer], route_col: str = "route",
                 t: float = STRICT_THRESHOLD) -> DataFrame:
    """Magnitude per routed row (clipped at 0), 0 elsewhere; strict alert
    at ``score >= t``.  Output adds ``pred_mag`` and ``strict_alert``."""
    cols = df.columns
    parts = []
    for name, scorer in scorers.items():
        part = scorer(df.filter(F.col(route_col) == name))
        parts.append(part.select(*cols, clip_low(F.col("score")).alias("pred_mag")))
    rest = df.filter(~F.col(route_col).isin(*scorers.keys()) | F.col(route_col).isNull()) \
        .select(*cols, F.lit(0.0).alias("pred_mag"))
    out = rest
    for p in parts:
        out = out.unionByName(p)
    return out.withColumn("strict_alert", flag(F.col("pred_mag") >= F.lit(t)))


def apply_cascade(df: DataFrame, gate: BoostedModel, router: BoostedModel, descent: BoostedModel, ascent: BoostedModel,
                  t: float = STRICT_THRESHOLD) -> DataFrame:
    """C1, C2, C4 with trained models: gate table, router table, route, predicted and true magnitudes, strict alert.

    One vectorised pass scores each row by the gate, the router and, where it is routed, one specialist; the
    frame is neither split nor computed once per branch."""
    s, = fresh(df, "_scores")
    x = df.withColumn(s, cascade_column(df.sparkSession, gate, router, descent, ascent, GATE_THRESHOLDS[0]))
    g, r, m = fresh(x, "_gate", "_router", "_magnitude")
    x = x.select(*df.columns, F.col(s)["gate"].alias(g), F.col(s)["router"].alias(r), F.col(s)["magnitude"].alias(m))
    x = router_table(gate_table(x, g), r).withColumn("route", route())
    x = x.withColumn("pred_mag", F.col(m)).drop(m).withColumn("strict_alert", flag(F.col("pred_mag") >= F.lit(t)))
    return x.withColumns({"jam_mag": true_magnitude(sign=-1), "rise_mag": true_magnitude(sign=+1)})


def true_magnitude(sb: str = "sb", y: str = "y_tp15", sign: int = -1) -> Column:
    """C4: descent max(sb - y, 0) (sign -1); ascent max(y - sb, 0) (sign +1)."""
    d = (F.col(sb) - F.col(y)) if sign < 0 else (F.col(y) - F.col(sb))
    return F.greatest(d, F.lit(0))


def funnel(df: DataFrame, mag: str, gate: str = "gk_pred_25", routed: str = "routed",
           alert: str = "strict_alert") -> DataFrame:
    """Per cumulative severity, how many true events pass the gate, the
    router and the final alert (non-increasing by construction)."""
    x = df.select(F.col(gate).alias("_g"), F.col(routed).alias("_r"), F.col(alert).alias("_a"),
                  F.explode(segment_column(cumulative_severities(F.col(mag)))).alias("severity"))
    out = x.groupBy("severity").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(flag(F.col("_g") == 1)).cast("bigint").alias("gate_caught"),
        F.sum(flag(F.col("_r") == 1)).cast("bigint").alias("routed_caught"),
        F.sum(flag(F.col("_a") == 1)).cast("bigint").alias("final_caught"),
    )
    return out.withColumns({
        "gate_recall": safe_div(F.col("gate_caught"), F.col("total")),
        "routed_recall": safe_div(F.col("routed_caught"), F.col("total")),
        "final_recall": safe_div(F.col("final_caught"), F.col("total")),
    })


def largest_moves(df: DataFrame, mag: str = "pred_mag", sign: int = -1, k: int = 5, min_mag: float | None = 2.0,
                  keys: Sequence[str] = ("link_id", "snapshot_ts"), floor: int | None = None) -> DataFrame:
    """The k largest predicted moves (optionally at least ``min_mag``) as
    case rows with the projected band.  ``orderBy().limit()`` plans a
    TakeOrderedAndProject: a per-partition top-k, never a full sort."""
    x = df if min_mag is None else df.filter(F.col(mag) >= F.lit(min_mag))
    x = x.orderBy(F.desc(mag), *[F.asc(c) for c in keys]).limit(k)
    return x.withColumn("projected_sb", projected_band("sb", mag, sign, floor))
