"""Evaluation operators E1-E15.

Every metric is one aggregation pass (conditional sums) over the scored
frame; only the metric rows reach the driver.  Divisions by zero give 0
(the reference's ``zero_division=0``, extended to the unguarded recalls).
Overlapping segments are handled by exploding a segment-name array, so
all segments are computed in the same single pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandcast.functions.scalars import flag, round_half_even


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _by(by) -> list:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def _confusion(y: Column, p: Column) -> list[Column]:
    return [
        F.sum(flag((y == 1) & (p == 1))).cast("bigint").alias("tp"),
        F.sum(flag((y == 0) & (p == 1))).cast("bigint").alias("fp"),
        F.sum(flag((y == 0) & (p == 0))).cast("bigint").alias("tn"),
        F.sum(flag((y == 1) & (p == 0))).cast("bigint").alias("fn"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    return df.withColumns({
        "rows": tp + fp + tn + fn,
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn),
        "precision": prec,
        "recall": rec,
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
    })


def binary_metrics(df: DataFrame, y: str = "true_change", pred: str = "pred", by=None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (optionally per group)."""
    return _rates(df.groupBy(*_by(by)).agg(*_confusion(_c(y), _c(pred))))


# The swept thresholds.
SWEEP_THRESHOLDS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)


def threshold_sweep(df: DataFrame, y: str = "true_change", prob: str = "gk_prob",
                    thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Metrics at each threshold in one pass: each row is exploded over
    the (small, fixed) threshold list, then grouped by threshold."""
    x = df.select(_c(y).alias("_y"), _c(prob).alias("_p"),
                  F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    x = x.withColumn("_pred", flag(F.col("_p") >= F.col("threshold")))
    return binary_metrics(x, "_y", "_pred", by="threshold")


def constant_baseline(df: DataFrame, y: str = "true_change", value: int = 0, by=None) -> DataFrame:
    """The 'always no change' predictor through E1."""
    return binary_metrics(df.withColumn("_const", F.lit(value)), y, "_const", by)


def persistence(df: DataFrame, kind: str = "changed", sb: str = "sb", tm5: str = "sb_tm5") -> Column:
    """Persistence predictor as a column — 'changed': band moved in the
    last 5 minutes (binary); 'same': the class stays ``sb - 1``."""
    if kind == "changed":
        return flag(_c(sb) != _c(tm5))
    return (_c(sb) - 1).cast("int")


def ordinal_metrics(df: DataFrame, y: str, pred: str, by=None, base: str | None = None) -> DataFrame:
    """E5: accuracy, MAE, within-1; with ``base`` also accuracy on rows where
    the truth differs from the base (change-row accuracy)."""
    yy, pp = _c(y), _c(pred)
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.avg(flag(yy == pp).cast("double")).alias("accuracy"),
        F.avg(F.abs(pp - yy).cast("double")).alias("mae"),
        F.avg(flag(F.abs(pp - yy) <= 1).cast("double")).alias("within1"),
    ]
    if base:
        ch = _c(base) != yy
        aggs.append(F.coalesce(F.avg(F.when(ch, flag(yy == pp).cast("double"))), F.lit(0.0)).alias("change_accuracy"))
    return df.groupBy(*_by(by)).agg(*aggs)


def magnitude_metrics(df: DataFrame, y: str, score: str, by=None) -> DataFrame:
    """MAE, RMSE on the raw score; exact and within-1 on the half-even rounding."""
    yy, s = _c(y).cast("double"), _c(score).cast("double")
    r = round_half_even(s)
    return df.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(s - yy)).alias("mae"),
        F.sqrt(F.avg(F.pow(s - yy, 2))).alias("rmse"),
        F.avg(flag(r == yy).cast("double")).alias("exact"),
        F.avg(flag(F.abs(r - yy) <= 1).cast("double")).alias("within1"),
    )


def segment_column(segments: Mapping[str, Column]) -> Column:
    """Array of the names of the (possibly overlapping) segments a row is in."""
    arr = F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()])
    return F.filter(arr, lambda x: x.isNotNull())


def by_segment(df: DataFrame, segments: Mapping[str, Column], metric, **kw) -> DataFrame:
    """``metric(df, by='segment')`` for overlapping segments in one pass."""
    x = df.withColumn("segment", F.explode(segment_column(segments)))
    return metric(x, by="segment", **kw)


def alert_report(df: DataFrame, y: str, score: str, t: float = 0.75, base_t: float = 0.5, by=None) -> DataFrame:
    """Alerts at ``score >= t`` against magnitude labels ``y`` (event: y >= 1)."""
    s, yy = _c(score), _c(y)
    alert, event = s >= F.lit(t), yy >= 1
    out = df.groupBy(*_by(by)).agg(
        F.sum(flag(alert & event)).cast("bigint").alias("tp"),
        F.sum(flag(alert & (yy == 0))).cast("bigint").alias("fp"),
        F.sum(flag(event)).cast("bigint").alias("events"),
        F.sum(flag((s >= F.lit(base_t)) & (yy == 0))).cast("bigint").alias("base_fp"),
    )
    return out.withColumns({
        "alerts": F.col("tp") + F.col("fp"),
        "precision": safe_div(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": safe_div(F.col("tp"), F.col("events")),
        "false_alarms_saved": F.col("base_fp") - F.col("fp"),
    })


# Severity segments of the specialist reports.
def exclusive_severities(mag: Column) -> dict[str, Column]:
    return {"1": mag == 1, "2-3": (mag >= 2) & (mag <= 3), "4+": mag >= 4}


def cumulative_severities(mag: Column) -> dict[str, Column]:
    return {">=2": mag >= 2, ">=3": mag >= 3, ">=4": mag >= 4}


def severity_recall(df: DataFrame, mag: str, alert: str, exclusive: bool = True) -> DataFrame:
    """E9 (1, 2-3, 4+) / E10 (>=2, >=3, >=4): caught / total per severity."""
    m = _c(mag)
    segs = exclusive_severities(m) if exclusive else cumulative_severities(m)
    x = df.select(_c(alert).alias("_a"), F.explode(segment_column(segs)).alias("severity"))
    out = x.groupBy("severity").agg(F.count(F.lit(1)).alias("total"),
                                    F.sum(flag(F.col("_a") == 1)).cast("bigint").alias("caught"))
    return out.withColumn("recall", safe_div(F.col("caught"), F.col("total")))


def event_rate_by_bin(df: DataFrame, y: str, bin_col: str, labels: Sequence[str]) -> DataFrame:
    """Real-event rate per predicted bin; every label is listed (empty bins 0)."""
    agg = df.filter(_c(bin_col).isNotNull()).groupBy(F.col(bin_col).alias("bin")).agg(
        F.count(F.lit(1)).alias("total_pred"), F.sum(flag(_c(y) > 0)).cast("bigint").alias("real_events"))
    lab = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("bin"))
    out = lab.join(agg, "bin", "left").fillna(0, ["total_pred", "real_events"])
    return out.withColumn("real_rate", safe_div(F.col("real_events"), F.col("total_pred")))


def score_band(prob) -> Column:
    """LOW < 0.45 <= MID <= 0.55 < HIGH."""
    p = _c(prob)
    return F.when(p < 0.45, "LOW").when(p <= 0.55, "MID").otherwise("HIGH")


def margin_band(prob, mid: float = 0.5) -> Column:
    """|p - 0.5| <= 0.05, <= 0.20, above."""
    m = F.abs(_c(prob) - F.lit(mid))
    return F.when(m <= 0.05, "VERY_UNCERTAIN").when(m <= 0.20, "MEDIUM").otherwise("CONFIDENT")


def _band_stats(df: DataFrame, band: Column, correct: str, change: str) -> DataFrame:
    return df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(_c(correct).cast("double")).alias("accuracy"),
        F.avg(_c(change).cast("double")).alias("change_rate"))


def score_bands(df: DataFrame, prob: str = "router_prob", correct: str = "router_correct",
                change: str = "true_change") -> DataFrame:
    """E12."""
    return _band_stats(df, score_band(prob), correct, change)


def margin_bands(df: DataFrame, prob: str = "router_prob", correct: str = "router_correct",
                 change: str = "true_change") -> DataFrame:
    """E13."""
    return _band_stats(df, margin_band(prob), correct, change)


def changed_only_metrics(df: DataFrame, y: str = "true_down", pred: str = "router_pred",
                         change: str = "true_change", gate_prob: str = "gk_prob") -> DataFrame:
    """Router accuracy/F1 on truly changed rows, plus the passed-set summary."""
    m = binary_metrics(df.filter(_c(change) == 1), y, pred).select(
        F.col("accuracy").alias("acc_changed"), F.col("f1").alias("f1_changed"))
    s = df.agg(F.count(F.lit(1)).alias("passed_rows"),
               F.avg(_c(change).cast("double")).alias("passed_change_rate"),
               F.sum(flag(_c(change) == 0)).cast("bigint").alias("passed_false_positives"),
               F.avg(_c(gate_prob).cast("double")).alias("avg_gate_prob"))
    return m.unionByName(s, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("acc_changed", "f1_changed", "passed_rows", "passed_change_rate",
                                      "passed_false_positives", "avg_gate_prob")])


def ablation_table(runs: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Metric rows of several configurations stacked with a config column."""
    out = None
    for name, m in runs:
        x = m.withColumn("config", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
