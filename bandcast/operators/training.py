"""Labels, training and scoring: M1-M14.

The learners are histogram gradient boosting in a barrier stage
(``bandcast.operators.boosting``): all rounds run inside few Spark jobs, rows
stay with their tasks, missing values take the way that gains more at each
split, and scoring is a narrow, vectorised map.  Only trees (bounded by rounds
and depth), metric rows and the small importance table reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandcast.operators.boosting import BoostedModel, Params, score_column, train
from bandcast.functions.scalars import clip_low, flag, margin


# M1-M4 ---------------------------------------------------------------------------
def label(df: DataFrame, kind: str, y: str = "y_tp15", sb: str = "sb", out: str = "label") -> DataFrame:
    """change: y != sb; direction: y < sb; rise: max(y - sb, 0);
    drop: max(sb - y, 0); class: y - 1 (8 classes)."""
    yy, s = F.col(y), F.col(sb)
    expr = {
        "change": flag(yy != s).cast("double"),
        "direction": flag(yy < s).cast("double"),
        "rise": F.greatest(yy - s, F.lit(0)).cast("double"),
        "drop": F.greatest(s - yy, F.lit(0)).cast("double"),
        "class": (yy - 1).cast("double"),
    }[kind]
    return df.withColumn(out, expr)


# M5 ------------------------------------------------------------------------------
def incident_weight(df: DataFrame, weight: float = 5.0, col: str = "incident_nearby", out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(col) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


# M6 ------------------------------------------------------------------------------
def impute(df: DataFrame, features: Sequence[str], indicators: Sequence[str] = ("rain_mm",)) -> tuple[DataFrame, list[str]]:
    """Fill nulls with 0 (as double); add ``<c>_missing`` for the listed columns.  For learners that
    need whole vectors; the boosted trees take nulls as they are."""
    cols = list(features)
    out = df.withColumns({f"{c}_missing": flag(F.col(c).isNull()).cast("double") for c in indicators if c in cols})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return out, cols + [f"{c}_missing" for c in indicators if c in cols]


# M7-M9 ---------------------------------------------------------------------------
# The reference's boosting settings.
GATE_PARAMS = {"stepSize": 0.08, "maxDepth": 8, "maxIter": 465, "subsamplingRate": 0.84}
SPECIALIST_PARAMS = {"stepSize": 0.05, "maxDepth": 8, "maxIter": 465, "subsamplingRate": 0.84}
CLASS_PARAMS = {"stepSize": 0.08, "maxDepth": 8, "numTrees": 465, "subsamplingRate": 0.844237, "columnRate": 0.638003}


def _params(objective: str, seed: int, settings: dict) -> Params:
    s = dict(settings)
    rounds = s.pop("maxIter") if "maxIter" in s else s.pop("numTrees")
    p = Params(objective, rounds, s.pop("maxDepth"), s.pop("stepSize"), s.pop("subsamplingRate"), s.pop("columnRate", 0.64),
               s.pop("minChildWeight", 6.0), s.pop("l2", 1.0), s.pop("numClasses", 1), seed)
    if s:
        raise ValueError(f"unknown settings: {sorted(s)}")
    return p


def fit_classifier(df: DataFrame, features: Sequence[str], label_col: str = "label", weight: str | None = None,
                   seed: int = 42, **params) -> BoostedModel:
    """M7: boosted binary classifier, logistic loss."""
    return train(df, features, label_col, weight, _params("logistic", seed, {**GATE_PARAMS, **params}))


def fit_regressor(df: DataFrame, features: Sequence[str], label_col: str = "label", weight: str | None = None,
                  seed: int = 42, **params) -> BoostedModel:
    """M8: boosted regressor, squared error."""
    return train(df, features, label_col, weight, _params("squared", seed, {**SPECIALIST_PARAMS, **params}))


def fit_multiclass(df: DataFrame, features: Sequence[str], label_col: str = "label", weight: str | None = None,
                   seed: int = 42, **params) -> BoostedModel:
    """M9: boosted classifier over classes 0, 1, ... with a softmax loss: one tree per class and round
    (``numTrees`` rounds), as many classes as the largest label asks for, ``numClasses`` at least."""
    return train(df, features, label_col, weight, _params("softmax", seed, {**CLASS_PARAMS, **params}))


def fit_together(*fits: Callable[[], BoostedModel]) -> list[BoostedModel]:
    """Models that do not need each other, trained at the same time: a model of few rows is one task, so each takes a slot."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(fit)) for fit in fits]]


# M10, M11 --------------------------------------------------------------------------
def score(model: BoostedModel, df: DataFrame, kind: str = "prob", out: str = "score",
          clip: bool = True) -> DataFrame:
    """prob: P(class 1); value: regression output (clipped at 0); class: argmax."""
    v = score_column(df.sparkSession, model, kind)
    return df.withColumn(out, clip_low(v) if kind == "value" and clip else v)


def save(model: BoostedModel, path: str) -> None:
    model.save(SparkSession.active(), path)


def load(path: str) -> BoostedModel:
    return BoostedModel.load(SparkSession.active(), path)


# M12 --------------------------------------------------------------------------------
def importance(spark: SparkSession, model: BoostedModel, features: Sequence[str], n: int = 15) -> DataFrame:
    """Top-n features by their splits' mean gain (as shares of all), as a DataFrame."""
    rows = sorted(zip(features, model.importance().tolist()), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


# M13, M14 -----------------------------------------------------------------------------
GATE_THRESHOLDS = (0.25, 0.30, 0.35, 0.40)


def gate_table(df: DataFrame, prob: str = "score", thresholds: Sequence[float] = GATE_THRESHOLDS,
               y: str = "y_tp15", sb: str = "sb") -> DataFrame:
    """Gate predictions: prob (float), pass flags per threshold, is_tp/is_fp at
    the first threshold, and the direction flags the router consumes."""
    first = f"gk_pred_{int(round(thresholds[0] * 100))}"
    out = df.withColumns({
        "true_change": flag(F.col(y) != F.col(sb)).cast("tinyint"),
        "true_down": flag(F.col(y) < F.col(sb)).cast("tinyint"),
        "true_up": flag(F.col(y) > F.col(sb)).cast("tinyint"),
        "gk_prob": F.col(prob).cast("float"),
        **{f"gk_pred_{int(round(t * 100))}": flag(F.col(prob) >= F.lit(t)).cast("tinyint") for t in thresholds},
    })
    return out.withColumns({
        "is_fp": flag((F.col(first) == 1) & (F.col("true_change") == 0)).cast("tinyint"),
        "is_tp": flag((F.col(first) == 1) & (F.col("true_change") == 1)).cast("tinyint"),
    }).drop(prob)


def router_table(df: DataFrame, prob: str = "score", y: str = "true_down") -> DataFrame:
    """Router predictions: prob, decision at 0.5 (1 = down), correctness, margin."""
    out = df.withColumns({
        "router_prob": F.col(prob).cast("float"),
        "router_pred": flag(F.col(prob) >= 0.5).cast("tinyint"),
    })
    return out.withColumns({
        "router_correct": flag(F.col("router_pred") == F.col(y)).cast("tinyint"),
        "router_margin": margin(F.col("router_prob").cast("double")),
    }).drop(prob)
