"""Scalar functions on hand-made rows, including the traps of SURVEY §7.4."""

from pyspark.sql import functions as F

from bandcast.functions import scalars as S
from bandcast.functions.geo import haversine_m


def one(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("y")).collect()]


def test_safe_int(spark):
    got = one(spark, S.safe_int("x"), [("3",), ("3.5",), (" 5 ",), ("",), (None,), ("n/a",), ("-2",)])
    assert got == [3, None, 5, None, None, None, -2]


def test_text_or_none_parity(spark):
    assert one(spark, S.text_or_none("x", parity=True), [("a",), (None,)]) == ["a", "None"]
    assert one(spark, S.text_or_none("x"), [("a",), (None,)]) == ["a", None]


def test_round_half_even(spark):
    got = one(spark, S.round_half_even("x"), [(0.5,), (1.5,), (2.5,), (-0.5,), (2.6,)], "x double")
    assert got == [0.0, 2.0, 2.0, -0.0, 3.0]


def test_cut_right_edges(spark):
    rows = [(-0.001,), (0.0,), (0.75,), (0.7500001,), (1.5,), (3.0,), (10.0,), (10.5,), (None,)]
    got = one(spark, S.cut_right("x", labels=S.JAM_LABELS), rows, "x double")
    assert got == [None, "Noise (Vetoed)", "Noise (Vetoed)", "Minor Jam (1-band)", "Minor Jam (1-band)",
                   "Significant Jam (2-3)", "Major Jam (4+)", None, None]


def test_alert_and_bin_share_the_075_edge(spark):
    # §7.4 #5: exactly 0.75 is an alert (>=) and also in the vetoed bin (right-closed)
    df = spark.createDataFrame([(0.75,)], "x double")
    r = df.select(S.flag(F.col("x") >= 0.75).alias("a"), S.cut_right("x", labels=S.JAM_LABELS).alias("b")).first()
    assert r.a == 1 and r.b == "Noise (Vetoed)"


def test_local_time_fixed_offset_matches_zone(spark):
    # modern dates: Singapore was UTC+7:30 before 1982, so the zone path differs in 1970
    df = spark.range(1704067200, 1704067200 + 86400 * 9, 3599).select(F.col("id").alias("t"))
    r = df.select(
        F.sum((S.local_hour("t") != S.local_hour("t", tz="Asia/Singapore")).cast("int")).alias("h"),
        F.sum((S.local_dow("t") != S.local_dow("t", tz="Asia/Singapore")).cast("int")).alias("d")).first()
    assert r.h == 0 and r.d == 0


def test_active_window_and_next_start(spark):
    # 2024-01-01 13:00 UTC = 21:00 SGT (active), 14:30 UTC = 22:30 SGT (not active)
    rows = [(1704114000,), (1704119400,), (1704067200 - 8 * 3600 + 3600,)]
    df = spark.createDataFrame(rows, "t long")
    got = df.select(S.flag(S.in_active_window("t")).alias("a"), S.next_window_start("t").alias("n")).collect()
    assert [g.a for g in got] == [1, 0, 0]
    # 22:30 SGT -> next day 04:00 SGT = 2024-01-01 20:00 UTC
    assert got[1].n == 1704139200
    # 01:00 SGT -> same day 04:00 SGT
    assert got[2].n == 1704067200 - 8 * 3600 + 4 * 3600


def test_next_tick(spark):
    assert one(spark, S.next_tick("x"), [(600,), (601,), (899,)], "x long") == [600, 900, 900]


def test_clip_low_keeps_null(spark):
    assert one(spark, S.clip_low("x"), [(-1.0,), (2.0,), (None,)], "x double") == [0.0, 2.0, None]


def test_projected_band_floor(spark):
    df = spark.createDataFrame([(2, 3.6), (5, 1.5), (5, 2.5)], "sb int, m double")
    got = df.select(S.projected_band("sb", "m", -1, 1).alias("p")).collect()
    assert [g.p for g in got] == [1, 4, 2]


def test_haversine_known_distance(spark):
    # one degree of latitude on the 6,371 km sphere
    d = spark.range(1).select(haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d")).first().d
    assert abs(d - 111194.93) < 0.01


def test_require_columns(spark):
    df = spark.range(1).withColumn("a", F.lit(1))
    assert S.require_columns(df, ["a", "b"]) == ["b"]
    try:
        S.require_columns(df, ["b"], strict=True)
        raise AssertionError("expected failure")
    except ValueError as e:
        assert "b" in str(e)
