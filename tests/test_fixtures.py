"""The fixture views reproduce the row counts FIXTURES.md §3 states for sf0.01."""

from pyspark.sql import functions as F

from bandcast.operators.temporal import lag_lead
from bandcast.plans import fixtures as fx
from tests.conftest import SF01


def test_view_row_counts(spark):
    want = {"links": 100, "speedbands": 9963, "incident_snapshots": 10000, "incident_intervals": 8018,
            "rain_stations": 25, "rain": 10000, "predictions": 60000}
    assert {n: fx.view(spark, SF01, n).count() for n in want} == want


def test_stated_join_and_filter_counts(spark):
    sp = fx.speedbands(spark, SF01)
    links = fx.links(spark, SF01).select("link_id")
    assert sp.join(links, "link_id", "left_anti").count() == 3293            # J1 vs J2
    t = lag_lead(sp.select("link_id", "snapshot_ts", F.col("speed_band").alias("sb")), "link_id", "snapshot_ts",
                 "sb", {"sb_tm5": 1, "sb_tm15": 3}, {"y_tp15": 3})
    valid = t.filter("sb between 1 and 8 and sb_tm5 between 1 and 8 and sb_tm15 between 1 and 8 "
                     "and y_tp15 between 1 and 8")
    assert valid.count() == 3689                                              # W1 lags 1 and 3, W2, F2
    rate = fx.predictions(spark, SF01).selectExpr("avg(cast(y_tp15 <> sb as double)) r").first().r
    assert round(rate, 3) == 0.347                                            # M1 change rate
