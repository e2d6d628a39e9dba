"""Registered queries: sampling (R1-R6), ordering (O1-O4), unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandcast.operators import sampling as R
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.q_features import features_df, FEATURE_CTES
from bandcast.plans.registry import register
from bandcast.session import cut_lineage

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
P = R.MOD
PH_KEYS = R.portable_hash_sql(KEYS)
PH_SPEED = R.portable_hash_sql(["link_id", "snapshot_ts"])


@register("hash_sample_10pct", with_views(f"""
    SELECT link_id, snapshot_ts, speed_band FROM speedbands WHERE ({PH_SPEED}) / {float(P)} < 0.1e0""",
                                          "speedbands"))
def q_hash_sample(spark, d):
    return R.hash_sample(fx.speedbands(spark, d), ["link_id", "snapshot_ts"], 0.1)


@register("keep_or_sample", with_views(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, incident_nearby FROM predictions
    WHERE incident_nearby = 1 OR ({PH_KEYS}) / {float(P)} < 0.1e0""", "predictions"))
def q_keep_or_sample(spark, d):
    p = fx.predictions(spark, d).select(*KEYS, "incident_nearby")
    return R.keep_or_sample(p, F.col("incident_nearby") == 1, KEYS, 0.1)


@register("sample_n_before_filter", with_views(f"""
    SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sb, y_tp15 FROM predictions
                   ORDER BY ({PH_KEYS}), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000)
    WHERE y_tp15 < sb""", "predictions"))
def q_sample_n_before(spark, d):
    p = fx.predictions(spark, d).select(*KEYS, "sb", "y_tp15")
    return R.sample_n(p, 5000, KEYS, F.col("y_tp15") < F.col("sb"), before_filter=True)


@register("sample_n_after_filter", with_views(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sb, y_tp15 FROM predictions WHERE y_tp15 < sb
    ORDER BY ({PH_KEYS}), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000""", "predictions"))
def q_sample_n_after(spark, d):
    p = fx.predictions(spark, d).select(*KEYS, "sb", "y_tp15")
    return R.sample_n(p, 5000, KEYS, F.col("y_tp15") < F.col("sb"), before_filter=False)


@register("balanced_classes", with_views(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, changed FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY changed ORDER BY ({PH_KEYS}), l_orderkey, l_linenumber,
                                     l_partkey, l_suppkey) AS rn
        FROM (SELECT *, CAST(CASE WHEN y_tp15 <> sb THEN 1 ELSE 0 END AS INTEGER) AS changed FROM predictions))
    WHERE rn <= 3000""", "predictions"))
def q_balanced(spark, d):
    p = fx.predictions(spark, d).select(*KEYS, F.when(F.col("y_tp15") != F.col("sb"), 1).otherwise(0)
                                        .cast("int").alias("changed"))
    return R.balanced(p, "changed", 3000, KEYS)


@register("union_class_samples", with_views(f"""
    SELECT changed, COUNT(*) AS rows FROM (
        (SELECT 1 AS changed FROM predictions WHERE y_tp15 <> sb
         ORDER BY ({PH_KEYS}), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000)
        UNION ALL
        (SELECT 0 AS changed FROM predictions WHERE y_tp15 = sb
         ORDER BY ({PH_KEYS}), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000))
    GROUP BY changed""", "predictions"))
def q_union_class_samples(spark, d):
    p = fx.predictions(spark, d)
    ch = R.sample_n(p, 2000, KEYS, F.col("y_tp15") != F.col("sb"), before_filter=False).select(F.lit(1).alias("changed"))
    st = R.sample_n(p, 2000, KEYS, F.col("y_tp15") == F.col("sb"), before_filter=False).select(F.lit(0).alias("changed"))
    return R.union_all(ch, st).groupBy("changed").agg(F.count(F.lit(1)).alias("rows"))


@register("union_distinct_links", with_views("""
    SELECT link_id FROM speedbands UNION SELECT link_id FROM incident_intervals""",
                                             "speedbands", "incident_intervals"))
def q_union_distinct(spark, d):
    return R.union_distinct(fx.speedbands(spark, d).select("link_id"),
                            fx.incident_intervals(spark, d).select("link_id"))


_SPLIT_SQL = "(SELECT MIN(snapshot_ts) + CAST(FLOOR(0.8e0 * (MAX(snapshot_ts) - MIN(snapshot_ts))) AS BIGINT) FROM features)"


@register("chrono_split", with_views(f"""
    SELECT {_SPLIT_SQL} AS split_ts,
           (SELECT COUNT(*) FROM features WHERE snapshot_ts < {_SPLIT_SQL}) AS train_rows,
           (SELECT COUNT(*) FROM features WHERE snapshot_ts >= {_SPLIT_SQL}) AS test_rows""",
                                     "speedbands", "links", "incident_intervals", extra=FEATURE_CTES))
def q_chrono_split(spark, d):
    from bandcast.operators.filters import split_side
    f = cut_lineage(features_df(spark, d).select("snapshot_ts"))
    t = R.chrono_split(f)
    tr = split_side(f, t, "train").agg(F.count(F.lit(1)).alias("train_rows"))
    te = split_side(f, t, "test").agg(F.count(F.lit(1)).alias("test_rows"))
    return tr.unionByName(te, allowMissingColumns=True).agg(
        F.lit(t).cast("bigint").alias("split_ts"), F.max("train_rows").alias("train_rows"),
        F.max("test_rows").alias("test_rows"))


@register("tail_split", with_views("""
    SELECT MAX(snapshot_ts) - 172800 AS split_ts,
           COUNT(*) FILTER (WHERE snapshot_ts >= (SELECT MAX(snapshot_ts) - 172800 FROM speedbands)) AS test_rows
    FROM speedbands""", "speedbands"))
def q_tail_split(spark, d):
    s = fx.speedbands(spark, d)
    t = R.tail_split(s)
    return s.agg(F.lit(t).cast("bigint").alias("split_ts"),
                 F.count(F.when(F.col("snapshot_ts") >= t, 1)).alias("test_rows"))


@register("sorted_incident_head", with_views("""
    SELECT src_id, type, ts FROM incident_snapshots ORDER BY ts, src_id LIMIT 20""", "incident_snapshots"))
def q_sorted_head(spark, d):
    s = R.sort_by(fx.incident_snapshots(spark, d).select("src_id", "type", "ts"), ["ts", "src_id"])
    return R.head(s, 20, ["ts", "src_id"])


@register("top_k_scores", with_views("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gk_prob FROM predictions WHERE gk_prob >= 0.05e0
    ORDER BY gk_prob DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25""", "predictions"))
def q_top_k(spark, d):
    p = fx.predictions(spark, d).select(*KEYS, "gk_prob")
    return R.top_k(p, "gk_prob", 25, KEYS, min_value=0.05)


@register("hash_take_links", with_views(f"""
    SELECT link_id, road_name FROM links ORDER BY ({R.portable_hash_sql(['link_id'])}), link_id LIMIT 5""", "links"))
def q_hash_take(spark, d):
    return R.hash_take(fx.links(spark, d).select("link_id", "road_name"), 5, ["link_id"])


@register("dense_creation_order", with_views("""
    SELECT src_id, ts, CAST(ROW_NUMBER() OVER (ORDER BY ts, src_id) AS BIGINT) AS seq FROM incident_snapshots""",
                                             "incident_snapshots"))
def q_dense_creation_order(spark, d):
    """Dense ids in time order over the whole table, distributed."""
    from bandcast.operators.aggregates import dense_ids
    return dense_ids(fx.incident_snapshots(spark, d).select("src_id", "ts"), ["ts", "src_id"])
