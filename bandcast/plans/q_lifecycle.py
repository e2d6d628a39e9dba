"""Registered queries: incident lifecycles.

No SQL oracle with a limit of distance: the greedy sessionisation is order-dependent and stateful;
the driver records a rows-only check and ``tests/test_lifecycle.py``
compares against a brute-force Python twin of the global algorithm.
"""

from __future__ import annotations

from bandcast.operators.aggregates import value_counts
from bandcast.operators.lifecycle import incident_lifecycles
from bandcast.plans import fixtures as fx
from bandcast.plans.fixtures import with_views
from bandcast.plans.registry import register


@register("incident_lifecycles_15m")
def q_lifecycles_15(spark, d):
    return incident_lifecycles(fx.incident_snapshots(spark, d), 15.0, 200.0)


@register("incident_lifecycles_120m")
def q_lifecycles_120(spark, d):
    """Wide gap: few, large (type, session) groups — the skew case."""
    return incident_lifecycles(fx.incident_snapshots(spark, d), 120.0, 200.0)


@register("lifecycle_type_counts")
def q_lifecycle_type_counts(spark, d):
    lc = incident_lifecycles(fx.incident_snapshots(spark, d), 15.0, 200.0)
    return value_counts(lc, "type")


@register("incident_lifecycles_360m_split")
def q_lifecycles_360_split(spark, d):
    """Gap 360 min leaves a handful of (type, session) groups holding almost
    every row; groups above 1,000 rows are split into exact distance
    components before the greedy pass."""
    return incident_lifecycles(fx.incident_snapshots(spark, d), 360.0, 200.0, max_group_rows=1000)


@register("incident_lifecycles_unlimited", with_views("""
    SELECT MIN_BY(src_id, (ts, src_id)) AS incident_id, type, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS sightings
    FROM (SELECT *, SUM(new) OVER (PARTITION BY type ORDER BY ts, src_id ROWS UNBOUNDED PRECEDING) AS session
          FROM (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY type ORDER BY ts, src_id) <= 900 THEN 0 ELSE 1 END AS new
                FROM incident_snapshots))
    GROUP BY type, session""", "incident_snapshots"))
def q_lifecycles_unlimited(spark, d):
    """Without a limit of distance an incident is a gap session of its type, which SQL can check."""
    got = incident_lifecycles(fx.incident_snapshots(spark, d), 15.0, 2.1e7)
    return got.select("incident_id", "type", "start_ts", "end_ts", "sightings")
