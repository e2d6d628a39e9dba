"""T3 over several micro-batches: rows that arrive late, but within the allowed lateness, are not lost."""

from bandcast.operators.lifecycle import incident_lifecycles
from bandcast.plans.q_streaming import SIGHTING_SCHEMA
from bandcast.streaming import streams as ST

HOUR = 3600


def test_late_rows_over_batches_equal_batch(spark):
    root = ST.stream_workspace(spark, "late_rows")
    batches = [[(1, "Accident", 1.3, 103.8, "a", HOUR), (2, "Accident", 1.3, 103.8, "b", HOUR + 1200)],
               [(3, "Accident", 1.3, 103.8, "late", HOUR + 600), (4, "Accident", 1.3, 103.8, "c", HOUR + 1500)],
               [(5, "Accident", 1.31, 103.8, "late", HOUR + 700), (6, "Accident", 1.3, 103.8, "d", HOUR + 1501)],
               [(7, "beat", 1.3, 103.8, None, 100 * HOUR)]]
    for rows in batches:
        ST.land_json(spark.createDataFrame(rows, SIGHTING_SCHEMA), f"{root}/in")
        ST.run_available_now(ST.stream_lifecycles(ST.stream_rows(spark, f"{root}/in", SIGHTING_SCHEMA)),
                             f"{root}/out", f"{root}/ckpt")
    cols = ["incident_id", "type", "start_ts", "end_ts", "sightings", "message"]
    got = sorted(map(tuple, spark.read.parquet(f"{root}/out").filter("type <> 'beat'").select(*cols).collect()))
    every = spark.createDataFrame([r for b in batches[:-1] for r in b], SIGHTING_SCHEMA)
    assert got == sorted(map(tuple, incident_lifecycles(every).select(*cols).collect()))
    assert sum(r[4] for r in got) == 6
