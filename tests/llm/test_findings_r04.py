"""Near-duplicate joins never broadcast what the planner sizes too low."""

import numpy as np

from bandcast.llm import simhash_golay
from bandcast.operators import graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_golay_keys_are_never_broadcast(spark, tmp_path):
    rnd = np.random.default_rng(3)
    fps = [int(x) for x in rnd.integers(0, 2 ** 62, 300)]
    fps += [fps[0] ^ 1, fps[1] ^ 0b111, fps[2] ^ 0b1111]
    spark.createDataFrame([(x,) for x in fps], "_fp bigint").write.parquet(str(tmp_path / "fps"))
    found = simhash_golay.links(spark.read.parquet(str(tmp_path / "fps")))
    assert "BroadcastExchange" not in plan(found) and "SortMergeJoin" in plan(found)
    assert {(r.src, r.dst) for r in found.collect()} == {tuple(sorted(p)) for p in ((fps[0], fps[300]), (fps[1], fps[301]))}


def test_many_edges_are_never_broadcast(spark, tmp_path, monkeypatch):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)]
    spark.createDataFrame(edges, "src bigint, dst bigint").write.parquet(str(tmp_path / "edges"))
    e = spark.read.parquet(str(tmp_path / "edges"))
    want = {x: 0 if x <= 60 else 100 for p in edges for x in p}
    assert {r.id: r.component for r in graph.connected_components(e).collect()} == want
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    assert {r.id: r.component for r in graph.connected_components(e).collect()} == want
    ab = e.toDF("a", "b")
    for star in (graph._large_star(ab, len(edges)), graph._small_star(ab, len(edges))):
        assert "BroadcastExchange" not in plan(star)
