"""Samples of frames whose columns bear the names the operators use inside."""

import pytest

from bandcast.operators.sampling import balanced, hash_take, sample_n

NAMES = ["_c", "_h", "_rn", "_b", "_n", "_before", "_last", "_H_"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(300).selectExpr("id AS k", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) AS klass",
                                       *[f"id * {i + 2} AS `{c}`" for i, c in enumerate(NAMES)])


@pytest.mark.parametrize("class_col", ["klass", "_c"])
def test_balanced_keeps_clashing_columns(frame, class_col):
    plain = frame.select("k", frame[class_col].alias("klass"))
    got = balanced(frame, class_col, 7, ["k"])
    assert got.columns == frame.columns
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in balanced(plain, "klass", 7, ["k"]).collect())
    assert all(r._rn == 4 * r.k and r._c == 2 * r.k and r._last == 8 * r.k for r in got.collect())


def test_balanced_takes_n_of_every_class_null_too(frame):
    assert sorted((r["klass"] or "", r["count"]) for r in balanced(frame, "klass", 7, ["k"]).groupBy("klass").count().collect()) \
        == [("", 7), ("a", 7), ("b", 7)]


def test_sample_n_keeps_clashing_columns(frame):
    got = sample_n(frame, 20, ["k"])
    assert got.columns == frame.columns
    assert sorted(r.k for r in got.collect()) == sorted(r.k for r in hash_take(frame.select("k"), 20, ["k"]).collect())
    assert sample_n(frame.limit(0), 20, ["k"]).count() == 0
