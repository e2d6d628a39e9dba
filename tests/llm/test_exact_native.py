"""Operator 1 runs on DataFrame functions only."""

from pyspark.sql.classic.dataframe import DataFrame

from bandcast.llm import exact_dedup


def test_no_rdd_on_the_main_path(make, monkeypatch):
    docs = make(["a b", "a  b", "c", None, ""])

    def no(self):
        raise AssertionError("RDD on the native path")
    monkeypatch.setattr(DataFrame, "rdd", property(no))
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 0, 2), (1, 0, 2), (2, 2, 1), (3, 3, 2), (4, 3, 2)]
