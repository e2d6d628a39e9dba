"""Physical-plan guards: no registered query pairs rows without a key
(CartesianProduct / BroadcastNestedLoopJoin) or runs a row-at-a-time
Python UDF, scans carry pushed filters, and the feature table keeps its
shuffle budget."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

# Queries whose builders run streams or train models are planned elsewhere.
SKIP = ("stream_", "train_", "model_", "feature_importance", "reference_chain")
NAMES = sorted(n for n in E.queries() if not n.startswith(SKIP) and n not in E.LLM_QUERIES)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_no_keyless_joins(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p          # no row-at-a-time Python UDF anywhere


def test_feature_table_shuffle_budget(spark):
    from bandcast.plans.q_features import features_df
    p = plan(features_df(spark, SF001, strategy="merge", chunk_seconds=None))
    exchanges = re.findall(r"\(\d+\) Exchange", p)
    assert len(exchanges) <= 3          # dedupe, window by link (+ interval side when not broadcast)
    assert "PushedFilters: [IsNotNull(user_id)" in p


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feature_table_over_tables_bucketed_by_link_has_no_exchange(spark, no_broadcast):
    from bandcast.operators.features import feature_table
    from bandcast.plans import fixtures as fx
    from bandcast.plans.q_features import END_TS, START_TS, bucketed_tables, features_df
    s, i = bucketed_tables(spark, SF001, by_day=False)
    made = feature_table(s, fx.links(spark, SF001), i, START_TS, END_TS, "merge", None)
    p = plan(made)
    assert not re.findall(r"\(\d+\) Exchange", p)      # window, interval join and rollup by the buckets
    assert p.count("Bucketed: true") == 2
    key = lambda r: tuple(map(str, r))
    assert sorted(made.collect(), key=key) == sorted(features_df(spark, SF001).collect(), key=key)


def test_feature_table_over_tables_bucketed_by_link_and_day_shuffles_the_halo_alone(spark, no_broadcast):
    p = plan(E.queries()["feature_table_bucketed"](spark, SF001))
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: ([^\n]*)", p)
    assert exchanges and all(re.search(r"\b(_before|_hk)#", columns)
                             for columns, _ in exchanges), exchanges


def test_a_days_column_needs_the_run_by_day(spark):
    from bandcast.operators.features import feature_table
    with pytest.raises(ValueError):
        feature_table(None, None, None, chunk_seconds=None, day_col="_day")
