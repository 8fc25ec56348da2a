"""Plan properties that the scale design relies on (checked on the smallest
fixture, with size-based broadcasting off so plans look as on a large input)."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from convlens.operators import mart
from convlens.sources import inspect
from convlens.sources.log import fixture_log
from tests.conftest import SF_SMALL

QUERIES = ["mart_trial_goals", "mart_checks", "dedup_log", "duplicate_report", "robust_log", "robust_filter_impact",
           "org_features", "activity_comparison", "segment_sizes", "feature_histograms", "feature_correlations",
           "activity_sequence", "chi_square_test", "mann_whitney_total", "activity_penetration", "adoption_chi_square",
           "activity_transitions", "log_summary", "model_split", "stage_features"]


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture()
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", QUERIES)
def test_no_cartesian_or_nested_loop_join(spark, no_auto_broadcast, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_staging_rollup_plan(spark, no_auto_broadcast):
    plan = _plan(mart.staging_metrics(mart.prepare_log(fixture_log(spark, SF_SMALL))))
    main = plan.split("===== Subqueries =====")[0]
    # three exchanges: per-user starts, qualifying purchases, events by user;
    # the staging aggregate reuses the join's partitioning
    assert sum(1 for line in main.splitlines() if line.startswith("(") and ") Exchange" in line) == 3
    assert "GreaterThanOrEqual(value,200.0)" in main and "EqualTo(event_type,purchase)" in main
    # the events scan of the final join reads three columns only
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in main


def test_distinct_counts_without_expanding_the_log(spark, no_auto_broadcast):
    from convlens.functions.categories import fixture_category_map
    from convlens.operators import cohorts, features

    log = features.activity_categories(features.temporal_features(fixture_log(spark, SF_SMALL)), fixture_category_map())
    for df in (features.org_features(log), cohorts.segment_org_profiles(log), cohorts.time_cell_tests(log)):
        assert "Expand" not in _plan(df)


def test_profile_reads_each_column_by_itself(spark, no_auto_broadcast):
    plan = _plan(inspect.profile(fixture_log(spark, SF_SMALL)))
    assert "Expand" not in plan
    assert all(p.count(":") <= 1 for p in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


def test_transitions_do_not_join_the_log_with_itself(spark, no_auto_broadcast):
    from convlens.operators import charts, cohorts

    # after slicing one scan of the slices for the rows, one for the table of pieces
    for df in (cohorts.activity_transitions(fixture_log(spark, SF_SMALL)), charts.activity_sequence(fixture_log(spark, SF_SMALL))):
        plan = _plan(df)
        assert plan.count(") SortMergeJoin") == 1  # in the details; the one join is with the pieces
