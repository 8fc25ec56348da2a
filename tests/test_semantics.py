"""Edge rules of the source semantics (null times, first non-null values,
negative days, null organizations, row- vs org-weighted rates)."""

from datetime import datetime

from convlens.functions.categories import PRODUCT_CATEGORY_MAP
from convlens.operators import clean, features, mart
from tests.helpers import LOG_SCHEMA, START, day


def _log(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_null_time_lands_in_week1_day0(spark):
    rows = [("a", "x", None, False, None, START, day(30), 1), ("a", "x", day(10), False, None, START, day(30), 2)]
    prep = {r.EVENT_ID: r for r in mart.prepare_log(_log(spark, rows)).collect()}
    assert (prep[1].trial_week, prep[1].days_since_trial_start) == (1, 0)
    assert (prep[2].trial_week, prep[2].days_since_trial_start) == (2, 10)


def test_first_non_null_facts_per_org(spark):
    rows = [("a", "x", day(1), None, None, None, None, 1),
            ("a", "x", day(2), True, None, START, day(30), 2),
            ("a", "x", day(3), False, None, day(1), day(31), 3)]
    st = mart.staging_metrics(mart.prepare_log(_log(spark, rows))).first()
    assert st.converted is True and str(st.trial_start_date) == "2024-01-01" and str(st.trial_end_date) == "2024-01-31"


def test_negative_days_count_in_week1(spark):
    rows = [("a", "x", day(-2), False, None, START, day(30), 1), ("a", "x", day(3), False, None, START, day(30), 2),
            ("a", "x", day(9), False, None, START, day(30), 3)]
    feat = features.activity_categories(features.temporal_features(_log(spark, rows)), PRODUCT_CATEGORY_MAP)
    o = features.org_features(feat).first()
    assert o.week1_activity_count == 2 and o.time_to_first_activity == -48.0


def test_null_orgs_are_not_organizations(spark):
    rows = [(None, "x", day(1), False, None, START, day(30), 1), ("a", "x", day(1), True, day(2), START, day(30), 2)]
    log = _log(spark, rows)
    assert [r.org_id for r in mart.staging_metrics(mart.prepare_log(log)).collect()] == ["a"]
    cs = clean.conversion_summary(log).first()
    assert (cs.total_orgs, cs.converted_orgs) == (1, 1)
    imp = clean.robust_filter_impact(log).first()
    assert imp.records_before == 2 and imp.orgs_before == 1


def test_row_weighted_vs_org_weighted_rates(spark):
    # org a: 3 converted rows; orgs b, c: 1 row each, not converted
    rows = [("a", "x", day(i), True, day(5), START, day(30), i) for i in range(3)]
    rows += [("b", "x", day(1), False, None, START, day(30), 10), ("c", "x", day(1), False, None, START, day(30), 11)]
    log = _log(spark, rows)
    assert abs(clean.conversion_summary(log).first().conversion_rate_pct - 100.0 / 3) < 1e-12
    assert abs(clean.robust_filter_impact(log).first().row_conversion_rate_before - 0.6) < 1e-12


def test_exploratory_week_of_null_time_is_null(spark):
    rows = [("a", "x", None, False, None, START, day(30), 1)]
    r = features.temporal_features(_log(spark, rows)).first()
    assert r.trial_week is None and r.days_since_trial_start is None
