import math

from pyspark.sql import functions as F

from convlens.functions.categories import PRODUCT_CATEGORY_MAP, fixture_category_map
from convlens.operators import features
from tests.helpers import log_df


def test_floor_days_and_weeks(spark):
    log = log_df(spark, [("a", "x", -0.5, False, None, 30), ("a", "x", 6.9, False, None, 30),
                         ("a", "x", 7.0, False, None, 30), ("a", "x", 29.5, False, None, 30)])
    rows = features.temporal_features(log).orderBy("TIMESTAMP").collect()
    assert [r.days_since_trial_start for r in rows] == [-1, 6, 7, 29]
    assert [r.trial_week for r in rows] == [0, 1, 2, 4]  # exploratory rule: capped above only
    assert [r.days_until_trial_end for r in rows] == [30, 23, 23, 0]
    assert rows[0].day_of_week == 6 and rows[0].is_weekend == 1  # 2023-12-31 was a Sunday


def test_categories_and_unmapped(spark):
    log = log_df(spark, [("a", "PunchClock.PunchedIn", 1, False, None, 30), ("a", "Unknown.Thing", 1, False, None, 30)])
    cats = {r.ACTIVITY_NAME: r.activity_category for r in features.activity_categories(log, PRODUCT_CATEGORY_MAP).collect()}
    assert cats == {"PunchClock.PunchedIn": "Time_Tracking", "Unknown.Thing": "Other"}
    assert [r.ACTIVITY_NAME for r in features.unmapped_activities(log, PRODUCT_CATEGORY_MAP).collect()] == ["Unknown.Thing"]
    assert len(PRODUCT_CATEGORY_MAP) == 28 and len(set(PRODUCT_CATEGORY_MAP.values())) == 6
    m = spark.createDataFrame(list(PRODUCT_CATEGORY_MAP.items()), "a string, c string")
    cats2 = {r.ACTIVITY_NAME: r.activity_category for r in features.activity_categories(log, m).collect()}
    assert cats2 == cats
    assert fixture_category_map()["click.3"] == "Engagement" and "error.0" not in fixture_category_map()


def _org(spark, rows):
    feat = features.activity_categories(features.temporal_features(log_df(spark, rows)), PRODUCT_CATEGORY_MAP)
    return {r.ORGANIZATION_ID: r for r in features.org_features(feat).collect()}


def test_org_features(spark):
    rows = [("a", "PunchClock.PunchedIn", 0.5, True, 20, 30, 1), ("a", "PunchClock.PunchedIn", 1.5, True, 20, 30, 2),
            ("a", "Absence.Request.Created", 8.0, True, 20, 30, 3), ("a", "Z", 22.0, True, 20, 30, 4),
            ("b", "Z", 2.25, False, None, 0, 5)]
    o = _org(spark, rows)
    a = o["a"]
    assert a.total_activities_count == 4 and a.unique_activities_count == 3 and a.unique_categories_count == 3
    assert a.activities_per_day == 4 / 30 and a.days_active == 4
    assert a.activity_density == (4 / 30) / 4
    assert a.time_to_first_activity == 12.0
    assert a.week1_activity_count == 2 and a.week1_activity_ratio == 0.5 and a.early_vs_late_ratio == 1.0
    assert a.front_loaded_pattern == 0 and a.week1_engagement_binary == 1
    assert (a.activities_week1, a.activities_week2, a.activities_week3, a.activities_week4_plus) == (2, 1, 0, 1)
    assert a.converted is True
    assert abs(a.activity_spread - __import__("statistics").stdev([0, 1, 8, 22])) < 1e-12
    b = o["b"]  # one row, zero-length trial, no late rows
    assert b.activity_spread == 0.0 and b.activities_per_day == 0.0
    assert math.isinf(b.early_vs_late_ratio) and b.front_loaded_pattern == 1
    assert b.time_to_first_activity == 54.0


def test_temporal_feature_stats(spark):
    log = log_df(spark, [("a", "x", d, False, None, 30) for d in (0.1, 1.1, 2.1)])
    st = {r.feature: r for r in features.temporal_feature_stats(features.temporal_features(log)).collect()}
    assert st["days_since_trial_start"].mean_value == 1.0
    assert st["days_since_trial_start"].std_value == 1.0


def test_safe_divide_and_percentage_change(spark):
    from convlens.functions.expr import percentage_change, safe_divide
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (0.0, 5.0)], "a double, b double")
    r = df.select(safe_divide("a", "b").alias("q"), percentage_change("a", "b").alias("p")).collect()
    assert [x.q for x in r] == [0.5, 0.0, None, 0.0]
    assert [x.p for x in r] == [100.0, -100.0, None, None]
