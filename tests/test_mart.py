"""Mart semantics: goldens retyped from the reference's exported activation
mart (week1, week2, week4, total and the goals 30 / 3 / 0.8), plus literal rows
for the branches those rows never reach."""

from pyspark.sql import functions as F

from convlens.operators import mart
from tests.helpers import log_df

GOALS = [("WEEK1_MIN_ACTIVITY", "w1", 30.0, ""), ("MINIMAL_EVENTS_THRESHOLD", "me", 3.0, ""),
         ("WEEK4_STEADINESS_RATIO", "r", 0.8, "")]

# (week1, week2, week4, total, week4 target)
GOLDEN = [
    (102, 2, 90, 419, 81.60000000000001),
    (80, 101, 114, 411, 64.0),
    (32, 15, 90, 160, 25.6),
    (51, 21, 101, 229, 40.800000000000004),
    (46, 6, 43, 96, 36.800000000000004),
]


def _staging(spark, rows):
    return spark.createDataFrame(
        [(f"org{i}", w1, w2, 0, w4, tot, conv) for i, (w1, w2, w4, tot, conv) in enumerate(rows)],
        "org_id string, week1_activities long, week2_activities long, week3_activities long, "
        "week4_activities long, total_activities long, converted boolean",
    ).withColumn("trial_start_date", F.lit(None).cast("date")).withColumn("trial_end_date", F.lit(None).cast("date"))


def _goals(spark, w1=30.0, me=3.0, r=0.8):
    g = [("WEEK1_MIN_ACTIVITY", "w1", w1, ""), ("MINIMAL_EVENTS_THRESHOLD", "me", me, ""),
         ("WEEK4_STEADINESS_RATIO", "r", r, "")]
    return spark.createDataFrame(g, "goal_id string, metric_name string, threshold_value double, description string")


def test_golden_activation_rows(spark):
    staging = _staging(spark, [(w1, w2, w4, tot, False) for w1, w2, w4, tot, _ in GOLDEN])
    act = mart.trial_activation(mart.trial_goals(staging, _goals(spark))).orderBy("org_id").collect()
    assert len(act) == 5
    for row, (w1, w2, w4, tot, target) in zip(act, GOLDEN):
        assert row.week4_target_activities == target  # exact float, e.g. 81.60000000000001
        assert row.week1_completion_pct == 100.0
        assert row.minimal_events_completion_pct == 100.0
        assert row.week4_completion_pct == 100.0
        assert row.overall_achieved == 1
        assert row.avg_performance_score == 100.0


def test_partial_branches(spark):
    staging = _staging(spark, [
        (15, 0, 6, 2, False),   # week1 50%, minimal events 66.67%, week4 6/12 = 50%
        (0, 0, 0, 0, False),    # zero week 1 -> target 0 -> week 4 counts as 100
        (40, 0, 40, 80, True),  # converted: not in the open-trial mart
    ])
    rows = {r.org_id: r for r in mart.trial_goals(staging, _goals(spark)).collect()}
    assert set(rows) == {"org0", "org1"}
    a = rows["org0"]
    assert a.week1_completion_pct == 15 / 30.0 * 100.0
    assert a.minimal_events_completion_pct == 2 / 3.0 * 100.0
    assert a.week4_target_activities == 15 * 0.8
    assert a.week4_completion_pct == 6 / (15 * 0.8) * 100.0
    assert a.overall_achieved == 0
    b = rows["org1"]
    assert b.week4_target_activities == 0.0 and b.week4_completion_pct == 100.0


def test_zero_threshold_counts_as_complete(spark):
    staging = _staging(spark, [(0, 0, 0, 0, False)])
    r = mart.trial_goals(staging, _goals(spark, w1=0.0, me=0.0)).first()
    assert r.week1_completion_pct == 100.0 and r.minimal_events_completion_pct == 100.0


def test_staging_weeks_and_fallback_threshold(spark):
    # org a: events on days -1 (clipped to week 1), 0, 8, 15, 29 -> weeks 1,1,2,3,4
    log = log_df(spark, [
        ("a", "x", -0.5, False, None, 30), ("a", "x", 0.2, False, None, 30), ("a", "y", 8, False, None, 30),
        ("a", "y", 15, False, None, 30), ("a", "z", 29, False, None, 30),
        ("b", "x", 1, False, None, 30),
    ])
    st = {r.org_id: r for r in mart.staging_metrics(mart.prepare_log(log)).collect()}
    a = st["a"]
    assert (a.week1_activities, a.week2_activities, a.week3_activities, a.week4_activities) == (2, 1, 1, 1)
    assert a.total_activities == 5
    # weeks sum to the total for every org
    for r in st.values():
        assert r.week1_activities + r.week2_activities + r.week3_activities + r.week4_activities == r.total_activities
    goals = {r.goal_id: r for r in mart.activation_goals(mart.staging_metrics(mart.prepare_log(log))).collect()}
    # nobody converted: fallback threshold 10
    assert goals["WEEK1_MIN_ACTIVITY"].threshold_value == 10.0
    assert goals["WEEK1_MIN_ACTIVITY"].description.endswith("orgs: 10.0)")


def test_week1_percentile_interpolates(spark):
    staging = _staging(spark, [(w, 0, 0, w, True) for w in (10, 20, 30, 41)] + [(5, 0, 0, 5, False)])
    g = {r.goal_id: r for r in mart.activation_goals(staging).collect()}
    # P75 of 10, 20, 30, 41 with linear interpolation: 30 + 0.25 * 11 = 32.75
    assert g["WEEK1_MIN_ACTIVITY"].threshold_value == 32.75
    assert "32.8" in g["WEEK1_MIN_ACTIVITY"].description


def test_quality_checks_flag_open_trial_count(spark):
    staging = _staging(spark, [(40, 0, 40, 80, True), (40, 0, 40, 80, False)])
    goals = _goals(spark)
    gm = mart.trial_goals(staging, goals)
    checks = {r.check_name: r for r in mart.quality_checks(staging, goals, gm, mart.trial_activation(gm)).collect()}
    assert checks["record_count_consistency"].passed is False  # staging counts converted orgs too
    assert checks["open_trial_count_consistency"].passed is True
    assert checks["view_consistency"].passed is True
    assert checks["all_checks_passed"].passed is False
