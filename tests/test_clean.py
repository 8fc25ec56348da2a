from pyspark.sql import functions as F

from convlens.operators import clean
from tests.helpers import log_df


def test_dedup_keeps_first_in_input_order(spark):
    log = log_df(spark, [
        ("a", "x", 1, False, None, 30, 5), ("a", "x", 1, True, None, 30, 2),  # same key: keep id 2
        ("a", "x", 2, False, None, 30, 7), ("b", "x", 1, False, None, 30, 1),
    ])
    out = clean.drop_duplicate_events(log).orderBy("EVENT_ID").collect()
    assert [r.EVENT_ID for r in out] == [1, 2, 7]
    assert out[1].CONVERTED is True  # whole row of the first copy
    again = clean.drop_duplicate_events(clean.drop_duplicate_events(log))
    assert again.count() == 3  # idempotent


def test_dedup_hot_key(spark):
    rows = [("hot", "x", 1, False, None, 30, i) for i in range(500, 0, -1)] + [("b", "y", 2, False, None, 30, 1000)]
    out = clean.drop_duplicate_events(log_df(spark, rows)).collect()
    assert sorted(r.EVENT_ID for r in out) == [1, 1000]


def test_duplicate_report_and_top(spark):
    log = log_df(spark, [
        ("a", "x", 1, False, None, 30, 1), ("a", "x", 1, False, None, 30, 2), ("a", "x", 1, False, None, 30, 3),
        ("b", "y", 1, False, None, 30, 4), ("b", "y", 1, False, None, 30, 5), ("c", "z", 1, False, None, 30, 6),
    ])
    r = clean.duplicate_report(log).first()
    assert (r.total_rows, r.duplicate_rows, r.rows_after) == (6, 3, 3)
    assert (r.orgs_with_duplicates, r.activities_with_duplicates) == (2, 2)
    assert abs(r.duplicate_pct - 50.0) < 1e-12
    top = clean.duplicate_top_activities(log).collect()
    assert [(t.ACTIVITY_NAME, t.duplicate_count) for t in top] == [("x", 2), ("y", 1)]


def test_type_conversion_counts_failures(spark):
    text = spark.createDataFrame(
        [("a", "x", "2024-01-01 10:00:00", "true", None, "2024-01-01", "2024-01-31", "1"),
         ("a", "x", "garbage", "false", "2024-01-05 00:00:00", "2024-01-01", "2024-01-31", "2"),
         ("a", "x", None, "maybe", None, "2024-01-01", "not a date", "3")],
        "ORGANIZATION_ID string, ACTIVITY_NAME string, TIMESTAMP string, CONVERTED string, CONVERTED_AT string, "
        "TRIAL_START string, TRIAL_END string, EVENT_ID string")
    rep = {r.column_name: r for r in clean.type_conversion_report(text).collect()}
    assert rep["TIMESTAMP"].failures == 1 and rep["TIMESTAMP"].raw_nulls == 1 and rep["TIMESTAMP"].typed_nulls == 2
    assert rep["CONVERTED"].failures == 1
    assert rep["TRIAL_END"].failures == 1
    assert rep["CONVERTED_AT"].failures == 0
    typed = clean.type_log(text)
    assert dict(typed.dtypes)["TIMESTAMP"] == "timestamp_ntz"


def test_rules(spark):
    log = log_df(spark, [
        ("a", "x", -1, True, 31, 30), ("a", "x", 5, True, 31, 30),   # rule 1 violation, rule 2 violation x2
        ("b", "x", 3, False, None, 14),                              # rule 3: 14-day trial
        ("c", "x", 3, False, None, 31),                              # 31 is within 30 +- 1
    ])
    res = {r.rule_id: r for r in clean.rule_results(log).collect()}
    assert (res[1].violations, res[1].passed) == (1, False)
    assert (res[2].violations, res[2].passed) == (2, False)
    assert (res[3].violations, res[3].passed) == (1, False)
    s = clean.rule_summary(log).first()
    assert (s.rules_checked, s.rules_passed, s.anomalous_records) == (3, 0, 1)
    d = clean.trial_duration_stats(log).first()
    assert (d.min_duration, d.max_duration, d.orgs_out_of_tolerance) == (14, 31, 1)


def test_robust_filter_bounds_inclusive(spark):
    rows = []
    for org, n in [("a", 2), ("b", 3), ("c", 5), ("d", 8), ("e", 40)]:
        rows += [(org, "x", i * 0.1, False, None, 30) for i in range(n)]
    log = log_df(spark, rows)
    kept = {r.ORGANIZATION_ID: r for r in clean.robust_orgs(log).collect()}
    # counts 2,3,5,8,40 -> P95 = 8 + 0.8 * 32 = 33.6; keep 3 <= n <= 33.6
    assert set(kept) == {"b", "c", "d"}
    assert abs(kept["b"].max_activities - 33.6) < 1e-9
    assert clean.robust_filter(log).count() == 16
    imp = clean.robust_filter_impact(log).first()
    assert (imp.records_before, imp.records_after, imp.orgs_before, imp.orgs_after) == (58, 16, 5, 3)


def test_missing_and_consistency(spark):
    log = log_df(spark, [("a", "x", 1, True, None, 30), ("b", "x", 1, False, 2, 30), ("b", "y", 1, False, None, 30)])
    cc = clean.conversion_consistency(log).first()
    assert (cc.true_without_time, cc.false_with_time, cc.rows_converted_at_null) == (1, 1, 2)
    mv = {r.column_name: r for r in clean.missing_values(log).collect()}
    assert mv["CONVERTED_AT"].missing_count == 2
    cs = clean.conversion_summary(log).first()
    assert (cs.total_orgs, cs.converted_orgs) == (2, 1)
