"""DuckDB twins of the registered queries.

Every twin starts from the same fixture the Spark side builds
(``sources.log.fixture_log``): the driver's ``events`` table seen as an
activity log.  They are independent formulations in plain SQL, used as the
correctness oracle at sf0.01.
"""

from __future__ import annotations

FIXTURE_CTE = r"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         event_type || '.' || CAST(TRY_CAST(regexp_extract(props, '(-?\d+)', 1) AS BIGINT) % 6 AS VARCHAR) AS activity
  FROM events),
starts AS (
  SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS trial_start FROM ev GROUP BY user_id),
convs AS (
  SELECT s.user_id, min(e.ts) AS converted_at
  FROM ev e JOIN starts s ON e.user_id = s.user_id
  WHERE e.event_type = 'purchase' AND e.value >= 200 AND e.ts >= s.trial_start
  GROUP BY s.user_id),
trial_log AS (
  SELECT e.user_id AS ORGANIZATION_ID, e.activity AS ACTIVITY_NAME, e.ts AS "TIMESTAMP",
         c.converted_at IS NOT NULL AS CONVERTED, c.converted_at AS CONVERTED_AT,
         s.trial_start AS TRIAL_START,
         s.trial_start + to_days(CAST(CASE WHEN e.user_id % 20 = 0 THEN 14 WHEN e.user_id % 7 = 0 THEN 31 ELSE 30 END AS INTEGER)) AS TRIAL_END,
         e.event_id AS EVENT_ID
  FROM ev e JOIN starts s ON e.user_id = s.user_id LEFT JOIN convs c ON e.user_id = c.user_id)
"""

# floor((b - a) in days), as an INTEGER
def days(a: str, b: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {a}, {b}) / 86400000000.0) AS INTEGER)"


MART_CTE = f"""
prepared AS (
  SELECT *, COALESCE(CASE WHEN {days('TRIAL_START', '"TIMESTAMP"')} IS NOT NULL
                          THEN LEAST(GREATEST(CAST(floor({days('TRIAL_START', '"TIMESTAMP"')} / 7.0) + 1 AS INTEGER), 1), 4) END, 1) AS trial_week
  FROM trial_log),
staging AS (
  SELECT ORGANIZATION_ID AS org_id,
         count(*) FILTER (WHERE trial_week = 1) AS week1_activities,
         count(*) FILTER (WHERE trial_week = 2) AS week2_activities,
         count(*) FILTER (WHERE trial_week = 3) AS week3_activities,
         count(*) FILTER (WHERE trial_week = 4) AS week4_activities,
         count(*) AS total_activities,
         COALESCE(arg_min(CONVERTED, EVENT_ID) FILTER (WHERE CONVERTED IS NOT NULL), false) AS converted,
         CAST(arg_min(TRIAL_START, EVENT_ID) FILTER (WHERE TRIAL_START IS NOT NULL) AS DATE) AS trial_start_date,
         CAST(arg_min(TRIAL_END, EVENT_ID) FILTER (WHERE TRIAL_END IS NOT NULL) AS DATE) AS trial_end_date
  FROM prepared WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ORGANIZATION_ID),
w1 AS (
  SELECT COALESCE(quantile_cont(CAST(week1_activities AS DOUBLE), 0.75), 10.0) AS t FROM staging WHERE converted),
goals AS (
  SELECT 'WEEK1_MIN_ACTIVITY' AS goal_id, 'Week 1 Minimum Activities' AS metric_name, t AS threshold_value,
         'Minimum activities required in first week (75th percentile of converted orgs: ' || printf('%.1f', round_even(t, 1)) || ')' AS description, 1 AS pos FROM w1
  UNION ALL SELECT 'MINIMAL_EVENTS_THRESHOLD', 'Minimal Events (Modeling Basis)', 3.0,
         'Minimal total events required as basis for modeling (fixed threshold: 3)', 2
  UNION ALL SELECT 'WEEK4_STEADINESS_RATIO', 'Week 4 Steadiness Ratio', 0.8,
         'Week 4 activities must be ≥80% of Week 1 activities (fixed business rule)', 3),
thr AS (
  SELECT max(threshold_value) FILTER (WHERE goal_id = 'WEEK1_MIN_ACTIVITY') AS w1_goal,
         max(threshold_value) FILTER (WHERE goal_id = 'MINIMAL_EVENTS_THRESHOLD') AS events_goal,
         max(threshold_value) FILTER (WHERE goal_id = 'WEEK4_STEADINESS_RATIO') AS ratio
  FROM goals),
open_trials AS (
  SELECT s.org_id, s.week1_activities, s.week2_activities, s.week4_activities, s.total_activities, s.converted,
         s.trial_start_date, s.trial_end_date, t.w1_goal, t.events_goal,
         s.week1_activities * t.ratio AS week4_target_activities
  FROM staging s, thr t WHERE s.converted = false),
progress AS (
  SELECT org_id, week1_activities, week2_activities, week4_activities, total_activities, converted,
         trial_start_date, trial_end_date, week4_target_activities,
         if(week1_activities >= w1_goal OR w1_goal = 0, 100.0, CAST(week1_activities AS DOUBLE) / w1_goal * 100.0) AS week1_completion_pct,
         if(total_activities >= events_goal OR events_goal = 0, 100.0, CAST(total_activities AS DOUBLE) / events_goal * 100.0) AS minimal_events_completion_pct,
         if(week4_activities >= week4_target_activities OR week4_target_activities = 0, 100.0,
            CAST(week4_activities AS DOUBLE) / week4_target_activities * 100.0) AS week4_completion_pct
  FROM open_trials),
mart_goals AS (
  SELECT org_id, week1_activities, week2_activities, week4_activities, total_activities, converted,
         trial_start_date, trial_end_date, week1_completion_pct, minimal_events_completion_pct,
         week4_target_activities, week4_completion_pct,
         CAST(least(week1_completion_pct, minimal_events_completion_pct, week4_completion_pct) >= 100 AS INTEGER) AS overall_achieved
  FROM progress),
mart_activation AS (
  SELECT m.*, round((m.week1_completion_pct + m.minimal_events_completion_pct + m.week4_completion_pct) / 3.0, 2) AS avg_performance_score
  FROM mart_goals m WHERE m.overall_achieved = 1)
"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def fixture_sql(body: str) -> str:
    return with_ctes(FIXTURE_CTE, body=body)


def mart_sql(body: str) -> str:
    return with_ctes(FIXTURE_CTE, MART_CTE, body=body)


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ------------------------------------------------------------------ the mart
register("staging_metrics_per_org", mart_sql("SELECT * FROM staging"))
register("live_staging_metrics", mart_sql("SELECT * FROM staging"))
register("staging_activation_goals", mart_sql("SELECT goal_id, metric_name, threshold_value, description FROM goals"))
register("mart_trial_goals", mart_sql("SELECT * FROM mart_goals"))
register("mart_trial_activation", mart_sql("SELECT * FROM mart_activation"))
register("trial_week_distribution", mart_sql("SELECT trial_week, count(*) AS records FROM prepared GROUP BY trial_week"))
register("goal_stats", mart_sql("""
SELECT CAST(COALESCE(sum(overall_achieved), 0) AS BIGINT) AS activated_orgs, count(*) AS total_orgs,
       round(avg(week1_completion_pct), 1) AS avg_week1_completion,
       round(avg(minimal_events_completion_pct), 1) AS avg_minimal_events_completion,
       round(avg(week4_completion_pct), 1) AS avg_week4_completion,
       CASE WHEN count(*) > 0 THEN CAST(COALESCE(sum(overall_achieved), 0) AS BIGINT) / count(*) * 100.0 END AS activation_rate_open_pct
FROM mart_goals"""))
register("completion_stats", mart_sql("""
SELECT round(avg(week1_completion_pct), 1) AS avg_week1,
       round(avg(minimal_events_completion_pct), 1) AS avg_minimal_events,
       round(avg(week4_completion_pct), 1) AS avg_week4,
       count(*) FILTER (WHERE week1_completion_pct >= 100) AS week1_achieved,
       count(*) FILTER (WHERE minimal_events_completion_pct >= 100) AS minimal_events_achieved,
       count(*) FILTER (WHERE week4_completion_pct >= 100) AS week4_achieved,
       count(*) AS total
FROM mart_goals"""))
register("performance_stats", mart_sql("""
SELECT round(avg(avg_performance_score), 1) AS avg_performance, round(min(avg_performance_score), 1) AS min_performance,
       round(max(avg_performance_score), 1) AS max_performance, count(*) AS activated_orgs
FROM mart_activation"""))
register("mart_summary", mart_sql("""
SELECT (SELECT count(*) FROM staging) AS total_orgs, (SELECT count(*) FROM staging WHERE converted) AS converted_orgs,
       (SELECT count(*) FROM goals) AS total_goals,
       (SELECT count(*) FROM mart_activation) AS activated_orgs,
       CASE WHEN (SELECT count(*) FROM staging) > 0
            THEN (SELECT count(*) FROM mart_activation) / (SELECT count(*) FROM staging) * 100.0 END AS activation_rate_all_pct"""))
register("mart_sample", mart_sql("""
SELECT org_id, week1_activities, total_activities, week4_activities, week1_completion_pct,
       minimal_events_completion_pct, week4_completion_pct, overall_achieved
FROM mart_goals ORDER BY org_id LIMIT 5"""))
register("mart_checks", mart_sql("""
, c AS (
  SELECT 'record_count_consistency' AS check_name,
         (SELECT count(*) FROM staging) = (SELECT count(*) FROM mart_goals) AS passed,
         CAST((SELECT count(*) FROM staging) AS DOUBLE) AS lhs, CAST((SELECT count(*) FROM mart_goals) AS DOUBLE) AS rhs
  UNION ALL SELECT 'open_trial_count_consistency',
         (SELECT count(*) FROM staging WHERE NOT converted) = (SELECT count(*) FROM mart_goals),
         CAST((SELECT count(*) FROM staging WHERE NOT converted) AS DOUBLE), CAST((SELECT count(*) FROM mart_goals) AS DOUBLE)
  UNION ALL SELECT 'thresholds_positive',
         (SELECT max(threshold_value) FROM goals WHERE goal_id = 'WEEK1_MIN_ACTIVITY') > 0
           AND (SELECT max(threshold_value) FROM goals WHERE goal_id = 'MINIMAL_EVENTS_THRESHOLD') > 0,
         (SELECT max(threshold_value) FROM goals WHERE goal_id = 'WEEK1_MIN_ACTIVITY'),
         (SELECT max(threshold_value) FROM goals WHERE goal_id = 'MINIMAL_EVENTS_THRESHOLD')
  UNION ALL SELECT 'sample_data_exists',
         (SELECT count(*) FROM (SELECT * FROM mart_goals ORDER BY org_id LIMIT 5)) > 0,
         CAST((SELECT count(*) FROM (SELECT * FROM mart_goals ORDER BY org_id LIMIT 5)) AS DOUBLE), 0.0
  UNION ALL SELECT 'view_consistency',
         (SELECT count(*) FROM mart_activation) = (SELECT count(*) FROM mart_goals WHERE overall_achieved = 1),
         CAST((SELECT count(*) FROM mart_activation) AS DOUBLE),
         CAST((SELECT count(*) FROM mart_goals WHERE overall_achieved = 1) AS DOUBLE))
SELECT * FROM c
UNION ALL
SELECT 'all_checks_passed', bool_and(passed OR check_name = 'open_trial_count_consistency'),
       CAST(count(*) FILTER (WHERE passed) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM c""").replace("\n)\n, c AS", "),\nc AS"))


# ------------------------------------------------------------------ cleaning
LOG_COLS = ["ORGANIZATION_ID", "ACTIVITY_NAME", "TIMESTAMP", "CONVERTED", "CONVERTED_AT", "TRIAL_START", "TRIAL_END", "EVENT_ID"]
LOG_TYPES = ["bigint", "string", "timestamp_ntz", "boolean", "timestamp_ntz", "timestamp_ntz", "timestamp_ntz", "bigint"]


def _q(c: str) -> str:
    return f'"{c}"'


register("log_profile", fixture_sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS dtype, "
    f"count(*) FILTER (WHERE {_q(c)} IS NULL) AS null_count, "
    f"CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {_q(c)} IS NULL) / count(*) * 100.0 ELSE 0.0 END AS null_pct, "
    f"count(DISTINCT {_q(c)}) AS distinct_count, count(*) AS row_count, CAST({len(LOG_COLS)} AS INTEGER) AS column_count FROM trial_log"
    for i, (c, t) in enumerate(zip(LOG_COLS, LOG_TYPES))) + ")"))

register("log_preview", fixture_sql('SELECT * FROM trial_log ORDER BY ORGANIZATION_ID, "TIMESTAMP", EVENT_ID LIMIT 5'))

DUP_CTE = """
dup_log AS (
  SELECT * FROM trial_log
  UNION ALL SELECT ORGANIZATION_ID, ACTIVITY_NAME, "TIMESTAMP", CONVERTED, CONVERTED_AT, TRIAL_START, TRIAL_END,
                   EVENT_ID + 1000000000 FROM trial_log WHERE EVENT_ID % 10 = 0),
key_counts AS (
  SELECT ORGANIZATION_ID, ACTIVITY_NAME, "TIMESTAMP", count(*) AS n FROM dup_log GROUP BY ALL)
"""
register("dedup_log", with_ctes(FIXTURE_CTE, DUP_CTE, body="""
SELECT ORGANIZATION_ID, ACTIVITY_NAME, "TIMESTAMP", CONVERTED, CONVERTED_AT, TRIAL_START, TRIAL_END, EVENT_ID
FROM dup_log QUALIFY row_number() OVER (PARTITION BY ORGANIZATION_ID, ACTIVITY_NAME, "TIMESTAMP" ORDER BY EVENT_ID) = 1"""))
register("duplicate_report", with_ctes(FIXTURE_CTE, DUP_CTE, body="""
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       CASE WHEN sum(n) > 0 THEN sum(n - 1) / sum(n) * 100.0 ELSE 0.0 END AS duplicate_pct,
       count(DISTINCT CASE WHEN n > 1 THEN ORGANIZATION_ID END) AS orgs_with_duplicates,
       count(DISTINCT CASE WHEN n > 1 THEN ACTIVITY_NAME END) AS activities_with_duplicates,
       count(*) AS rows_after
FROM key_counts"""))
register("duplicate_top_activities", with_ctes(FIXTURE_CTE, DUP_CTE, body="""
SELECT ACTIVITY_NAME, CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM key_counts WHERE n > 1
GROUP BY ACTIVITY_NAME ORDER BY duplicate_count DESC, ACTIVITY_NAME LIMIT 10"""))

TEXT_CTE = """
text_log AS (
  SELECT CAST(ORGANIZATION_ID AS VARCHAR) AS ORGANIZATION_ID, ACTIVITY_NAME,
         CASE WHEN EVENT_ID % 97 = 0 THEN 'garbage' ELSE CAST("TIMESTAMP" AS VARCHAR) END AS "TIMESTAMP",
         CAST(CONVERTED AS VARCHAR) AS CONVERTED, CAST(CONVERTED_AT AS VARCHAR) AS CONVERTED_AT,
         CAST(TRIAL_START AS VARCHAR) AS TRIAL_START, CAST(TRIAL_END AS VARCHAR) AS TRIAL_END, EVENT_ID
  FROM trial_log),
typed AS (
  SELECT TRY_CAST(ORGANIZATION_ID AS BIGINT) AS ORGANIZATION_ID, ACTIVITY_NAME,
         TRY_CAST("TIMESTAMP" AS TIMESTAMP) AS "TIMESTAMP", TRY_CAST(CONVERTED AS BOOLEAN) AS CONVERTED,
         TRY_CAST(CONVERTED_AT AS TIMESTAMP) AS CONVERTED_AT, TRY_CAST(TRIAL_START AS TIMESTAMP) AS TRIAL_START,
         TRY_CAST(TRIAL_END AS TIMESTAMP) AS TRIAL_END, TRY_CAST(EVENT_ID AS BIGINT) AS EVENT_ID
  FROM text_log)
"""
register("typed_log", with_ctes(FIXTURE_CTE, TEXT_CTE, body="SELECT * FROM typed"))
_TARGETS = [("TIMESTAMP", "timestamp_ntz", "TIMESTAMP"), ("CONVERTED_AT", "timestamp_ntz", "TIMESTAMP"),
            ("TRIAL_START", "timestamp_ntz", "TIMESTAMP"), ("TRIAL_END", "timestamp_ntz", "TIMESTAMP"),
            ("CONVERTED", "boolean", "BOOLEAN")]
register("type_conversion_report", with_ctes(FIXTURE_CTE, TEXT_CTE, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS target_type, count(*) FILTER (WHERE {_q(c)} IS NULL) AS raw_nulls, "
    f"count(*) FILTER (WHERE TRY_CAST({_q(c)} AS {d}) IS NULL) AS typed_nulls, "
    f"count(*) FILTER (WHERE {_q(c)} IS NOT NULL AND TRY_CAST({_q(c)} AS {d}) IS NULL) AS failures FROM text_log"
    for c, t, d in _TARGETS)))
register("timestamp_ranges", with_ctes(FIXTURE_CTE, TEXT_CTE, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({_q(c)}) AS min_value, max({_q(c)}) AS max_value FROM typed"
    for c in ["TIMESTAMP", "CONVERTED_AT", "TRIAL_START", "TRIAL_END"])))
register("missing_values", with_ctes(FIXTURE_CTE, TEXT_CTE, body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_q(c)} IS NULL) AS missing_count, "
    f"CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE {_q(c)} IS NULL) / count(*) * 100.0 ELSE 0.0 END AS missing_pct FROM typed"
    for c in LOG_COLS)))
register("conversion_consistency", fixture_sql("""
SELECT count(*) FILTER (WHERE CONVERTED = true) AS rows_converted_true,
       count(*) FILTER (WHERE CONVERTED = false) AS rows_converted_false,
       count(*) FILTER (WHERE CONVERTED_AT IS NULL) AS rows_converted_at_null,
       count(*) FILTER (WHERE CONVERTED = false AND CONVERTED_AT IS NOT NULL) AS false_with_time,
       count(*) FILTER (WHERE CONVERTED = true AND CONVERTED_AT IS NULL) AS true_without_time
FROM trial_log"""))
register("conversion_summary", fixture_sql("""
SELECT count(DISTINCT ORGANIZATION_ID) AS total_orgs,
       count(DISTINCT ORGANIZATION_ID) FILTER (WHERE CONVERTED) AS converted_orgs,
       CASE WHEN count(DISTINCT ORGANIZATION_ID) > 0
            THEN count(DISTINCT ORGANIZATION_ID) FILTER (WHERE CONVERTED) / count(DISTINCT ORGANIZATION_ID) * 100.0 END AS conversion_rate_pct
FROM trial_log"""))
register("rule_anomalies", fixture_sql("""
SELECT * FROM trial_log WHERE "TIMESTAMP" < TRIAL_START OR "TIMESTAMP" > TRIAL_END"""))

DUR_CTE = f"""
durations AS (
  SELECT ORGANIZATION_ID, arg_min({days('TRIAL_START', 'TRIAL_END')}, EVENT_ID) FILTER (WHERE TRIAL_START IS NOT NULL AND TRIAL_END IS NOT NULL) AS trial_duration
  FROM trial_log WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ORGANIZATION_ID)
"""
register("trial_duration_stats", with_ctes(FIXTURE_CTE, DUR_CTE, body="""
SELECT count(trial_duration) AS orgs, min(trial_duration) AS min_duration, max(trial_duration) AS max_duration,
       avg(trial_duration) AS mean_duration, count(*) FILTER (WHERE abs(trial_duration - 30) > 1) AS orgs_out_of_tolerance
FROM durations"""))
RULES_CTE = """
rules AS (
  SELECT CAST(1 AS INTEGER) AS rule_id, 'timestamp_within_trial' AS rule_name,
         count(*) FILTER (WHERE "TIMESTAMP" < TRIAL_START OR "TIMESTAMP" > TRIAL_END) AS violations, count(*) AS checked FROM trial_log
  UNION ALL SELECT 2, 'converted_at_within_trial', count(*) FILTER (WHERE CONVERTED_AT > TRIAL_END), count(CONVERTED_AT) FROM trial_log
  UNION ALL SELECT 3, 'trial_duration_valid', count(*) FILTER (WHERE abs(trial_duration - 30) > 1), count(*) FROM durations)
"""
register("rule_results", with_ctes(FIXTURE_CTE, DUR_CTE, RULES_CTE,
                                   body="SELECT rule_id, rule_name, violations = 0 AS passed, violations, checked FROM rules"))
register("rule_summary", with_ctes(FIXTURE_CTE, DUR_CTE, RULES_CTE, body="""
SELECT count(*) AS rules_checked, count(*) FILTER (WHERE violations = 0) AS rules_passed,
       count(*) FILTER (WHERE violations = 0) / count(*) * 100.0 AS success_pct,
       CAST(sum(CASE WHEN rule_id = 1 THEN violations ELSE 0 END) AS BIGINT) AS anomalous_records
FROM rules"""))
ROBUST_CTE = """
org_counts AS (
  SELECT ORGANIZATION_ID, count(*) AS total_activities, count(*) FILTER (WHERE CONVERTED = true) AS conv_rows
  FROM trial_log GROUP BY ORGANIZATION_ID),
p95 AS (SELECT quantile_cont(CAST(total_activities AS DOUBLE), 0.95) AS p FROM org_counts WHERE ORGANIZATION_ID IS NOT NULL),
kept AS (
  SELECT ORGANIZATION_ID, total_activities, (SELECT p FROM p95) AS max_activities FROM org_counts
  WHERE ORGANIZATION_ID IS NOT NULL AND total_activities >= 3 AND total_activities <= (SELECT p FROM p95))
"""
register("robust_orgs", with_ctes(FIXTURE_CTE, ROBUST_CTE, body="SELECT * FROM kept"))
register("robust_log", with_ctes(FIXTURE_CTE, ROBUST_CTE, body="""
SELECT * FROM trial_log WHERE ORGANIZATION_ID IN (SELECT ORGANIZATION_ID FROM kept)"""))
register("robust_filter_impact", with_ctes(FIXTURE_CTE, ROBUST_CTE, body="""
SELECT CAST(sum(total_activities) AS BIGINT) AS records_before,
       CAST((SELECT sum(total_activities) FROM kept) AS BIGINT) AS records_after,
       CAST(sum(total_activities) - (SELECT sum(total_activities) FROM kept) AS BIGINT) AS records_removed,
       CASE WHEN sum(total_activities) > 0 THEN (sum(total_activities) - (SELECT sum(total_activities) FROM kept)) / sum(total_activities) * 100.0 END AS records_removed_pct,
       count(ORGANIZATION_ID) AS orgs_before, (SELECT count(*) FROM kept) AS orgs_after,
       count(ORGANIZATION_ID) - (SELECT count(*) FROM kept) AS orgs_removed,
       CASE WHEN count(ORGANIZATION_ID) > 0 THEN (count(ORGANIZATION_ID) - (SELECT count(*) FROM kept)) / count(ORGANIZATION_ID) * 100.0 END AS orgs_removed_pct,
       CASE WHEN sum(total_activities) > 0 THEN sum(conv_rows) / sum(total_activities) END AS row_conversion_rate_before,
       CASE WHEN (SELECT sum(total_activities) FROM kept) > 0
            THEN (SELECT sum(o.conv_rows) FROM org_counts o JOIN kept k USING (ORGANIZATION_ID)) / (SELECT sum(total_activities) FROM kept) END AS row_conversion_rate_after,
       (SELECT p FROM p95) AS max_activities
FROM org_counts"""))


# ------------------------------------------------------ features and segments
def r9(expr: str) -> str:
    return f"round({expr}, 9)"


FEATURE_CTE = f"""
feat AS (
  SELECT *,
         {days('TRIAL_START', 'TRIAL_END')} AS trial_duration_days,
         {days('TRIAL_START', '"TIMESTAMP"')} AS days_since_trial_start,
         {days('"TIMESTAMP"', 'TRIAL_END')} AS days_until_trial_end,
         CAST(hour("TIMESTAMP") AS INTEGER) AS hour,
         CAST(isodow("TIMESTAMP") - 1 AS INTEGER) AS day_of_week,
         CAST(CASE WHEN isodow("TIMESTAMP") IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
         CASE WHEN {days('TRIAL_START', '"TIMESTAMP"')} IS NOT NULL
              THEN CAST(LEAST(floor({days('TRIAL_START', '"TIMESTAMP"')} / 7.0) + 1, 4) AS INTEGER) END AS trial_week,
         CASE WHEN ACTIVITY_NAME IN ('click.0','click.1','click.2','click.3','click.4','click.5',
                                     'view.0','view.1','view.2','view.3','view.4','view.5') THEN 'Engagement'
              WHEN ACTIVITY_NAME IN ('purchase.0','purchase.1','purchase.2','purchase.3','purchase.4','purchase.5') THEN 'Commerce'
              WHEN ACTIVITY_NAME IN ('signup.0','signup.1','signup.2','signup.3','signup.4','signup.5') THEN 'Onboarding'
              ELSE 'Other' END AS activity_category
  FROM trial_log),
org_raw AS (
  SELECT ORGANIZATION_ID,
         count(DISTINCT ACTIVITY_NAME) AS unique_activities_count,
         count(*) AS total_activities_count,
         arg_min(trial_duration_days, EVENT_ID) AS dur,
         count(DISTINCT activity_category) AS unique_categories_count,
         count(DISTINCT days_since_trial_start) AS days_active,
         date_diff('microsecond', arg_min(TRIAL_START, EVENT_ID), min("TIMESTAMP")) / 1000000.0 / 3600.0 AS time_to_first_activity,
         CASE WHEN count(*) > 1 THEN stddev_samp(days_since_trial_start) ELSE 0.0 END AS activity_spread,
         count(*) FILTER (WHERE days_since_trial_start < 7) AS week1_activity_count,
         count(*) FILTER (WHERE days_since_trial_start >= 7) AS late,
         count(*) FILTER (WHERE days_since_trial_start >= 7 AND days_since_trial_start < 14) AS activities_week2,
         count(*) FILTER (WHERE days_since_trial_start >= 14 AND days_since_trial_start < 21) AS activities_week3,
         count(*) FILTER (WHERE days_since_trial_start >= 21) AS activities_week4_plus,
         arg_min(CONVERTED, EVENT_ID) AS converted
  FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ORGANIZATION_ID),
org AS (
  SELECT ORGANIZATION_ID, unique_activities_count, total_activities_count,
         CASE WHEN dur > 0 THEN total_activities_count / dur ELSE 0.0 END AS activities_per_day,
         unique_categories_count, days_active,
         CASE WHEN days_active > 0 THEN (CASE WHEN dur > 0 THEN total_activities_count / dur ELSE 0.0 END) / days_active ELSE 0.0 END AS activity_density,
         time_to_first_activity, activity_spread, week1_activity_count,
         CASE WHEN total_activities_count > 0 THEN week1_activity_count / total_activities_count ELSE 0.0 END AS week1_activity_ratio,
         CASE WHEN late > 0 THEN week1_activity_count / late ELSE CAST('inf' AS DOUBLE) END AS early_vs_late_ratio,
         CAST(CASE WHEN (CASE WHEN total_activities_count > 0 THEN week1_activity_count / total_activities_count ELSE 0.0 END) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS front_loaded_pattern,
         CAST(CASE WHEN week1_activity_count > 0 THEN 1 ELSE 0 END AS INTEGER) AS week1_engagement_binary,
         week1_activity_count AS activities_week1, activities_week2, activities_week3, activities_week4_plus, converted
  FROM org_raw)
"""


def feature_sql(body: str, *more: str) -> str:
    return with_ctes(FIXTURE_CTE, FEATURE_CTE, *more, body=body)


register("temporal_features", feature_sql("SELECT * FROM feat"))
register("activity_categories", feature_sql(
    "SELECT ORGANIZATION_ID, ACTIVITY_NAME, \"TIMESTAMP\", CONVERTED, CONVERTED_AT, TRIAL_START, TRIAL_END, EVENT_ID, "
    "activity_category FROM feat"))
TF = ["trial_duration_days", "days_since_trial_start", "days_until_trial_end", "hour", "day_of_week", "trial_week"]
register("temporal_feature_stats", feature_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r9(f'CAST(min({c}) AS DOUBLE)')} AS min_value, {r9(f'CAST(max({c}) AS DOUBLE)')} AS max_value, "
    f"{r9(f'avg({c})')} AS mean_value, {r9(f'stddev_samp({c})')} AS std_value FROM feat" for c in TF)))
register("activity_distribution", feature_sql(
    "SELECT ACTIVITY_NAME, count(*) AS count, count(*) / (SELECT count(*) FROM feat) * 100.0 AS pct FROM feat GROUP BY ACTIVITY_NAME"))
register("category_distribution", feature_sql(
    "SELECT activity_category, count(*) AS count, count(*) / (SELECT count(*) FROM feat) * 100.0 AS pct FROM feat GROUP BY activity_category"))
register("top_activities", feature_sql("""
SELECT ACTIVITY_NAME, count(*) AS count, count(*) / (SELECT count(*) FROM feat) * 100.0 AS pct,
       GREATEST((SELECT count(DISTINCT ACTIVITY_NAME) + max(CASE WHEN ACTIVITY_NAME IS NULL THEN 1 ELSE 0 END) FROM feat) - 10, 0) AS remaining_values
FROM feat GROUP BY ACTIVITY_NAME ORDER BY count DESC, ACTIVITY_NAME LIMIT 10"""))
register("unmapped_activities", feature_sql(
    "SELECT DISTINCT ACTIVITY_NAME FROM feat WHERE activity_category = 'Other'"))
ORG_COLS = ["ORGANIZATION_ID", "unique_activities_count", "total_activities_count", "activities_per_day",
            "unique_categories_count", "days_active", "activity_density", "time_to_first_activity", "activity_spread",
            "week1_activity_count", "week1_activity_ratio", "early_vs_late_ratio", "front_loaded_pattern",
            "week1_engagement_binary", "activities_week1", "activities_week2", "activities_week3",
            "activities_week4_plus", "converted"]
ORG_DOUBLES = {"activities_per_day", "activity_density", "time_to_first_activity", "activity_spread",
               "week1_activity_ratio", "early_vs_late_ratio"}
register("org_features", feature_sql("SELECT " + ", ".join(
    f"{r9(c)} AS {c}" if c in ORG_DOUBLES else c for c in ORG_COLS) + " FROM org"))

SEG_CTE = """
seg AS (
  SELECT *, COALESCE(CONVERTED = false, false) AS s1,
            COALESCE(CONVERTED = true AND "TIMESTAMP" < CONVERTED_AT, false) AS s2,
            COALESCE(CONVERTED = true, false) AS s3
  FROM trial_log)
"""
register("segment_sizes", with_ctes(FIXTURE_CTE, SEG_CTE, body="""
SELECT 'not_converted' AS segment, count(*) FILTER (WHERE s1) AS records, count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s1) AS orgs FROM seg
UNION ALL SELECT 'pre_conversion', count(*) FILTER (WHERE s2), count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s2) FROM seg
UNION ALL SELECT 'all_converted', count(*) FILTER (WHERE s3), count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s3) FROM seg"""))
register("pre_conversion_log", fixture_sql(
    'SELECT * FROM trial_log WHERE CONVERTED = true AND "TIMESTAMP" < CONVERTED_AT'))
register("segment_conversion_rate", with_ctes(FIXTURE_CTE, SEG_CTE, body="""
SELECT count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s1) + count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s2) AS total_orgs,
       count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s2) AS converted_orgs,
       CASE WHEN count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s1) + count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s2) > 0
            THEN count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s2)
                 / (count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s1) + count(DISTINCT ORGANIZATION_ID) FILTER (WHERE s2)) * 100.0
       END AS conversion_rate_pct
FROM seg"""))
register("activity_comparison", with_ctes(FIXTURE_CTE, SEG_CTE, body="""
SELECT ACTIVITY_NAME, count(*) FILTER (WHERE s1) AS not_converted_count, count(*) FILTER (WHERE s2) AS pre_conversion_count,
       count(*) FILTER (WHERE s2) - count(*) FILTER (WHERE s1) AS difference
FROM seg GROUP BY ACTIVITY_NAME HAVING count(*) FILTER (WHERE s1) > 0 OR count(*) FILTER (WHERE s2) > 0
ORDER BY abs(difference) DESC, ACTIVITY_NAME LIMIT 20"""))
BIV = ["total_activities_count", "unique_activities_count", "unique_categories_count", "activities_per_day",
       "days_active", "week1_activity_count", "week1_activity_ratio", "front_loaded_pattern"]
register("feature_comparison", feature_sql(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r9(f'avg({f}) FILTER (WHERE converted = true)')} AS converted_mean, "
    f"{r9(f'avg({f}) FILTER (WHERE converted = false)')} AS non_converted_mean, "
    f"{r9(f'avg({f}) FILTER (WHERE converted = true) - avg({f}) FILTER (WHERE converted = false)')} AS difference, "
    f"{r9(f'CASE WHEN avg({f}) FILTER (WHERE converted = false) IS NULL THEN NULL WHEN avg({f}) FILTER (WHERE converted = false) <> 0 THEN (avg({f}) FILTER (WHERE converted = true) - avg({f}) FILTER (WHERE converted = false)) / avg({f}) FILTER (WHERE converted = false) * 100.0 ELSE 0.0 END')} AS percent_difference FROM org"
    for f in BIV)))
SM = ["days_since_trial_start", "hour", "day_of_week", "is_weekend", "trial_week"]
register("segment_comparison", feature_sql(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, 'not_converted' AS segment1, 'pre_conversion' AS segment2, "
    f"{r9(f'avg({m}) FILTER (WHERE CONVERTED = false)')} AS segment1_mean, "
    f"{r9(f'avg({m}) FILTER (WHERE CONVERTED = true AND \"TIMESTAMP\" < CONVERTED_AT)')} AS segment2_mean, "
    f"{r9(f'avg({m}) FILTER (WHERE CONVERTED = true AND \"TIMESTAMP\" < CONVERTED_AT) - avg({m}) FILTER (WHERE CONVERTED = false)')} AS difference, "
    f"{r9(f'CASE WHEN avg({m}) FILTER (WHERE CONVERTED = false) IS NULL OR avg({m}) FILTER (WHERE CONVERTED = true AND \"TIMESTAMP\" < CONVERTED_AT) IS NULL OR avg({m}) FILTER (WHERE CONVERTED = false) = 0 THEN NULL ELSE (avg({m}) FILTER (WHERE CONVERTED = true AND \"TIMESTAMP\" < CONVERTED_AT) - avg({m}) FILTER (WHERE CONVERTED = false)) / avg({m}) FILTER (WHERE CONVERTED = false) * 100.0 END')} AS pct_change FROM feat"
    for m in SM)))
register("pattern_differences", feature_sql("""
SELECT round(c_w1, 9) AS converted_week1_engagement_pct, round(n_w1, 9) AS non_converted_week1_engagement_pct,
       round(c_fl, 9) AS converted_front_loaded_pct, round(n_fl, 9) AS non_converted_front_loaded_pct,
       round(c_ua, 9) AS converted_unique_activities, round(n_ua, 9) AS non_converted_unique_activities,
       round(c_ca, 9) AS converted_categories, round(n_ca, 9) AS non_converted_categories,
       round(c_w1 - n_w1, 9) AS week1_engagement_diff, round(c_fl - n_fl, 9) AS front_loaded_diff,
       round(c_ua - n_ua, 9) AS unique_activities_diff, round(c_ca - n_ca, 9) AS categories_diff
FROM (SELECT avg(week1_engagement_binary) FILTER (WHERE converted = true) * 100.0 AS c_w1,
             avg(week1_engagement_binary) FILTER (WHERE converted = false) * 100.0 AS n_w1,
             avg(front_loaded_pattern) FILTER (WHERE converted = true) * 100.0 AS c_fl,
             avg(front_loaded_pattern) FILTER (WHERE converted = false) * 100.0 AS n_fl,
             avg(unique_activities_count) FILTER (WHERE converted = true) AS c_ua,
             avg(unique_activities_count) FILTER (WHERE converted = false) AS n_ua,
             avg(unique_categories_count) FILTER (WHERE converted = true) AS c_ca,
             avg(unique_categories_count) FILTER (WHERE converted = false) AS n_ca FROM org)"""))
register("hourly_counts", fixture_sql(
    'SELECT CAST(hour("TIMESTAMP") AS INTEGER) AS hour, count(*) AS records FROM trial_log GROUP BY 1'))
register("weekday_counts", fixture_sql("""
SELECT CAST(d.i AS INTEGER) AS day_index, d.name AS day_name, c.records
FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) d(i, name)
LEFT JOIN (SELECT isodow("TIMESTAMP") - 1 AS i, count(*) AS records FROM trial_log GROUP BY 1) c ON c.i = d.i"""))
register("daily_counts", fixture_sql(
    'SELECT CAST("TIMESTAMP" AS DATE) AS date, count(*) AS records FROM trial_log GROUP BY 1'))
register("weekend_counts", fixture_sql(
    'SELECT isodow("TIMESTAMP") IN (6, 7) AS is_weekend, count(*) AS records FROM trial_log GROUP BY 1'))
HF = ["total_activities_count", "unique_activities_count", "unique_categories_count", "week1_activity_count",
      "week1_activity_ratio", "activities_per_day"]
register("feature_histograms", feature_sql("""
SELECT feature, converted, CAST(b AS INTEGER) AS bin,
       round(lo + b * ((hi - lo) / 20.0), 9) AS bin_start, round(lo + (b + 1) * ((hi - lo) / 20.0), 9) AS bin_end,
       COALESCE(cnt, 0) AS count, round(COALESCE(cnt, 0) / (n * ((hi - lo) / 20.0)), 9) AS density
FROM ranges CROSS JOIN range(0, 20) t(b)
LEFT JOIN binned USING (feature, converted, b)""", """
long AS (""" + " UNION ALL ".join(f"SELECT converted, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM org" for f in HF) + """),
ranges AS (
  SELECT feature, converted, count(*) AS n,
         CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
  FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature, converted),
binned AS (
  SELECT l.feature, l.converted, LEAST(CAST(floor((l.value - r.lo) * (20.0 / (r.hi - r.lo))) AS BIGINT), 19) AS b, count(*) AS cnt
  FROM long l JOIN ranges r USING (feature, converted) WHERE l.value IS NOT NULL AND NOT isnan(l.value) GROUP BY ALL)"""))
CF = ["total_activities_count", "unique_activities_count", "activities_per_day", "unique_categories_count",
      "days_active", "week1_activity_count", "week1_activity_ratio"]
register("feature_correlations", feature_sql(" UNION ALL ".join(
    f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, round(CASE WHEN stddev_samp(CAST({x} AS DOUBLE)) * stddev_samp(CAST({y} AS DOUBLE)) > 0 "
    f"THEN covar_samp(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) / (stddev_samp(CAST({x} AS DOUBLE)) * stddev_samp(CAST({y} AS DOUBLE))) END, 9) AS correlation FROM org"
    for x in CF for y in CF)))
SEQ_SELECT = """
SELECT ORGANIZATION_ID, ACTIVITY_NAME, "TIMESTAMP", EVENT_ID, position,
       round(date_diff('microsecond', first_ts, "TIMESTAMP") / 1000000.0 / 86400.0, 9) AS days_from_start,
       position % 5 = 0 AS labelled, CASE WHEN position % 5 = 0 THEN substr(ACTIVITY_NAME, 1, 20) END AS label
FROM (SELECT *, row_number() OVER (PARTITION BY ORGANIZATION_ID ORDER BY "TIMESTAMP", EVENT_ID) - 1 AS position,
             min("TIMESTAMP") OVER (PARTITION BY ORGANIZATION_ID) AS first_ts FROM src)"""
register("activity_sequence", with_ctes(FIXTURE_CTE, "src AS (SELECT * FROM trial_log)", body=SEQ_SELECT))
register("activity_sequence_sample", with_ctes(FIXTURE_CTE, """
src AS (SELECT * FROM trial_log WHERE ORGANIZATION_ID IN (
  SELECT ORGANIZATION_ID FROM (SELECT DISTINCT ORGANIZATION_ID FROM trial_log)
  ORDER BY md5(CAST(ORGANIZATION_ID AS VARCHAR) || ':42'), ORGANIZATION_ID LIMIT 5))""", body=SEQ_SELECT))
register("log_summary", fixture_sql("""
SELECT count(*) AS total_records, count(DISTINCT ORGANIZATION_ID) AS total_orgs, min("TIMESTAMP") AS first_activity,
       max("TIMESTAMP") AS last_activity, count(DISTINCT ACTIVITY_NAME) AS unique_activities,
       count(DISTINCT ORGANIZATION_ID) FILTER (WHERE CONVERTED) AS converted_orgs,
       CASE WHEN count(DISTINCT ORGANIZATION_ID) > 0
            THEN count(DISTINCT ORGANIZATION_ID) FILTER (WHERE CONVERTED) / count(DISTINCT ORGANIZATION_ID) * 100.0 END AS conversion_rate_pct
FROM trial_log"""))
register("conversion_class_sizes", feature_sql(
    "SELECT converted, count(*) AS orgs, count(*) / (SELECT count(*) FROM org) * 100.0 AS share_pct FROM org GROUP BY converted"))


# ------------------------------------------------------------------ tests
def _ct_cte(f: str) -> str:
    return f"""ct_{f} AS (
  SELECT {f} AS value, count(*) FILTER (WHERE converted = true) AS converted, count(*) FILTER (WHERE converted = false) AS non_converted
  FROM org WHERE converted IS NOT NULL GROUP BY {f})"""


def _chi2_full(f: str) -> str:
    return f"""
SELECT '{f}' AS feature, round(CASE WHEN dof > 0 THEN s ELSE 0.0 END, 9) AS chi2_statistic, dof AS degrees_of_freedom,
       n AS n_orgs, dof = 1 AS yates_correction
FROM (
  SELECT tot.dof, CAST(tot.r1 + tot.r0 AS BIGINT) AS n,
         sum(CASE WHEN tot.r1 > 0 THEN pow(abs(ct.converted - tot.r1 * (ct.converted + ct.non_converted) / (tot.r1 + tot.r0))
                 - CASE WHEN tot.dof = 1 THEN LEAST(0.5, abs(ct.converted - tot.r1 * (ct.converted + ct.non_converted) / (tot.r1 + tot.r0))) ELSE 0 END, 2)
                 / (tot.r1 * (ct.converted + ct.non_converted) / (tot.r1 + tot.r0)) ELSE 0.0 END
           + CASE WHEN tot.r0 > 0 THEN pow(abs(ct.non_converted - tot.r0 * (ct.converted + ct.non_converted) / (tot.r1 + tot.r0))
                 - CASE WHEN tot.dof = 1 THEN LEAST(0.5, abs(ct.non_converted - tot.r0 * (ct.converted + ct.non_converted) / (tot.r1 + tot.r0))) ELSE 0 END, 2)
                 / (tot.r0 * (ct.converted + ct.non_converted) / (tot.r1 + tot.r0)) ELSE 0.0 END) AS s
  FROM ct_{f} ct CROSS JOIN (
    SELECT r1, r0, CAST(((CASE WHEN r1 > 0 THEN 1 ELSE 0 END + CASE WHEN r0 > 0 THEN 1 ELSE 0 END) - 1) * (c - 1) AS BIGINT) AS dof
    FROM (SELECT sum(converted) AS r1, sum(non_converted) AS r0, count(*) AS c FROM ct_{f})) tot
  GROUP BY tot.dof, tot.r1, tot.r0)"""


register("chi_square_test", feature_sql(
    _chi2_full("week1_engagement_binary") + " UNION ALL " + _chi2_full("front_loaded_pattern"),
    _ct_cte("week1_engagement_binary"), _ct_cte("front_loaded_pattern")))
register("contingency_table", feature_sql("""
SELECT front_loaded_pattern AS value, count(*) FILTER (WHERE converted = true) AS converted,
       count(*) FILTER (WHERE converted = false) AS non_converted
FROM org WHERE converted IS NOT NULL GROUP BY front_loaded_pattern"""))
register("t_test", feature_sql("""
SELECT 'week1_activity_ratio' AS feature,
       round(CASE WHEN dof > 0 AND se > 0 THEN (m1 - m2) / se
                  WHEN dof > 0 AND se = 0 AND m1 > m2 THEN CAST('inf' AS DOUBLE)
                  WHEN dof > 0 AND se = 0 AND m1 < m2 THEN CAST('-inf' AS DOUBLE) END, 9) AS t_statistic, CAST(dof AS BIGINT) AS degrees_of_freedom,
       round(m1, 9) AS converted_mean, round(m2, 9) AS non_converted_mean, n1 AS n_converted, n2 AS n_non_converted
FROM (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1.0 / n1 + 1.0 / n2)) AS se
      FROM (SELECT count(week1_activity_ratio) FILTER (WHERE converted = true) AS n1,
                   count(week1_activity_ratio) FILTER (WHERE converted = false) AS n2,
                   avg(week1_activity_ratio) FILTER (WHERE converted = true) AS m1,
                   avg(week1_activity_ratio) FILTER (WHERE converted = false) AS m2,
                   var_samp(week1_activity_ratio) FILTER (WHERE converted = true) AS v1,
                   var_samp(week1_activity_ratio) FILTER (WHERE converted = false) AS v2,
                   count(week1_activity_ratio) FILTER (WHERE converted = true) + count(week1_activity_ratio) FILTER (WHERE converted = false) - 2 AS dof
            FROM org))"""))


def _mwu_sql(f: str) -> str:
    return f"""
SELECT '{f}' AS feature, round(r1 - n1 * (n1 + 1) / 2.0, 9) AS u_statistic, n1 AS n_converted, n2 AS n_non_converted,
       round(r1, 9) AS rank_sum_converted, CAST(tie AS DOUBLE) AS tie_term,
       round(CASE WHEN var > 0 THEN (GREATEST(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) - n1 * n2 / 2.0 - 0.5) / sqrt(var) END, 9) AS z_statistic,
       max_tie <= 1 AND LEAST(n1, n2) <= 8 AS exact,
       round(cm, 9) AS converted_median, round(nm, 9) AS non_converted_median
FROM (
  SELECT *, n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))) AS var
  FROM (
    SELECT sum(t1 * (before + (t + 1) / 2.0)) AS r1, CAST(sum(t1) AS BIGINT) AS n1, CAST(sum(t2) AS BIGINT) AS n2,
           sum(t * t * t - t) AS tie, max(t) AS max_tie
    FROM (SELECT *, COALESCE(sum(t) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT CAST({f} AS DOUBLE) AS value, count(*) FILTER (WHERE converted = true) AS t1,
                       count(*) FILTER (WHERE converted = false) AS t2, count(*) AS t
                FROM org WHERE converted IS NOT NULL AND {f} IS NOT NULL GROUP BY 1))) a,
  (SELECT quantile_cont(CAST({f} AS DOUBLE), 0.5) FILTER (WHERE converted = true) AS cm,
          quantile_cont(CAST({f} AS DOUBLE), 0.5) FILTER (WHERE converted = false) AS nm
   FROM org WHERE converted IS NOT NULL AND {f} IS NOT NULL) m)"""


register("mann_whitney_total", feature_sql(_mwu_sql("total_activities_count")))
register("mann_whitney_categories", feature_sql(_mwu_sql("unique_categories_count")))


# ------------------------------------------------------------------ models
register("model_split", feature_sql("""
SELECT p.ORGANIZATION_ID, p.label, p.pos < a.n_test AS is_test,
       CAST(CASE WHEN p.pos < a.n_test THEN -1 ELSE (p.pos - a.n_test) % 5 END AS INTEGER) AS fold
FROM (SELECT ORGANIZATION_ID, label,
             row_number() OVER (PARTITION BY label ORDER BY md5(CAST(ORGANIZATION_ID AS VARCHAR) || ':42'), ORGANIZATION_ID) - 1 AS pos
      FROM (SELECT ORGANIZATION_ID, CAST(converted AS INTEGER) AS label FROM org)) p
JOIN (
  SELECT label, CAST(n_class - (fl + CASE WHEN rk <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS n_test
  FROM (SELECT *, floor(cont) AS fl, row_number() OVER (ORDER BY cont - floor(cont) DESC, label) AS rk
        FROM (SELECT label, n_class, n_class / sum(n_class) OVER () * (sum(n_class) OVER () - ceil(sum(n_class) OVER () * 0.2)) AS cont,
                     sum(n_class) OVER () - ceil(sum(n_class) OVER () * 0.2) AS n_train
              FROM (SELECT CAST(converted AS INTEGER) AS label, count(*) AS n_class FROM org GROUP BY 1)))) a
USING (label)"""))


# ------------------------------------------- plan-document extensions (2.16)
STAGE_CTE = """
per_act AS (
  SELECT ORGANIZATION_ID, ACTIVITY_NAME,
         count(*) FILTER (WHERE days_since_trial_start BETWEEN 0 AND 13) AS e,
         count(*) FILTER (WHERE days_since_trial_start BETWEEN 14 AND 27) AS l,
         arg_min(CONVERTED, EVENT_ID) AS c, min(EVENT_ID) AS o
  FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ALL),
stage AS (
  SELECT ORGANIZATION_ID, CAST(sum(e) AS BIGINT) AS early_stage_count, CAST(sum(l) AS BIGINT) AS late_stage_count,
         count(*) FILTER (WHERE e > 0 AND l > 0) AS activities_both_stages, arg_min(c, o) AS converted
  FROM per_act GROUP BY ORGANIZATION_ID)
"""
register("stage_features", feature_sql("""
SELECT ORGANIZATION_ID, early_stage_count, late_stage_count,
       round(CASE WHEN early_stage_count + late_stage_count > 0 THEN early_stage_count / (early_stage_count + late_stage_count) END, 9) AS early_stage_share,
       round(CASE WHEN late_stage_count > 0 THEN early_stage_count / late_stage_count END, 9) AS early_late_ratio,
       COALESCE(CASE WHEN early_stage_count + late_stage_count > 0 THEN early_stage_count / (early_stage_count + late_stage_count) END > 0.6, false) AS early_dominated,
       COALESCE(CASE WHEN early_stage_count + late_stage_count > 0 THEN early_stage_count / (early_stage_count + late_stage_count) END BETWEEN 0.3 AND 0.7, false) AS balanced,
       early_stage_count >= 1 AS early_engaged, late_stage_count >= 1 AS late_engaged,
       activities_both_stages, late_stage_count - early_stage_count AS stage_change, converted
FROM stage""", STAGE_CTE))
register("activity_adoption", feature_sql("""
SELECT p.ORGANIZATION_ID, p.ACTIVITY_NAME, p.intensity, p.e > 0 AS early_adopted, p.l > 0 AS late_adopted,
       p.e > 0 AND p.l > 0 AS both_stages, p.intensity > q.activity_p75 AS heavy_user, q.activity_p75
FROM (SELECT ORGANIZATION_ID, ACTIVITY_NAME, count(*) AS intensity,
             count(*) FILTER (WHERE days_since_trial_start BETWEEN 0 AND 13) AS e,
             count(*) FILTER (WHERE days_since_trial_start BETWEEN 14 AND 27) AS l
      FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ALL) p
JOIN (SELECT ACTIVITY_NAME, quantile_cont(CAST(intensity AS DOUBLE), 0.75) AS activity_p75
      FROM (SELECT ORGANIZATION_ID, ACTIVITY_NAME, count(*) AS intensity FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ALL)
      GROUP BY ACTIVITY_NAME) q USING (ACTIVITY_NAME)"""))
FACTS_CTE = """
facts AS (
  SELECT ORGANIZATION_ID, arg_min(TRIAL_START, EVENT_ID) AS trial_start, arg_min(CONVERTED_AT, EVENT_ID) AS converted_at,
         bool_or(COALESCE(CONVERTED, false)) AS converted
  FROM trial_log WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ORGANIZATION_ID)
"""
for unit in ("week", "month"):
    register(f"cohort_conversion_{unit}", with_ctes(FIXTURE_CTE, FACTS_CTE, body=f"""
SELECT CAST(date_trunc('{unit}', trial_start) AS DATE) AS cohort_start, count(*) AS orgs,
       count(*) FILTER (WHERE converted) AS converted_orgs,
       count(*) FILTER (WHERE converted) / count(*) * 100.0 AS conversion_rate_pct
FROM facts GROUP BY 1"""))
register("time_to_conversion", with_ctes(FIXTURE_CTE, FACTS_CTE, body=f"""
SELECT {days('trial_start', 'converted_at')} AS days_to_conversion, count(*) AS orgs
FROM facts WHERE converted_at IS NOT NULL GROUP BY 1"""))
register("activity_penetration", with_ctes(FIXTURE_CTE, SEG_CTE, body="""
, tagged AS (
  SELECT 'not_converted' AS segment, ORGANIZATION_ID, ACTIVITY_NAME FROM seg WHERE s1 AND ORGANIZATION_ID IS NOT NULL
  UNION ALL SELECT 'pre_conversion', ORGANIZATION_ID, ACTIVITY_NAME FROM seg WHERE s2 AND ORGANIZATION_ID IS NOT NULL
  UNION ALL SELECT 'all_converted', ORGANIZATION_ID, ACTIVITY_NAME FROM seg WHERE s3 AND ORGANIZATION_ID IS NOT NULL),
seg_orgs AS (SELECT segment, count(DISTINCT ORGANIZATION_ID) AS segment_orgs FROM tagged GROUP BY segment)
SELECT t.segment, t.ACTIVITY_NAME, count(DISTINCT t.ORGANIZATION_ID) AS orgs_using, count(*) AS records, s.segment_orgs,
       round(count(DISTINCT t.ORGANIZATION_ID) / s.segment_orgs * 100.0, 9) AS penetration_pct,
       round(count(*) / count(DISTINCT t.ORGANIZATION_ID), 9) AS intensity
FROM tagged t JOIN seg_orgs s USING (segment) GROUP BY t.segment, t.ACTIVITY_NAME, s.segment_orgs"""))
register("weekly_activity_by_conversion", feature_sql("""
SELECT converted, count(*) AS orgs, round(avg(activities_week1), 9) AS mean_activities_week1,
       round(avg(activities_week2), 9) AS mean_activities_week2, round(avg(activities_week3), 9) AS mean_activities_week3,
       round(avg(activities_week4_plus), 9) AS mean_activities_week4_plus
FROM org GROUP BY converted"""))
register("activity_transitions", fixture_sql("""
, pos AS (
  SELECT ORGANIZATION_ID, ACTIVITY_NAME, row_number() OVER (PARTITION BY ORGANIZATION_ID ORDER BY "TIMESTAMP", EVENT_ID) - 1 AS p
  FROM trial_log WHERE CONVERTED = true AND "TIMESTAMP" < CONVERTED_AT AND ORGANIZATION_ID IS NOT NULL)
SELECT a.ACTIVITY_NAME, b.ACTIVITY_NAME AS next_activity, count(*) AS transitions
FROM pos a JOIN pos b ON a.ORGANIZATION_ID = b.ORGANIZATION_ID AND b.p = a.p + 1
GROUP BY a.ACTIVITY_NAME, b.ACTIVITY_NAME"""))
SEG_FEAT = """
segfeat AS (
  SELECT 'not_converted' AS segment, * FROM feat WHERE COALESCE(CONVERTED = false, false)
  UNION ALL SELECT 'pre_conversion', * FROM feat WHERE COALESCE(CONVERTED = true AND "TIMESTAMP" < CONVERTED_AT, false)
  UNION ALL SELECT 'all_converted', * FROM feat WHERE COALESCE(CONVERTED = true, false))
"""
register("segment_temporal_counts", feature_sql("""
SELECT segment, 'days_since_trial_start' AS dimension, days_since_trial_start AS value, count(*) AS records FROM segfeat GROUP BY 1, 2, 3
UNION ALL SELECT segment, 'hour', hour, count(*) FROM segfeat GROUP BY 1, 2, 3
UNION ALL SELECT segment, 'day_of_week', day_of_week, count(*) FROM segfeat GROUP BY 1, 2, 3""", SEG_FEAT))
register("segment_org_profiles", feature_sql("""
SELECT segment, ORGANIZATION_ID, count(*) AS total_activities, count(DISTINCT ACTIVITY_NAME) AS unique_activities,
       count(DISTINCT activity_category) AS unique_categories,
       round(date_diff('microsecond', arg_min(TRIAL_START, EVENT_ID), min("TIMESTAMP")) / 1000000.0 / 3600.0, 9) AS time_to_first_activity
FROM segfeat GROUP BY segment, ORGANIZATION_ID""", SEG_FEAT))
_W = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _chi2_tail(x: str, k: str) -> str:
    """P(chi-square with k degrees > x) by Simpson's rule (2000 steps) over u = sqrt(x), at most 40."""
    u = f"LEAST(sqrt({x}), 40)"
    part = f"(SELECT sum({_W} * pow({u} * i / 2000, {k} - 1) * exp(-pow({u} * i / 2000, 2) / 2)) FROM generate_series(0, 2000) s(i))"
    return f"GREATEST(0.0, 1 - {part} * {u} / 6000 * pow(2, 1 - {k} / 2.0) / exp(lgamma({k} / 2.0)))"


def _t_tail(t: str, nu: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule up to |t|, at most 60."""
    u = f"LEAST(abs({t}), 60)"
    part = f"(SELECT sum({_W} * pow(1 + pow({u} * i / 2000, 2) / {nu}, -({nu} + 1) / 2.0)) FROM generate_series(0, 2000) s(i))"
    return f"GREATEST(0.0, 1 - 2 * {part} * {u} / 6000 * exp(lgamma(({nu} + 1) / 2.0) - lgamma({nu} / 2.0)) / sqrt({nu} * pi()))"


def _kolmogorov_tail(x: str) -> str:
    return (f"CASE WHEN {x} < 1 THEN 1 - sqrt(2 * pi()) / {x} * (SELECT sum(exp(-pow((2 * i - 1) * pi(), 2) / (8 * pow({x}, 2)))) FROM generate_series(1, 19) s(i)) "
            f"ELSE 2 * (SELECT sum(CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * pow({x}, 2))) FROM generate_series(1, 60) s(i)) END")


def _chi2_of_counts(keys: str, digits: int = 6) -> str:
    """Yates' chi-square of ``per`` (keys, a_c, a_n) against the class sizes ``cls`` (ct, nt)."""
    return f"""
, g AS (
  SELECT per.*, cls.ct, cls.nt, cls.ct + cls.nt AS n, a_c + a_n AS used,
         CAST(((CASE WHEN cls.ct > 0 THEN 1 ELSE 0 END + CASE WHEN cls.nt > 0 THEN 1 ELSE 0 END) - 1)
            * ((CASE WHEN a_c + a_n > 0 THEN 1 ELSE 0 END + CASE WHEN cls.ct + cls.nt - (a_c + a_n) > 0 THEN 1 ELSE 0 END) - 1) AS BIGINT) AS dof
  FROM per, cls),
cells AS (
  SELECT {keys}, a_c, a_n, dof, o, e FROM g,
  LATERAL (VALUES (a_c, ct * used / n), (a_n, nt * used / n), (ct - a_c, ct * (n - used) / n), (nt - a_n, nt * (n - used) / n)) v(o, e))
SELECT {keys}, converted_users, non_converted_users, round(chi2, 9) AS chi2_statistic, degrees_of_freedom,
       round(CASE WHEN degrees_of_freedom > 0 THEN {_chi2_tail("chi2", "degrees_of_freedom")} ELSE 1.0 END, {digits}) AS p_value
FROM (
SELECT {keys}, a_c AS converted_users, a_n AS non_converted_users,
       CASE WHEN dof > 0 THEN sum(CASE WHEN e > 0 THEN pow(abs(o - e) - CASE WHEN dof = 1 THEN LEAST(0.5, abs(o - e)) ELSE 0 END, 2) / e ELSE 0.0 END) ELSE 0.0 END AS chi2,
       dof AS degrees_of_freedom
FROM cells GROUP BY {keys}, a_c, a_n, dof) b"""


register("adoption_chi_square", feature_sql(_chi2_of_counts("ACTIVITY_NAME"), """
orgs AS (SELECT ORGANIZATION_ID, arg_min(CONVERTED, EVENT_ID) AS c FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY 1),
cls AS (SELECT count(*) FILTER (WHERE c = true) AS ct, count(*) FILTER (WHERE c = false) AS nt FROM orgs),
per AS (
  SELECT u.ACTIVITY_NAME, count(*) FILTER (WHERE o.c = true) AS a_c, count(*) FILTER (WHERE o.c = false) AS a_n
  FROM (SELECT DISTINCT ORGANIZATION_ID, ACTIVITY_NAME FROM feat WHERE ORGANIZATION_ID IS NOT NULL) u
  JOIN orgs o USING (ORGANIZATION_ID) GROUP BY 1)"""))
STAGE_TEST_CTE = "stage_rows AS (" + ORACLE["stage_features"][ORACLE["stage_features"].rindex("SELECT ORGANIZATION_ID, early_stage_count"):] + """),
cls AS (SELECT count(*) FILTER (WHERE converted = true) AS ct, count(*) FILTER (WHERE converted = false) AS nt FROM stage_rows)
"""
register("stage_flag_tests", feature_sql(_chi2_of_counts("feature"), STAGE_CTE, STAGE_TEST_CTE, "per AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} AND converted = true) AS a_c, count(*) FILTER (WHERE {f} AND converted = false) AS a_n FROM stage_rows"
    for f in ("early_dominated", "balanced", "early_engaged", "late_engaged")) + ")"))
ADOPTION_TEST_CTES = [
    STAGE_CTE, STAGE_TEST_CTE,
    "adoption AS (" + ORACLE["activity_adoption"][ORACLE["activity_adoption"].index("\nSELECT p.ORGANIZATION_ID, p.ACTIVITY_NAME"):] + ")",
    "shown AS (SELECT a.*, s.early_dominated, s.balanced, s.early_engaged, s.converted FROM adoption a JOIN stage_rows s USING (ORGANIZATION_ID))",
    "per AS (" + " UNION ALL ".join(
        f"SELECT ACTIVITY_NAME, '{name}' AS pattern, count(*) FILTER (WHERE {flag} AND converted = true) AS a_c, "
        f"count(*) FILTER (WHERE {flag} AND converted = false) AS a_n FROM shown GROUP BY 1"
        for name, flag in [(f, f) for f in ("early_adopted", "late_adopted", "both_stages", "heavy_user")]
        + [(f"used_by_{f}", f) for f in ("early_dominated", "balanced", "early_engaged")]) + ")"]
register("stage_adoption_tests", feature_sql(_chi2_of_counts("ACTIVITY_NAME, pattern"), *ADOPTION_TEST_CTES))
# the tail by Simpson's rule leaves some 1e-12 on p-values near 1, so equal ones are taken as such at 12 digits
register("adjusted_adoption_tests", feature_sql(_chi2_of_counts("ACTIVITY_NAME, pattern", 12).replace(", g AS (", """, adjusted AS (
SELECT * REPLACE (round(p_value, 6) AS p_value), round(bonf, 6) AS p_bonferroni, round(fdr, 6) AS p_fdr_bh,
       bonf < 0.05 AS significant_bonferroni, fdr < 0.05 AS significant_fdr FROM (
SELECT *, LEAST(p_value * m, 1.0) AS bonf, LEAST(min(p_value * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS fdr
FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS r FROM (
WITH g AS (""", 1) + ")))) SELECT * EXCLUDE (bonf, fdr, m, r) FROM adjusted", *ADOPTION_TEST_CTES))
EXT_F = ["total_activities_count", "unique_activities_count", "unique_categories_count", "activities_per_day",
         "days_active", "week1_activity_count", "week1_activity_ratio"]


def _long_sql(src: str, features: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT converted, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}" for f in features)


T_TESTS_BODY = """
SELECT feature,
       round(CASE WHEN dof > 0 AND se > 0 THEN (m1 - m2) / se
                  WHEN dof > 0 AND se = 0 AND m1 > m2 THEN CAST('inf' AS DOUBLE)
                  WHEN dof > 0 AND se = 0 AND m1 < m2 THEN CAST('-inf' AS DOUBLE) END, 9) AS t_statistic, CAST(dof AS BIGINT) AS degrees_of_freedom,
       round(CASE WHEN dof > 0 AND sp2 > 0 THEN (m1 - m2) / sqrt(sp2) END, 9) AS cohens_d,
       round(m1, 9) AS converted_mean, round(m2, 9) AS non_converted_mean, n1 AS n_converted, n2 AS n_non_converted
FROM (SELECT *, sqrt(sp2 * (1.0 / n1 + 1.0 / n2)) AS se
      FROM (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / dof AS sp2
            FROM (SELECT feature, count(value) FILTER (WHERE converted = true) AS n1, count(value) FILTER (WHERE converted = false) AS n2,
                         avg(value) FILTER (WHERE converted = true) AS m1, avg(value) FILTER (WHERE converted = false) AS m2,
                         var_samp(value) FILTER (WHERE converted = true) AS v1, var_samp(value) FILTER (WHERE converted = false) AS v2,
                         count(value) FILTER (WHERE converted = true) + count(value) FILTER (WHERE converted = false) - 2 AS dof
                  FROM long GROUP BY feature)))"""
T_TESTS_WITH_P = f"""SELECT *, round(CASE WHEN isinf(t_statistic) THEN 0.0 WHEN t_statistic IS NOT NULL THEN {_t_tail("t_statistic", "degrees_of_freedom")} END, 6) AS p_value
FROM ({T_TESTS_BODY}) b"""
register("feature_t_tests", feature_sql(T_TESTS_WITH_P, "long AS (" + _long_sql("org", EXT_F) + ")"))
VC_CTE = """
vc AS (
  SELECT feature, value, count(*) FILTER (WHERE converted = true) AS t1, count(*) FILTER (WHERE converted = false) AS t2, count(*) AS t
  FROM long WHERE converted IS NOT NULL AND value IS NOT NULL GROUP BY feature, value)
"""
register("feature_mann_whitney", feature_sql("""
SELECT *, round(CASE WHEN z_statistic > 0 THEN """ + _chi2_tail("z_statistic * z_statistic", "1") + """ WHEN u_statistic IS NOT NULL THEN 1.0 END, 6) AS p_value FROM (
SELECT feature, round(r1 - n1 * (n1 + 1) / 2.0, 9) AS u_statistic, n1 AS n_converted, n2 AS n_non_converted,
       CAST(tie AS DOUBLE) AS tie_term,
       round(CASE WHEN var > 0 THEN (GREATEST(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) - n1 * n2 / 2.0 - 0.5) / sqrt(var) END, 9) AS z_statistic
FROM (SELECT *, n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))) AS var
      FROM (SELECT feature, sum(t1 * (before + (t + 1) / 2.0)) AS r1, CAST(sum(t1) AS BIGINT) AS n1, CAST(sum(t2) AS BIGINT) AS n2,
                   sum(t * t * t - t) AS tie
            FROM (SELECT *, COALESCE(sum(t) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vc)
            GROUP BY feature))) b""", "long AS (" + _long_sql("org", EXT_F) + ")", VC_CTE))
register("feature_ks_tests", feature_sql("""
SELECT feature, round(d, 9) AS d_statistic, n_converted, n_non_converted, round(CASE WHEN x <= 0 THEN 1.0 ELSE """ + _kolmogorov_tail("x") + """ END, 6) AS p_value
FROM (SELECT *, d * sqrt(CAST(n_converted AS DOUBLE) * n_non_converted / (n_converted + n_non_converted)) AS x FROM (
SELECT feature, max(abs(c1 / n1 - c2 / n2)) AS d, CAST(max(n1) AS BIGINT) AS n_converted,
       CAST(max(n2) AS BIGINT) AS n_non_converted
FROM (SELECT feature, sum(t1) OVER w AS c1, sum(t2) OVER w AS c2, sum(t1) OVER (PARTITION BY feature) AS n1,
             sum(t2) OVER (PARTITION BY feature) AS n2
      FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
GROUP BY feature)) b""", "long AS (" + _long_sql("org", EXT_F) + ")", VC_CTE))
register("stage_change_anova", feature_sql("""
, g AS (SELECT converted, count(stage_change) AS n, avg(stage_change) AS m, COALESCE(var_samp(stage_change), 0.0) AS v
        FROM (SELECT converted, CAST(late_stage_count - early_stage_count AS DOUBLE) AS stage_change FROM stage)
        WHERE stage_change IS NOT NULL AND converted IS NOT NULL GROUP BY converted),
t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k FROM g),
s AS (SELECT sum(n * pow(m - (SELECT gm FROM t), 2)) AS ssb, sum((n - 1) * v) AS ssw FROM g)
SELECT 'stage_change' AS feature,
       round(CASE WHEN k - 1 > 0 AND nn - k > 0 AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (nn - k)) END, 9) AS f_statistic,
       CAST(k - 1 AS BIGINT) AS df_between, CAST(nn - k AS BIGINT) AS df_within, round(ssb, 9) AS ssb, round(ssw, 9) AS ssw,
       -- of two classes F is the square of t
       round(CASE WHEN k = 2 AND nn > k AND ssw > 0 THEN """ + _t_tail("sqrt(ssb * (nn - k) / ssw)", "(nn - k)") + """ END, 6) AS p_value
FROM s, t""", STAGE_CTE))
register("stage_t_tests", feature_sql(T_TESTS_WITH_P, STAGE_CTE, "long AS (" + _long_sql(
    "stage", ["early_stage_count", "late_stage_count", "activities_both_stages"]) + ")"))
# the twins write the empty cells that the queries only count
register("activity_intensity_tests", feature_sql(T_TESTS_WITH_P, STAGE_CTE, """
long AS (
  SELECT s.converted, a.ACTIVITY_NAME AS feature, CAST(COALESCE(p.n, 0) AS DOUBLE) AS value
  FROM stage s CROSS JOIN (SELECT DISTINCT ACTIVITY_NAME FROM per_act WHERE ACTIVITY_NAME IS NOT NULL) a
  LEFT JOIN (SELECT ORGANIZATION_ID, ACTIVITY_NAME, count(*) AS n FROM feat GROUP BY ALL) p
    ON p.ORGANIZATION_ID = s.ORGANIZATION_ID AND p.ACTIVITY_NAME = a.ACTIVITY_NAME)"""))
register("time_cell_tests", feature_sql(T_TESTS_WITH_P, """
classes AS (SELECT ORGANIZATION_ID, arg_min(CONVERTED, EVENT_ID) AS converted FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY 1),
cells AS (
  SELECT ORGANIZATION_ID, feature, count(*) AS n FROM (
    SELECT ORGANIZATION_ID, unnest(['hour_' || CAST(hour AS INTEGER), 'day_of_week_' || CAST(day_of_week AS INTEGER),
                                    'day_' || CAST(days_since_trial_start AS INTEGER)]) AS feature
    FROM feat WHERE ORGANIZATION_ID IS NOT NULL) WHERE feature IS NOT NULL GROUP BY ALL),
long AS (
  SELECT converted, feature, CAST(COALESCE(n, 0) AS DOUBLE) AS value
  FROM classes CROSS JOIN (SELECT DISTINCT feature FROM cells) LEFT JOIN cells USING (ORGANIZATION_ID, feature))"""))
register("feature_auc", feature_sql("""
SELECT feature, round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2), 9) AS auc, n1 AS n_converted, n2 AS n_non_converted
FROM (SELECT feature, sum(t1 * (before + (t + 1) / 2.0)) AS r1, CAST(sum(t1) AS BIGINT) AS n1, CAST(sum(t2) AS BIGINT) AS n2
      FROM (SELECT *, COALESCE(sum(t) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vc)
      GROUP BY feature)""", "long AS (" + _long_sql("org", EXT_F) + ")", VC_CTE))
MODEL_F = ["total_activities_count", "unique_activities_count", "unique_categories_count", "activities_per_day", "days_active",
           "week1_activity_count", "week1_activity_ratio", "front_loaded_pattern", "week1_engagement_binary"]
register("model_inputs", feature_sql(
    "SELECT s.ORGANIZATION_ID, s.label, s.is_test, s.fold, " + ", ".join(
        f"round(CASE WHEN stddev_pop(COALESCE(o.{f}, 0)) FILTER (WHERE NOT s.is_test) OVER () > 0 THEN (COALESCE(o.{f}, 0) - avg(COALESCE(o.{f}, 0)) FILTER (WHERE NOT s.is_test) OVER ())"
        f" / stddev_pop(COALESCE(o.{f}, 0)) FILTER (WHERE NOT s.is_test) OVER () ELSE 0.0 END, 9) AS {f}" for f in MODEL_F)
    + " FROM split s JOIN org o ON s.ORGANIZATION_ID = o.ORGANIZATION_ID",
    "split AS (" + ORACLE["model_split"][ORACLE["model_split"].index("\nSELECT p.ORGANIZATION_ID"):] + ")"))
# Newton's steps on the penalized likelihood; the 3 x 3 system by Cramer's rule
register("logistic_coefficients", """
WITH RECURSIVE train AS MATERIALIZED (
  SELECT CAST(label AS DOUBLE) AS y, total_activities_count AS u, week1_activity_ratio AS v FROM (""" + ORACLE["model_inputs"] + """) WHERE NOT is_test),
fit(k, a, b, c) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1,
    a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
    SELECT k, a, b, c, sum(y - p) AS g0, sum((y - p) * u) - b AS g1, sum((y - p) * v) - c AS g2,
           sum(p * (1 - p)) AS h00, sum(p * (1 - p) * u) AS h01, sum(p * (1 - p) * v) AS h02,
           sum(p * (1 - p) * u * u) + 1 AS h11, sum(p * (1 - p) * u * v) AS h12, sum(p * (1 - p) * v * v) + 1 AS h22
    FROM (SELECT *, 1 / (1 + exp(-(a + b * u + c * v))) AS p FROM fit, train WHERE k < 20) GROUP BY k, a, b, c)))
SELECT t.term, round(t.coefficient, 6) AS coefficient, round(exp(t.coefficient), 6) AS odds_ratio FROM (
  SELECT unnest([{'term': 'intercept', 'coefficient': a}, {'term': 'total_activities_count', 'coefficient': b},
                 {'term': 'week1_activity_ratio', 'coefficient': c}]) AS t FROM fit WHERE k = 20)""")
TIME_F = ["weekend_share", "mean_hour", "active_dates"]
register("time_profile_tests", feature_sql(T_TESTS_WITH_P, """
prof AS (
  SELECT ORGANIZATION_ID, avg(is_weekend) AS weekend_share, avg(hour) AS mean_hour,
         count(DISTINCT CAST("TIMESTAMP" AS DATE)) AS active_dates, arg_min(CONVERTED, EVENT_ID) AS converted
  FROM feat WHERE ORGANIZATION_ID IS NOT NULL GROUP BY ORGANIZATION_ID)""", "long AS (" + _long_sql("prof", TIME_F) + ")"))


# ------------------------------------------------------------------ sinks
register("mart_exports", mart_sql("""
SELECT 'staging_metrics_per_org' AS table_name, (SELECT count(*) FROM staging) AS records, CAST(9 AS INTEGER) AS columns,
       CAST(NULL AS VARCHAR) AS error
UNION ALL SELECT 'staging_activation_goals', (SELECT count(*) FROM goals), 4, NULL
UNION ALL SELECT 'mart_trial_goals', (SELECT count(*) FROM mart_goals), 13, NULL
UNION ALL SELECT 'mart_trial_activation', (SELECT count(*) FROM mart_activation), 14, NULL"""))


# ------------------------------------------------------------- exploratory program
CLEANED_CTE = """
text_dup AS (
  SELECT CAST(ORGANIZATION_ID AS VARCHAR) AS ORGANIZATION_ID, ACTIVITY_NAME,
         CASE WHEN EVENT_ID % 97 = 0 THEN 'garbage' ELSE CAST("TIMESTAMP" AS VARCHAR) END AS "TIMESTAMP",
         CAST(CONVERTED AS VARCHAR) AS CONVERTED, CAST(CONVERTED_AT AS VARCHAR) AS CONVERTED_AT,
         CAST(TRIAL_START AS VARCHAR) AS TRIAL_START, CAST(TRIAL_END AS VARCHAR) AS TRIAL_END, EVENT_ID
  FROM dup_log),
first_copy AS (
  SELECT * FROM text_dup QUALIFY row_number() OVER (PARTITION BY ORGANIZATION_ID, ACTIVITY_NAME, "TIMESTAMP" ORDER BY EVENT_ID) = 1),
typed2 AS (
  SELECT ORGANIZATION_ID, ACTIVITY_NAME, TRY_CAST("TIMESTAMP" AS TIMESTAMP) AS "TIMESTAMP", TRY_CAST(CONVERTED AS BOOLEAN) AS CONVERTED,
         TRY_CAST(CONVERTED_AT AS TIMESTAMP) AS CONVERTED_AT, TRY_CAST(TRIAL_START AS TIMESTAMP) AS TRIAL_START,
         TRY_CAST(TRIAL_END AS TIMESTAMP) AS TRIAL_END, CAST(EVENT_ID AS BIGINT) AS EVENT_ID
  FROM first_copy),
sizes AS (SELECT ORGANIZATION_ID, count(*) AS n FROM typed2 WHERE ORGANIZATION_ID IS NOT NULL GROUP BY 1),
cap AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.95) AS p FROM sizes),
cleaned AS (
  SELECT * FROM typed2 WHERE ORGANIZATION_ID IN (SELECT ORGANIZATION_ID FROM sizes WHERE n >= 3 AND n <= (SELECT p FROM cap)))
"""
register("exploratory_clean_log", with_ctes(FIXTURE_CTE, DUP_CTE, CLEANED_CTE, body="SELECT * FROM cleaned"))
register("exploratory_log_file", ORACLE["exploratory_clean_log"])


def on_cleaned_log(name: str) -> str:
    """The twin of ``name`` with the program's cleaned log in the fixture's place."""
    raw = with_ctes(FIXTURE_CTE, DUP_CTE, CLEANED_CTE, body="").removeprefix("WITH ").strip().replace("trial_log", "raw_log")
    rest = ORACLE[name].removeprefix("WITH " + FIXTURE_CTE.strip())
    return f"WITH {raw},\ntrial_log AS (SELECT * FROM cleaned){rest}"


for _name in ("org_features", "segment_sizes", "activity_comparison", "feature_comparison"):
    register(f"exploratory_{_name}", on_cleaned_log(_name))


# ------------------------------------------------------------------ p-values
# Tail probabilities by Simpson's rule on 2000 steps from 0 to the statistic:
# chi-square with x = u**2 (so the density has no pole at 0), Student's t, and
# the normal tail of the U test as a chi-square of one degree of freedom.
def _p_ctes(extra_t: list[str]) -> list[str]:
    mwu = " UNION ALL ".join(
        f"SELECT '{i}' AS test_id, 'Mann-Whitney U test' AS test, 'mwu' AS kind, feature, u_statistic AS statistic, "
        f"CAST(NULL AS DOUBLE) AS dof, z_statistic AS z FROM ({_mwu_sql(f)})"
        for i, f in (("total_activities_mannwhitney", "total_activities_count"), ("categories_mannwhitney", "unique_categories_count")))
    ids = " UNION ALL ".join([f"SELECT 'week1_ratio_ttest' AS test_id, 'week1_activity_ratio' AS feature"]
                             + [f"SELECT '{f}_ttest', '{f}'" for f in extra_t])
    base = f"""base AS (
  SELECT 'week1_engagement_chi2' AS test_id, 'Chi-square test' AS test, 'chi2' AS kind, feature, chi2_statistic AS statistic,
         CAST(degrees_of_freedom AS DOUBLE) AS dof, CAST(NULL AS DOUBLE) AS z FROM ({_chi2_full("week1_engagement_binary")})
  UNION ALL SELECT test_id, 'Independent t-test', 't', feature, t_statistic, CAST(degrees_of_freedom AS DOUBLE), NULL
  FROM ({T_TESTS_BODY}) JOIN ({ids}) USING (feature)
  UNION ALL {mwu})"""
    tails = """p AS (
  SELECT test_id, test, feature, statistic, dof,
         CASE WHEN statistic IS NULL THEN NULL WHEN kind = 'chi2' AND dof <= 0 THEN 1.0 WHEN kind = 't' THEN GREATEST(0.0, 1 - 2 * part) ELSE GREATEST(0.0, 1 - part) END AS p_value
  FROM (
    SELECT test_id, test, kind, feature, statistic, dof, sum(w * density) * max(top) / 6000 AS part
    FROM (
      SELECT *, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w,
             CASE WHEN kind = 't' THEN exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * pow(1 + u * u / dof, -(dof + 1) / 2)
                  ELSE pow(u, k - 1) * exp(-u * u / 2) * pow(2, 1 - k / 2) / exp(lgamma(k / 2)) END AS density
      FROM (SELECT *, top * i / 2000 AS u
            FROM (SELECT *, CASE kind WHEN 'chi2' THEN LEAST(sqrt(statistic), 40) WHEN 't' THEN LEAST(abs(statistic), 60) ELSE LEAST(GREATEST(z, 0.0), 40) END AS top,
                         CASE kind WHEN 'chi2' THEN GREATEST(dof, 1.0) ELSE 1.0 END AS k FROM base), generate_series(0, 2000) s(i)))
    GROUP BY test_id, test, kind, feature, statistic, dof))"""
    features = ["week1_activity_ratio"] + [f for f in extra_t if f != "week1_activity_ratio"]
    return [_ct_cte("week1_engagement_binary"), "long AS (" + _long_sql("org", features) + ")", base, tails]


register("hypothesis_tests", feature_sql("""
SELECT test_id, test, feature, round(statistic, 9) AS statistic, dof AS degrees_of_freedom, round(p_value, 6) AS p_value,
       p_value < 0.05 AS significant FROM p""", *_p_ctes([])))
register("tests_summary", feature_sql(
    "SELECT count(*) AS tests_performed, count(*) FILTER (WHERE p_value < 0.05) AS significant_tests FROM p", *_p_ctes([])))
register("exploratory_hypothesis_tests", on_cleaned_log("hypothesis_tests"))
register("adjusted_tests", feature_sql("""
SELECT test_id, test, feature, round(statistic, 9) AS statistic, dof AS degrees_of_freedom, round(p_value, 6) AS p_value,
       p_value < 0.05 AS significant, round(bonf, 6) AS p_bonferroni, round(fdr, 6) AS p_fdr_bh,
       bonf < 0.05 AS significant_bonferroni, fdr < 0.05 AS significant_fdr
FROM (SELECT *, CASE WHEN p_value IS NOT NULL THEN LEAST(p_value * m, 1.0) END AS bonf,
             CASE WHEN p_value IS NOT NULL THEN LEAST(min(p_value * m / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) END AS fdr
      FROM (SELECT *, count(p_value) OVER () AS m, row_number() OVER (ORDER BY p_value NULLS LAST) AS r FROM p))""", *_p_ctes(EXT_F)))

# ------------------------------------------------------------------ file order
register("log_from_files", fixture_sql("""
SELECT ORGANIZATION_ID, count(*) AS records, arg_min(ACTIVITY_NAME, EVENT_ID) AS first_activity, arg_max(ACTIVITY_NAME, EVENT_ID) AS last_activity
FROM trial_log GROUP BY ORGANIZATION_ID"""))
