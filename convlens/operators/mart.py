"""Trial-activation data mart: staging metrics, goal thresholds, goal
progress for open trials, activated trials, and the mart's stats and checks.

Scale notes
-----------
* ``staging_metrics`` is ONE ``groupBy(org)`` with conditional counts: the
  week pivot, the total and the per-org facts need no joins.  Partial
  aggregation runs map-side, so a hot organization does not skew the shuffle.
* Goal thresholds are scalar subqueries (``DataFrame.scalar()``): Spark runs
  the one-row aggregate once and injects the value; the org table is never
  joined or crossed with anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.expr import completion_pct, floor_days, python_round, rows_of, trial_week

# Goal ids, names, constants and description texts of the mart.
WEEK1_GOAL = "WEEK1_MIN_ACTIVITY"
MINIMAL_EVENTS_GOAL = "MINIMAL_EVENTS_THRESHOLD"
STEADINESS_GOAL = "WEEK4_STEADINESS_RATIO"
WEEK1_PERCENTILE = 0.75
WEEK1_FALLBACK = 10.0
MINIMAL_EVENTS = 3.0
STEADINESS_RATIO = 0.8
WEEK1_METRIC_NAME = "Week 1 Minimum Activities"
MINIMAL_EVENTS_METRIC_NAME = "Minimal Events (Modeling Basis)"
STEADINESS_METRIC_NAME = "Week 4 Steadiness Ratio"
WEEK1_DESCRIPTION = "Minimum activities required in first week (75th percentile of converted orgs: {})"
MINIMAL_EVENTS_DESCRIPTION = "Minimal total events required as basis for modeling (fixed threshold: {})"
STEADINESS_DESCRIPTION = "Week 4 activities must be ≥80% of Week 1 activities (fixed business rule)"


def prepare_log(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Add the mart's day and week columns: days since the trial start
    (floored; null -> 0) and the trial week clipped to 1..4 (null -> 1).
    The clip happens before the null fill, so a null time lands in week 1."""
    days = floor_days(cols.trial_start, cols.ts)
    return log.withColumn("trial_week", F.coalesce(trial_week(days, lower=1), F.lit(1))).withColumn(
        "days_since_trial_start", F.coalesce(days, F.lit(0))
    )


def trial_week_distribution(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("trial_week").agg(F.count(F.lit(1)).alias("records"))


def _first(col: str, cols: LogColumns) -> F.Column:
    """First non-null value of ``col`` in input order (pandas ``'first'``)."""
    c = F.col(col)
    if cols.order:
        return F.min_by(c, F.when(c.isNotNull(), F.col(cols.order)))
    return F.max(c)


def staging_metrics(prepared: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``staging_metrics_per_org``: activities per trial week (1..4) and in
    total, conversion flag and trial dates, one row per organization."""
    wk = F.col("trial_week")
    grouped = prepared.filter(F.col(cols.org).isNotNull()).groupBy(cols.org).agg(
        *[F.count_if(wk == w).alias(f"week{w}_activities") for w in (1, 2, 3, 4)],
        F.count(F.lit(1)).alias("total_activities"),
        _first(cols.converted, cols).alias("_converted"),
        _first(cols.trial_start, cols).alias("_start"),
        _first(cols.trial_end, cols).alias("_end"),
    )
    return grouped.select(
        F.col(cols.org).alias("org_id"),
        "week1_activities", "week2_activities", "week3_activities", "week4_activities", "total_activities",
        F.coalesce(F.col("_converted").cast("boolean"), F.lit(False)).alias("converted"),
        F.to_date("_start").alias("trial_start_date"),
        F.to_date("_end").alias("trial_end_date"),
    )


def activation_goals(staging: DataFrame) -> DataFrame:
    """``staging_activation_goals``: three goals, the first derived from the
    data.  Built from a one-row aggregate of the staging table."""
    thr = staging.filter(F.col("converted")).agg(
        F.coalesce(F.percentile(F.col("week1_activities").cast("double"), WEEK1_PERCENTILE), F.lit(WEEK1_FALLBACK)).alias("w1")
    )
    rows = rows_of(["goal_id", "metric_name", "threshold_value", "description"], [
        [WEEK1_GOAL, WEEK1_METRIC_NAME, F.col("w1"),
         F.format_string(WEEK1_DESCRIPTION.replace("{}", "%.1f"), python_round("w1", 1))],
        [MINIMAL_EVENTS_GOAL, MINIMAL_EVENTS_METRIC_NAME, F.lit(MINIMAL_EVENTS),
         MINIMAL_EVENTS_DESCRIPTION.format(f"{MINIMAL_EVENTS:.0f}")],
        [STEADINESS_GOAL, STEADINESS_METRIC_NAME, F.lit(STEADINESS_RATIO), STEADINESS_DESCRIPTION],
    ])
    return thr.select(rows)


def goal_thresholds(goals: DataFrame) -> F.Column:
    """The three thresholds as ONE struct-valued scalar subquery (one job)."""
    def pick(goal_id):
        return F.max(F.when(F.col("goal_id") == goal_id, F.col("threshold_value")))
    return goals.agg(F.struct(pick(WEEK1_GOAL).alias("w1"), pick(MINIMAL_EVENTS_GOAL).alias("me"),
                              pick(STEADINESS_GOAL).alias("ratio"))).scalar()


def trial_goals(staging: DataFrame, goals: DataFrame) -> DataFrame:
    """``mart_trial_goals``: open trials (not converted) with completion % per
    goal, the week-4 target and the all-goals flag."""
    thr = goal_thresholds(goals)
    g1, g2, g3 = thr.getField("w1"), thr.getField("me"), thr.getField("ratio")
    target = F.col("week1_activities") * g3
    out = staging.filter(~F.col("converted")).select(
        "org_id", "week1_activities", "week2_activities", "week4_activities", "total_activities", "converted",
        "trial_start_date", "trial_end_date",
        completion_pct("week1_activities", g1).alias("week1_completion_pct"),
        completion_pct("total_activities", g2).alias("minimal_events_completion_pct"),
        target.alias("week4_target_activities"),
        completion_pct("week4_activities", target).alias("week4_completion_pct"),
    )
    achieved = (
        (F.col("week1_completion_pct") >= 100)
        & (F.col("minimal_events_completion_pct") >= 100)
        & (F.col("week4_completion_pct") >= 100)
    )
    return out.withColumn("overall_achieved", F.when(achieved, F.lit(1)).otherwise(F.lit(0)))


def trial_activation(goals_mart: DataFrame) -> DataFrame:
    """``mart_trial_activation``: activated trials with the mean of the three
    completion percentages rounded to 2 places."""
    score = F.round(
        (F.col("week1_completion_pct") + F.col("minimal_events_completion_pct") + F.col("week4_completion_pct")) / 3.0, 2
    )
    return goals_mart.filter(F.col("overall_achieved") == 1).withColumn("avg_performance_score", score)


SAMPLE_COLUMNS = ["org_id", "week1_activities", "total_activities", "week4_activities", "week1_completion_pct",
                  "minimal_events_completion_pct", "week4_completion_pct", "overall_achieved"]


def mart_sample(goals_mart: DataFrame, n: int = 5) -> DataFrame:
    """The checks' sample: the first ``n`` open trials by org id."""
    return goals_mart.select(*SAMPLE_COLUMNS).orderBy("org_id").limit(n)


# ---------------------------------------------------------------- statistics

def goal_stats(goals_mart: DataFrame) -> DataFrame:
    """Activated / open trials and mean completion per goal (1 place)."""
    return goals_mart.agg(
        F.coalesce(F.sum("overall_achieved"), F.lit(0)).cast("long").alias("activated_orgs"),
        F.count(F.lit(1)).alias("total_orgs"),
        F.round(F.avg("week1_completion_pct"), 1).alias("avg_week1_completion"),
        F.round(F.avg("minimal_events_completion_pct"), 1).alias("avg_minimal_events_completion"),
        F.round(F.avg("week4_completion_pct"), 1).alias("avg_week4_completion"),
    ).withColumn(
        "activation_rate_open_pct",
        F.when(F.col("total_orgs") > 0, F.col("activated_orgs") / F.col("total_orgs") * 100.0),
    )


def completion_stats(goals_mart: DataFrame) -> DataFrame:
    return goals_mart.agg(
        F.round(F.avg("week1_completion_pct"), 1).alias("avg_week1"),
        F.round(F.avg("minimal_events_completion_pct"), 1).alias("avg_minimal_events"),
        F.round(F.avg("week4_completion_pct"), 1).alias("avg_week4"),
        F.count_if(F.col("week1_completion_pct") >= 100).alias("week1_achieved"),
        F.count_if(F.col("minimal_events_completion_pct") >= 100).alias("minimal_events_achieved"),
        F.count_if(F.col("week4_completion_pct") >= 100).alias("week4_achieved"),
        F.count(F.lit(1)).alias("total"),
    )


def performance_stats(activation: DataFrame) -> DataFrame:
    return activation.agg(
        F.round(F.avg("avg_performance_score"), 1).alias("avg_performance"),
        F.round(F.min("avg_performance_score"), 1).alias("min_performance"),
        F.round(F.max("avg_performance_score"), 1).alias("max_performance"),
        F.count(F.lit(1)).alias("activated_orgs"),
    )


def mart_summary(staging: DataFrame, goals: DataFrame, activation: DataFrame) -> DataFrame:
    """Organizations (and how many converted), goals, activated, and the
    activation rate over ALL orgs (the goal stats above use open trials as the
    base)."""
    n_goals = goals.agg(F.count(F.lit(1))).scalar()
    n_act = activation.agg(F.count(F.lit(1))).scalar()
    return staging.agg(F.count(F.lit(1)).alias("total_orgs"), F.count_if("converted").alias("converted_orgs")).select(
        "total_orgs", "converted_orgs",
        n_goals.alias("total_goals"),
        n_act.alias("activated_orgs"),
        F.when(F.col("total_orgs") > 0, n_act / F.col("total_orgs") * 100.0).alias("activation_rate_all_pct"),
    )


def quality_checks(staging: DataFrame, goals: DataFrame, goals_mart: DataFrame, activation: DataFrame) -> DataFrame:
    """The mart checks, one row each: (check_name, passed, lhs, rhs).

    ``record_count_consistency`` compares all staging orgs with the open-trial
    mart as the source does, so it fails once anyone converted;
    ``open_trial_count_consistency`` is the comparison that was meant."""
    st = staging.agg(F.count(F.lit(1)).cast("double").alias("n"),
                     F.count_if(~F.col("converted")).cast("double").alias("open"))
    gm = goals_mart.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"),
                                 F.count_if(F.col("overall_achieved") == 1).cast("double").alias("ach"))).scalar()
    n_mart, n_ach = gm.getField("n"), gm.getField("ach")
    thr = goal_thresholds(goals)
    w1, me = thr.getField("w1"), thr.getField("me")
    sample = goals_mart.orderBy("org_id").limit(5).agg(F.count(F.lit(1)).cast("double")).scalar()
    n_act = activation.agg(F.count(F.lit(1)).cast("double")).scalar()
    one = st.select(
        "n", "open", n_mart.alias("n_mart"), n_ach.alias("n_ach"), w1.alias("w1"), me.alias("me"),
        sample.alias("sample"), n_act.alias("n_act"),
    ).select(
        "*",
        (F.col("n") == F.col("n_mart")).alias("c1"), (F.col("open") == F.col("n_mart")).alias("c2"),
        ((F.col("w1") > 0) & (F.col("me") > 0)).alias("c3"), (F.col("sample") > 0).alias("c4"),
        (F.col("n_act") == F.col("n_ach")).alias("c5"),
    )
    # the overall verdict is over the four original checks (c2 is the added one)
    n_passed = sum(F.col(c).cast("int") for c in ("c1", "c2", "c3", "c4", "c5"))
    return one.select(rows_of(["check_name", "passed", "lhs", "rhs"], [
        ["record_count_consistency", F.col("c1"), F.col("n"), F.col("n_mart")],
        ["open_trial_count_consistency", F.col("c2"), F.col("open"), F.col("n_mart")],
        ["thresholds_positive", F.col("c3"), F.col("w1"), F.col("me")],
        ["sample_data_exists", F.col("c4"), F.col("sample"), F.lit(0.0)],
        ["view_consistency", F.col("c5"), F.col("n_act"), F.col("n_ach")],
        ["all_checks_passed", F.col("c1") & F.col("c3") & F.col("c4") & F.col("c5"), n_passed.cast("double"), F.lit(5.0)],
    ]))
