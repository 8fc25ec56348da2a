"""Trial-stage features named by the analysis plan (no source code exists
for them; the definitions here are ours and fixed below).

Early stage = days 0-13 since the trial start, late stage = days 14-27.
Org-level stage features are one ``groupBy(org)``; the per-activity adoption
table is one ``groupBy(org, activity)`` and a per-activity percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.operators.stats import cell_t_tests, chi_square_of_counts, class_sizes, flag_chi_square
from convlens.session import materialize

# Stage bounds and flag cut-offs.
EARLY_FIRST_DAY, EARLY_LAST_DAY = 0, 13
LATE_FIRST_DAY, LATE_LAST_DAY = 14, 27
EARLY_DOMINATED_SHARE = 0.6
BALANCED_LOW, BALANCED_HIGH = 0.3, 0.7
ENGAGED_MIN_ACTIVITIES = 1
HEAVY_USER_PERCENTILE = 0.75
# What the chi-square tests look at: flags of an org, patterns of an activity's
# use, and use together with a flag of the org.
STAGE_FLAGS = ["early_dominated", "balanced", "early_engaged", "late_engaged"]
PATTERNS = ["early_adopted", "late_adopted", "both_stages", "heavy_user"]
COMBINED_PATTERNS = {"used_by_early_dominated": "early_dominated", "used_by_balanced": "balanced", "used_by_early_engaged": "early_engaged"}


def _stage_flags():
    d = F.col("days_since_trial_start")
    return d.between(EARLY_FIRST_DAY, EARLY_LAST_DAY), d.between(LATE_FIRST_DAY, LATE_LAST_DAY)


def org_activities(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per (org, activity used): rows in all (``intensity``) and in each
    stage, and the org's class in its first row.  All stage operators start here."""
    early, late = _stage_flags()
    order = F.col(cols.order) if cols.order else F.col(cols.ts)
    return feature_log.filter(F.col(cols.org).isNotNull()).groupBy(cols.org, cols.activity).agg(
        F.count(F.lit(1)).alias("intensity"), F.count_if(early).alias("_e"), F.count_if(late).alias("_l"),
        F.min_by(F.col(cols.converted), order).alias("_c"), F.min(order).alias("_o"))


def stage_features(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS,
                   engaged_min: int = ENGAGED_MIN_ACTIVITIES) -> DataFrame:
    """X1-X3, X5 per org: stage counts, early share and early/late ratio,
    early-dominated / balanced flags, stage engagement flags, and the number
    of activities used in both stages.  ``feature_log`` has
    ``days_since_trial_start`` (``features.temporal_features``)."""
    return _org_stages(org_activities(feature_log, cols), cols, engaged_min)


def _org_stages(per_act: DataFrame, cols: LogColumns, engaged_min: int = ENGAGED_MIN_ACTIVITIES) -> DataFrame:
    org = per_act.groupBy(cols.org).agg(
        F.sum("_e").cast("long").alias("early_stage_count"), F.sum("_l").cast("long").alias("late_stage_count"),
        F.count_if((F.col("_e") > 0) & (F.col("_l") > 0)).alias("activities_both_stages"),
        F.min_by("_c", "_o").alias("converted"))
    e, l = F.col("early_stage_count"), F.col("late_stage_count")
    share = F.when(e + l > 0, e / (e + l))
    return org.select(
        cols.org, "early_stage_count", "late_stage_count", share.alias("early_stage_share"),
        F.when(l > 0, e / l).alias("early_late_ratio"),
        F.coalesce(share > EARLY_DOMINATED_SHARE, F.lit(False)).alias("early_dominated"),
        F.coalesce(share.between(BALANCED_LOW, BALANCED_HIGH), F.lit(False)).alias("balanced"),
        (e >= engaged_min).alias("early_engaged"), (l >= engaged_min).alias("late_engaged"),
        "activities_both_stages", (l - e).alias("stage_change"), "converted",
    )


def activity_adoption(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """X4/X5 long form, one row per (org, activity used): intensity (rows),
    early / late adoption, use in both stages, and heavy use (intensity above
    the activity's P75 over the orgs that use it)."""
    return _adoption(org_activities(feature_log, cols), cols)


def _adoption(per: DataFrame, cols: LogColumns) -> DataFrame:
    p75 = per.groupBy(cols.activity).agg(
        F.percentile(F.col("intensity").cast("double"), HEAVY_USER_PERCENTILE).alias("activity_p75"))
    return per.join(p75, cols.activity).select(
        cols.org, cols.activity, "intensity", (F.col("_e") > 0).alias("early_adopted"),
        (F.col("_l") > 0).alias("late_adopted"), ((F.col("_e") > 0) & (F.col("_l") > 0)).alias("both_stages"),
        (F.col("intensity") > F.col("activity_p75")).alias("heavy_user"), "activity_p75")


def stage_flag_tests(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Chi-square of each stage flag of an org (early-dominated, balanced,
    engaged early, engaged late) x converted."""
    return flag_chi_square(stage_features(feature_log, cols), STAGE_FLAGS)


def stage_adoption_tests(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """For every activity and adoption pattern, chi-square of (org shows the
    pattern / does not) x converted over all orgs.  Patterns are stage-wise
    (early, late, both stages), heavy use, and combined with the org's own stage
    pattern (early-dominated, balanced or engaged early, and uses the activity).
    A pattern that no org shows has statistic 0; a null activity has no test."""
    per = materialize(org_activities(feature_log, cols), "org_activities")  # the log is read once
    orgs = _org_stages(per, cols).select(cols.org, "early_dominated", "balanced", "early_engaged", "converted")
    rows = _adoption(per, cols).join(orgs, cols.org).select(cols.activity, "converted", *PATTERNS, *[
        F.col(flag).alias(name) for name, flag in COMBINED_PATTERNS.items()])
    names = [*PATTERNS, *COMBINED_PATTERNS]
    counts = rows.groupBy(cols.activity).agg(*[
        F.count_if(F.col(n) & (F.col("converted") == value)).alias(f"{n}_{tag}") for n in names for tag, value in (("c", True), ("n", False))])
    long = counts.select(cols.activity, F.inline(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.col(f"{n}_c").alias("a_c"), F.col(f"{n}_n").alias("a_n")) for n in names])))
    return chi_square_of_counts(long, [cols.activity, "pattern"], class_sizes(orgs))


def activity_intensity_tests(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """T test and Cohen's d of every activity's rows per org, converted
    against not converted; orgs that never use it count as zeros, unwritten."""
    per = materialize(org_activities(feature_log, cols), "org_activities")
    classes = per.groupBy(cols.org).agg(F.min_by("_c", "_o").alias("converted"))
    cells = per.filter(F.col(cols.activity).isNotNull()).select(cols.org, F.col(cols.activity).alias("feature"), F.col("intensity").alias("n"))
    return cell_t_tests(cells.join(classes, cols.org), classes)
