"""Row-level temporal features, activity categories, and the one-row-per-org
feature table.

The org table is ONE ``groupBy(org).agg(...)``: 18 features from conditional
counts, min/max and three exact distinct counts.  Nothing loops over orgs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.categories import attach_category
from convlens.functions.expr import floor_days, hours_between, is_weekend, rows_of, trial_week

TEMPORAL_FEATURES = ["trial_duration_days", "days_since_trial_start", "days_until_trial_end", "hour", "day_of_week",
                     "trial_week"]
FRONT_LOADED_RATIO = 0.5
WEEK_DAYS = 7


def temporal_features(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Trial duration, days since start / until end (floored), hour, weekday
    (Monday = 0), weekend flag and trial week (capped at 4 above only)."""
    days = floor_days(cols.trial_start, cols.ts)
    return log.select(
        "*",
        floor_days(cols.trial_start, cols.trial_end).alias("trial_duration_days"),
        days.alias("days_since_trial_start"),
        floor_days(cols.ts, cols.trial_end).alias("days_until_trial_end"),
        F.hour(cols.ts).alias("hour"),
        F.weekday(cols.ts).alias("day_of_week"),
        is_weekend(cols.ts).alias("is_weekend"),
        trial_week(days).alias("trial_week"),
    )


def activity_categories(log: DataFrame, mapping, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Add ``activity_category``; unmapped activities become 'Other'."""
    return attach_category(log, cols.activity, mapping)


def unmapped_activities(log: DataFrame, mapping, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Distinct activity names the dictionary does not cover."""
    tagged = attach_category(log.select(cols.activity), cols.activity, mapping, out_col="_cat", keep_null=True)
    return tagged.filter(F.col("_cat").isNull()).select(cols.activity).distinct()


def temporal_feature_stats(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Min, max, mean and sample std of each temporal feature (tidy)."""
    names = names or TEMPORAL_FEATURES
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.min(c).cast("double").alias(f"_lo{i}"), F.max(c).cast("double").alias(f"_hi{i}"),
                 F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}")]
    return features.agg(*aggs).select(rows_of(
        ["feature", "min_value", "max_value", "mean_value", "std_value"],
        [[c, F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_m{i}"), F.col(f"_s{i}")] for i, c in enumerate(names)],
    ))


def org_features(features: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per organization with the 18 behavioural features.

    ``features`` is the output of ``temporal_features`` + ``activity_categories``.
    "First row" values (trial duration, conversion flag, trial start) follow
    ``cols.order``."""
    d = F.col("days_since_trial_start")
    facts = {"_dur": "trial_duration_days", "_start": cols.trial_start, "_conv": cols.converted}

    def first(c, order):
        return F.min_by(F.col(c), F.col(order)) if cols.order else F.max(c)

    # first level: a hot org's rows collapse map-side to its distinct (activity, category, day)
    order = [F.min(cols.order).alias("_order")] if cols.order else []
    per = features.filter(F.col(cols.org).isNotNull()).groupBy(cols.org, cols.activity, "activity_category", d).agg(
        F.count(F.lit(1)).alias("_n"), F.min(cols.ts).alias("_ts"), *order, *[first(c, cols.order).alias(k) for k, c in facts.items()])
    n, day_rows = F.sum("_n"), F.sum(F.when(d.isNotNull(), F.col("_n")))
    # the sample deviation from exact integer sums
    s1, s2 = (F.sum(F.col("_n") * p) for p in (d, d.cast("long") * d))
    spread = F.sqrt(F.greatest(s2.cast("double") - s1.cast("double") * s1.cast("double") / day_rows, F.lit(0.0)) / (day_rows - 1))

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0)).cast("long")

    # second level: exact distinct counts as mergeable sets, without an Expand of the log
    agg = per.groupBy(cols.org).agg(
        F.size(F.collect_set(cols.activity)).cast("long").alias("unique_activities_count"),
        n.cast("long").alias("total_activities_count"),
        first("_dur", "_order").alias("_dur"),
        F.size(F.collect_set("activity_category")).cast("long").alias("unique_categories_count"),
        F.size(F.collect_set(d)).cast("long").alias("days_active"),
        hours_between(first("_start", "_order"), F.min("_ts")).alias("time_to_first_activity"),
        F.when(n > 1, F.when(day_rows > 1, spread)).otherwise(F.lit(0.0)).alias("activity_spread"),
        rows_where(d < WEEK_DAYS).alias("week1_activity_count"),
        rows_where(d >= WEEK_DAYS).alias("_late"),
        rows_where((d >= WEEK_DAYS) & (d < 2 * WEEK_DAYS)).alias("activities_week2"),
        rows_where((d >= 2 * WEEK_DAYS) & (d < 3 * WEEK_DAYS)).alias("activities_week3"),
        rows_where(d >= 3 * WEEK_DAYS).alias("activities_week4_plus"),
        first("_conv", "_order").alias("converted"),
    )
    apd = F.when(F.col("_dur") > 0, F.col("total_activities_count") / F.col("_dur")).otherwise(F.lit(0.0))
    ratio = F.when(F.col("total_activities_count") > 0,
                   F.col("week1_activity_count") / F.col("total_activities_count")).otherwise(F.lit(0.0))
    return agg.select(
        cols.org, "unique_activities_count", "total_activities_count",
        apd.alias("activities_per_day"),
        "unique_categories_count", "days_active",
        F.when(F.col("days_active") > 0, apd / F.col("days_active")).otherwise(F.lit(0.0)).alias("activity_density"),
        "time_to_first_activity", "activity_spread", "week1_activity_count",
        ratio.alias("week1_activity_ratio"),
        F.when(F.col("_late") > 0, F.col("week1_activity_count") / F.col("_late"))
        .otherwise(F.lit(float("inf"))).alias("early_vs_late_ratio"),
        F.when(ratio > FRONT_LOADED_RATIO, 1).otherwise(0).alias("front_loaded_pattern"),
        F.when(F.col("week1_activity_count") > 0, 1).otherwise(0).alias("week1_engagement_binary"),
        F.col("week1_activity_count").alias("activities_week1"),
        "activities_week2", "activities_week3", "activities_week4_plus",
        "converted",
    )
