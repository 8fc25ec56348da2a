"""Conversion views named by the analysis plan: cohorts by trial start,
time to conversion, per-activity penetration and intensity by segment,
weekly activity by conversion, pre-conversion activity transitions, chart
data per segment, and activities used together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.expr import floor_days, hours_between
from convlens.functions.ordered import running_totals
from convlens.operators.segments import SEGMENT_NAMES, segment_predicate
from convlens.operators.stats import cell_t_tests


def _org_facts(log: DataFrame, cols: LogColumns) -> DataFrame:
    order = F.col(cols.order) if cols.order else F.col(cols.ts)
    return log.filter(F.col(cols.org).isNotNull()).groupBy(cols.org).agg(
        F.min_by(F.col(cols.trial_start), order).alias("trial_start"),
        F.min_by(F.col(cols.converted_at), order).alias("converted_at"),
        F.bool_or(F.coalesce(F.col(cols.converted), F.lit(False))).alias("converted"))


def cohort_conversion(log: DataFrame, unit: str = "week", cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Orgs, converted orgs and rate per trial-start cohort (``week``
    starting Monday, or ``month``)."""
    facts = _org_facts(log, cols)
    return facts.groupBy(F.to_date(F.date_trunc(unit, "trial_start")).alias("cohort_start")).agg(
        F.count(F.lit(1)).alias("orgs"), F.count_if("converted").alias("converted_orgs"),
    ).withColumn("conversion_rate_pct", F.col("converted_orgs") / F.col("orgs") * 100.0)


def time_to_conversion(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Converted orgs by whole days from trial start to conversion."""
    facts = _org_facts(log, cols).filter(F.col("converted_at").isNotNull())
    return facts.groupBy(floor_days("trial_start", "converted_at").alias("days_to_conversion")).agg(
        F.count(F.lit(1)).alias("orgs"))


def activity_penetration(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Per segment and activity, orgs using it, penetration (% of the
    segment's orgs) and intensity (rows per using org).  Two-stage counts, no
    distinct Expand; segment sizes are a 3-row table."""
    segs = F.array(*[F.when(F.coalesce(segment_predicate(s, cols), F.lit(False)), F.lit(s)) for s in SEGMENT_NAMES])
    tagged = log.filter(F.col(cols.org).isNotNull()).select(cols.org, cols.activity, F.explode(segs).alias("segment")) \
        .filter(F.col("segment").isNotNull())
    per_org = tagged.groupBy("segment", cols.activity, cols.org).agg(F.count(F.lit(1)).alias("_n"))
    per_act = per_org.groupBy("segment", cols.activity).agg(F.count(F.lit(1)).alias("orgs_using"),
                                                             F.sum("_n").alias("records"))
    seg_orgs = per_org.select("segment", cols.org).distinct().groupBy("segment").agg(
        F.count(F.lit(1)).alias("segment_orgs"))  # at most 3 rows
    return per_act.join(F.broadcast(seg_orgs), "segment").select(
        "segment", cols.activity, "orgs_using", F.col("records").cast("long").alias("records"), "segment_orgs",
        (F.col("orgs_using") / F.col("segment_orgs") * 100.0).alias("penetration_pct"),
        (F.col("records") / F.col("orgs_using")).alias("intensity"))


def weekly_activity_by_conversion(org_table: DataFrame, converted_col: str = "converted") -> DataFrame:
    """X11: mean activities per trial week by conversion class."""
    return org_table.groupBy(converted_col).agg(
        F.count(F.lit(1)).alias("orgs"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("activities_week1", "activities_week2", "activities_week3",
                                                "activities_week4_plus")])


def activity_transitions(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, pre_conversion_only: bool = True) -> DataFrame:
    """Counts of (activity, next activity) within each org's time-ordered
    sequence (pre-conversion rows by default).  The next row is looked up inside
    range slices, and a piece's last row takes the first one of the org's next piece, so a
    hot org is spread over tasks and the log is not joined with itself."""
    src = log.filter(F.coalesce(segment_predicate("pre_conversion", cols), F.lit(False))) if pre_conversion_only else log
    order = [cols.ts] + ([cols.order] if cols.order else [])
    base = src.filter(F.col(cols.org).isNotNull()).select(cols.org, cols.activity, *order)
    pairs = running_totals(base, order, [], [cols.org], following=[cols.activity]).filter("has_next")
    return pairs.groupBy(cols.activity, F.col(f"next_{cols.activity}").alias("next_activity")).agg(
        F.count(F.lit(1)).alias("transitions"))


def segment_temporal_counts(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Activity counts per segment by day since start, hour and weekday
    (tidy: segment, dimension, value, records)."""
    segs = F.array(*[F.when(F.coalesce(segment_predicate(s, cols), F.lit(False)), F.lit(s)) for s in SEGMENT_NAMES])
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).cast("int").alias("value"))
                     for n, c in (("days_since_trial_start", "days_since_trial_start"), ("hour", "hour"),
                                  ("day_of_week", "day_of_week"))])
    t = feature_log.select(F.explode(segs).alias("segment"), F.inline(dims)).filter(F.col("segment").isNotNull())
    return t.groupBy("segment", "dimension", "value").agg(F.count(F.lit(1)).alias("records"))


def segment_org_profiles(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Per segment and org, totals, unique activities and categories,
    and hours from trial start to the org's first activity in the segment."""
    segs = F.array(*[F.when(F.coalesce(segment_predicate(s, cols), F.lit(False)), F.lit(s)) for s in SEGMENT_NAMES])
    t = feature_log.select("*", F.explode(segs).alias("segment")).filter(F.col("segment").isNotNull())
    order = F.col(cols.order) if cols.order else F.col(cols.ts)
    # a hot org's rows collapse map-side to its distinct (activity, category), which a second level then counts
    per = t.groupBy("segment", cols.org, cols.activity, "activity_category").agg(
        F.count(F.lit(1)).alias("_n"), F.min(cols.ts).alias("_ts"), F.min(order).alias("_order"), F.min_by(F.col(cols.trial_start), order).alias("_start"))
    return per.groupBy("segment", cols.org).agg(
        F.sum("_n").cast("long").alias("total_activities"), F.size(F.collect_set(cols.activity)).cast("long").alias("unique_activities"),
        F.size(F.collect_set("activity_category")).cast("long").alias("unique_categories"),
        hours_between(F.min_by("_start", "_order"), F.min("_ts")).alias("time_to_first_activity"))


def per_org_time_profile(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """X22 input: per org, weekend share, mean hour and active days, with the
    conversion flag (tested with ``stats.t_tests``)."""
    order = F.col(cols.order) if cols.order else F.col(cols.ts)
    return feature_log.filter(F.col(cols.org).isNotNull()).groupBy(cols.org).agg(
        F.avg("is_weekend").alias("weekend_share"), F.avg("hour").alias("mean_hour"),
        F.count_distinct(F.to_date(cols.ts)).alias("active_dates"),
        F.min_by(F.col(cols.converted), order).alias("converted"))


def time_cell_tests(feature_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Activities per org in each hour (``hour_13``), weekday (``day_of_week_0``)
    and day of the trial (``day_7``), converted against not converted."""
    order = F.col(cols.order) if cols.order else F.col(cols.ts)
    log = feature_log.filter(F.col(cols.org).isNotNull())
    # a hot org collapses map-side to its distinct (hour, weekday, day)
    per = log.groupBy(cols.org, "hour", "day_of_week", "days_since_trial_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_order"), F.min_by(F.col(cols.converted), order).alias("_converted"))
    classes = per.groupBy(cols.org).agg(F.min_by("_converted", "_order").alias("converted"))
    dims = F.array(*[F.concat(F.lit(f"{n}_"), F.col(c).cast("int").cast("string")) for n, c in (
        ("hour", "hour"), ("day_of_week", "day_of_week"), ("day", "days_since_trial_start"))])
    cells = per.select(cols.org, "_n", F.explode(dims).alias("feature")).filter("feature IS NOT NULL")
    cells = cells.groupBy(cols.org, "feature").agg(F.sum("_n").alias("n")).join(classes, cols.org)
    return cell_t_tests(cells, classes)
