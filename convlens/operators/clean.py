"""Cleaning and data-quality operators.

Scale notes
-----------
* Keep-first dedup is an aggregation, not a window: ``groupBy(key)`` with
  ``min_by`` per column (or of the row).  Partial aggregation collapses copies map-side, so a
  group of copies holding a third of the log costs one small shuffle record
  per map task instead of one task sorting a third of the data.
* Every report is one aggregation pass; per-column rows are produced by an
  unpivot of the one-row result.
* The robustness filter aggregates per org once, reads the P95 as a scalar
  subquery and semi-joins the log to the kept orgs (AQE splits a skewed org
  partition on the log side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.expr import floor_days, rows_of

# Fixed values of the validation rules and the robustness filter.
EXPECTED_TRIAL_DAYS = 30
TRIAL_DAYS_TOLERANCE = 1
MIN_ACTIVITIES = 3
MAX_ACTIVITIES_PERCENTILE = 0.95


# ------------------------------------------------------------------ C1 / C2

_FIXED_WIDTH = {"boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz"}

def drop_duplicate_events(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Remove duplicates on (org, activity, timestamp), keeping the first row
    in input order (``cols.order``, distinct among copies).  Logs whose other
    columns have fixed width are hash-aggregated; strings need the sort aggregate."""
    key = cols.dedup_key
    if not cols.order:
        return log.dropDuplicates(key)
    others = [c for c in log.columns if c not in key]
    if all(log.schema[c].dataType.typeName() in _FIXED_WIDTH for c in others):
        # a minimum per column is a hash aggregate on both sides of the shuffle
        kept = log.groupBy(*key).agg(*[F.min_by(F.col(c), F.col(cols.order)).alias(c) for c in others])
        return kept.select(*log.columns)
    kept = log.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(cols.order)).alias("_row"))
    return kept.select(*key, "_row.*").select(*log.columns)


def _key_counts(log: DataFrame, cols: LogColumns) -> DataFrame:
    return log.groupBy(*cols.dedup_key).agg(F.count(F.lit(1)).alias("_n"))


def duplicate_report(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Rows before/after, duplicates and their share, orgs and activities
    touched by duplicates.  Counting per key and then per org/activity keeps
    both distinct counts on the (much smaller) key table."""
    k = _key_counts(log, cols)
    dup = F.col("_n") > 1
    r = k.agg(
        F.sum("_n").alias("total_rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_distinct(F.when(dup, F.col(cols.org))).alias("orgs_with_duplicates"),
        F.count_distinct(F.when(dup, F.col(cols.activity))).alias("activities_with_duplicates"),
    )
    return r.select(
        F.coalesce("total_rows", F.lit(0)).cast("long").alias("total_rows"),
        F.coalesce("duplicate_rows", F.lit(0)).cast("long").alias("duplicate_rows"),
        F.when(F.col("total_rows") > 0, F.col("duplicate_rows") / F.col("total_rows") * 100.0).otherwise(0.0).alias("duplicate_pct"),
        "orgs_with_duplicates", "activities_with_duplicates", "rows_after",
    )


def duplicate_top_activities(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, n: int = 10) -> DataFrame:
    """Top ``n`` activities by number of duplicate rows (ties by name)."""
    k = _key_counts(log, cols).filter(F.col("_n") > 1)
    return (
        k.groupBy(cols.activity)
        .agg(F.sum(F.col("_n") - 1).cast("long").alias("duplicate_count"))
        .orderBy(F.col("duplicate_count").desc(), F.col(cols.activity))
        .limit(n)
    )


# ------------------------------------------------------------------ C3 - C5

def type_log(text_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, org_type: str | None = None) -> DataFrame:
    """Type a text log: the four time columns to TIMESTAMP_NTZ and the flag
    to BOOLEAN with ``try_cast`` (bad values become null)."""
    out = text_log
    present = set(text_log.columns)
    for c in cols.timestamps:
        if c in present:  # optional columns are coerced only when present
            out = out.withColumn(c, F.col(c).try_cast("timestamp_ntz"))
    if cols.converted in present:
        out = out.withColumn(cols.converted, F.col(cols.converted).try_cast("boolean"))
    if org_type:
        out = out.withColumn(cols.org, F.col(cols.org).try_cast(org_type))
    if cols.order and cols.order in out.columns:
        out = out.withColumn(cols.order, F.col(cols.order).try_cast("long"))
    return out


def type_conversion_report(text_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Per typed column: nulls before, nulls after, and failures (values that
    did not parse).  One pass over the text log."""
    targets = [(c, "timestamp_ntz") for c in cols.timestamps] + [(cols.converted, "boolean")]
    aggs = []
    for i, (c, t) in enumerate(targets):
        raw = F.col(c)
        typed = raw.try_cast(t)
        aggs += [F.count_if(raw.isNull()).alias(f"_r{i}"), F.count_if(typed.isNull()).alias(f"_t{i}"),
                 F.count_if(raw.isNotNull() & typed.isNull()).alias(f"_f{i}")]
    one = text_log.agg(*aggs)
    return one.select(rows_of(
        ["column_name", "target_type", "raw_nulls", "typed_nulls", "failures"],
        [[c, t, F.col(f"_r{i}"), F.col(f"_t{i}"), F.col(f"_f{i}")] for i, (c, t) in enumerate(targets)],
    ))


def timestamp_ranges(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Min and max of every time column (the "timezone validation")."""
    aggs = []
    for i, c in enumerate(cols.timestamps):
        aggs += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}")]
    return log.agg(*aggs).select(rows_of(
        ["column_name", "min_value", "max_value"],
        [[c, F.col(f"_lo{i}"), F.col(f"_hi{i}")] for i, c in enumerate(cols.timestamps)],
    ))


# ------------------------------------------------------------------ C6 - C8

def missing_values(df: DataFrame) -> DataFrame:
    """Null count and % for every column."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    pct = lambda i: F.when(F.col("_rows") > 0, F.col(f"_m{i}") / F.col("_rows") * 100.0).otherwise(0.0)
    return df.agg(*aggs).select(rows_of(
        ["column_name", "missing_count", "missing_pct"],
        [[c, F.col(f"_m{i}"), pct(i)] for i, c in enumerate(df.columns)],
    ))


def conversion_consistency(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Row counts by flag and time, and the two inconsistency counts."""
    conv, at = F.col(cols.converted), F.col(cols.converted_at)
    return log.agg(
        F.count_if(conv == True).alias("rows_converted_true"),  # noqa: E712
        F.count_if(conv == False).alias("rows_converted_false"),  # noqa: E712
        F.count_if(at.isNull()).alias("rows_converted_at_null"),
        F.count_if((conv == False) & at.isNotNull()).alias("false_with_time"),  # noqa: E712
        F.count_if((conv == True) & at.isNull()).alias("true_without_time"),  # noqa: E712
    )


def conversion_summary(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Organizations, converted organizations (any converted row) and the
    org-weighted conversion rate.  Two-stage aggregation, no distinct Expand."""
    per_org = log.filter(F.col(cols.org).isNotNull()).groupBy(cols.org).agg(
        F.bool_or(F.coalesce(F.col(cols.converted), F.lit(False))).alias("_c"))
    return per_org.agg(F.count(F.lit(1)).alias("total_orgs"), F.count_if("_c").alias("converted_orgs")).withColumn(
        "conversion_rate_pct",
        F.when(F.col("total_orgs") > 0, F.col("converted_orgs") / F.col("total_orgs") * 100.0),
    )


# ------------------------------------------------------------------ C9 - C12

def rule_violations(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Rule 1 anomalies: events outside [trial start, trial end]."""
    ts = F.col(cols.ts)
    return log.filter((ts < F.col(cols.trial_start)) | (ts > F.col(cols.trial_end)))


def org_trial_durations(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Each org's trial duration in whole days, from its first row with one."""
    d = floor_days(cols.trial_start, cols.trial_end)
    first = F.min_by(d, F.when(d.isNotNull(), F.col(cols.order))) if cols.order else F.max(d)
    return log.filter(F.col(cols.org).isNotNull()).groupBy(cols.org).agg(first.alias("trial_duration"))


def trial_duration_stats(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    d = F.col("trial_duration")
    return org_trial_durations(log, cols).agg(
        F.count(d).alias("orgs"),
        F.min(d).alias("min_duration"),
        F.max(d).alias("max_duration"),
        F.avg(d).alias("mean_duration"),
        F.count_if(F.abs(d - EXPECTED_TRIAL_DAYS) > TRIAL_DAYS_TOLERANCE).alias("orgs_out_of_tolerance"),
    )


def rule_results(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per rule: (rule_id, rule_name, passed, violations, checked)."""
    ts, at, end = F.col(cols.ts), F.col(cols.converted_at), F.col(cols.trial_end)
    rows = log.agg(
        F.count_if((ts < F.col(cols.trial_start)) | (ts > end)).alias("_v1"),
        F.count(F.lit(1)).alias("_n1"),
        F.count_if(at > end).alias("_v2"),
        F.count(at).alias("_n2"),
    )
    dur = org_trial_durations(log, cols).agg(F.struct(
        F.count_if(F.abs(F.col("trial_duration") - EXPECTED_TRIAL_DAYS) > TRIAL_DAYS_TOLERANCE).alias("v"),
        F.count(F.lit(1)).alias("n"),
    )).scalar()
    v3, n3 = dur.getField("v"), dur.getField("n")
    return rows.select(rows_of(
        ["rule_id", "rule_name", "passed", "violations", "checked"],
        [
            [1, "timestamp_within_trial", F.col("_v1") == 0, F.col("_v1"), F.col("_n1")],
            [2, "converted_at_within_trial", F.col("_v2") == 0, F.col("_v2"), F.col("_n2")],
            [3, "trial_duration_valid", v3 == 0, v3, n3],
        ],
    ))


def rule_summary(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Rules checked / passed / success %, and distinct anomalous records
    (rule 1 alone feeds the anomaly list)."""
    r = rule_results(log, cols)
    return r.agg(
        F.count(F.lit(1)).alias("rules_checked"),
        F.count_if("passed").alias("rules_passed"),
        (F.count_if("passed") / F.count(F.lit(1)) * 100.0).alias("success_pct"),
        F.sum(F.when(F.col("rule_id") == 1, F.col("violations")).otherwise(0)).cast("long").alias("anomalous_records"),
    )


# ------------------------------------------------------------------ C13 / C14

def org_activity_counts(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    return log.groupBy(cols.org).agg(
        F.count(F.lit(1)).alias("total_activities"),
        F.count_if(F.col(cols.converted) == True).alias("_conv_rows"),  # noqa: E712
    )


def robust_orgs(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Organizations with MIN_ACTIVITIES <= count <= P95 of the counts over all
    orgs (both inclusive, P95 interpolated)."""
    counts = org_activity_counts(log, cols).filter(F.col(cols.org).isNotNull())
    p95 = counts.agg(F.percentile(F.col("total_activities").cast("double"), MAX_ACTIVITIES_PERCENTILE)).scalar()
    n = F.col("total_activities")
    return counts.filter((n >= MIN_ACTIVITIES) & (n <= p95)).select(
        cols.org, "total_activities", p95.alias("max_activities"))


def robust_filter(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """The log restricted to ``robust_orgs`` (left semi join)."""
    return log.join(robust_orgs(log, cols).select(cols.org), cols.org, "left_semi")


def robust_filter_impact(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Records and orgs before/after, removed and %, and the ROW-weighted
    conversion rate before/after.  Computed from the per-org table alone."""
    counts = org_activity_counts(log, cols)
    p95 = counts.filter(F.col(cols.org).isNotNull()).agg(
        F.percentile(F.col("total_activities").cast("double"), MAX_ACTIVITIES_PERCENTILE)).scalar()
    n = F.col("total_activities")
    kept = F.col(cols.org).isNotNull() & (n >= MIN_ACTIVITIES) & (n <= p95)
    r = counts.agg(
        F.sum(n).alias("records_before"),
        F.sum(F.when(kept, n).otherwise(0)).alias("records_after"),
        F.count(cols.org).alias("orgs_before"),
        F.count_if(kept).alias("orgs_after"),
        F.sum("_conv_rows").alias("_cb"),
        F.sum(F.when(kept, F.col("_conv_rows")).otherwise(0)).alias("_ca"),
        F.first(p95).alias("max_activities"),
    )
    return r.select(
        F.col("records_before").cast("long").alias("records_before"),
        F.col("records_after").cast("long").alias("records_after"),
        (F.col("records_before") - F.col("records_after")).cast("long").alias("records_removed"),
        F.when(F.col("records_before") > 0, (F.col("records_before") - F.col("records_after")) / F.col("records_before") * 100.0).alias("records_removed_pct"),
        "orgs_before", "orgs_after",
        (F.col("orgs_before") - F.col("orgs_after")).alias("orgs_removed"),
        F.when(F.col("orgs_before") > 0, (F.col("orgs_before") - F.col("orgs_after")) / F.col("orgs_before") * 100.0).alias("orgs_removed_pct"),
        F.when(F.col("records_before") > 0, F.col("_cb") / F.col("records_before")).alias("row_conversion_rate_before"),
        F.when(F.col("records_after") > 0, F.col("_ca") / F.col("records_after")).alias("row_conversion_rate_after"),
        "max_activities",
    )
