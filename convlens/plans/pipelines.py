"""The two end-to-end programs as functions returning DataFrames.

``mart_pipeline`` (D3): log -> staging tables (materialized once, registered as
views) -> goal-progress and activation views -> stats, checks, summary, and
optional exports.  ``exploratory_pipeline`` (D4): raw log -> dedup -> typing ->
quality reports -> robustness filter -> features -> org table (materialized)
-> segments, comparisons, chart data, tests and (optionally) models.

Everything returned is lazy except the materialized staging / org tables, so a
caller pays only for what it reads.  The staging tables are checkpointed to the
cluster's checkpoint folder: each mart view, stat and check reads them instead
of re-deriving them from the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.categories import PRODUCT_CATEGORY_MAP
from convlens.operators import charts, clean, features, mart, models, segments, stats
from convlens.session import materialize
from convlens.sources import inspect
from convlens.sources.sinks import CSV, export_tables, register_view, write_table

MART_TABLES = ["staging_metrics_per_org", "staging_activation_goals", "mart_trial_goals", "mart_trial_activation"]


def mart_pipeline(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, output_dir: str | None = None,
                  fmt: str = "parquet", register: bool = True) -> dict[str, DataFrame]:
    prepared = mart.prepare_log(log, cols)
    staging = materialize(mart.staging_metrics(prepared, cols), "staging_metrics_per_org", per_org=True)
    goals = materialize(mart.activation_goals(staging), "staging_activation_goals", per_org=True)
    goals_mart = mart.trial_goals(staging, goals)
    activation = mart.trial_activation(goals_mart)
    out = {
        "trial_week_distribution": mart.trial_week_distribution(prepared),
        "staging_metrics_per_org": staging,
        "staging_activation_goals": goals,
        "mart_trial_goals": goals_mart,
        "mart_trial_activation": activation,
        "goal_stats": mart.goal_stats(goals_mart),
        "completion_stats": mart.completion_stats(goals_mart),
        "performance_stats": mart.performance_stats(activation),
        "summary": mart.mart_summary(staging, goals, activation),
        "quality_checks": mart.quality_checks(staging, goals, goals_mart, activation),
    }
    if register or output_dir:
        for name in MART_TABLES:
            register_view(out[name], name)
    if output_dir:
        out["exports"] = export_tables(log.sparkSession, MART_TABLES, output_dir, fmt)
    return out


def exploratory_pipeline(raw_log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, category_map=None,
                         typed: bool = True, with_models: bool = True, output_path: str | None = None,
                         through: str = "all", output_format: str = "parquet") -> dict[str, DataFrame]:
    """``raw_log``: the log as read (text columns when ``typed=False``).
    ``through="clean"`` stops after the cleaning phase (reports and the
    cleaned log), without building features, segments, tests or models."""
    category_map = category_map if category_map is not None else PRODUCT_CATEGORY_MAP
    out: dict[str, DataFrame] = {}
    out["profile"] = inspect.profile(raw_log)
    out["dtype_counts"] = inspect.dtype_counts(raw_log)
    out["preview"] = inspect.preview(raw_log, [cols.order or cols.ts])
    out["duplicate_report"] = clean.duplicate_report(raw_log, cols)
    out["duplicate_top_activities"] = clean.duplicate_top_activities(raw_log, cols)
    # ten reports read the deduplicated log: both forms are written once
    deduped = materialize(clean.drop_duplicate_events(raw_log, cols), "deduped_log")
    if not typed:
        out["type_conversion_report"] = clean.type_conversion_report(deduped, cols)
        deduped = materialize(clean.type_log(deduped, cols), "typed_log")
    out["timestamp_ranges"] = clean.timestamp_ranges(deduped, cols)
    out["missing_values"] = clean.missing_values(deduped)
    out["conversion_consistency"] = clean.conversion_consistency(deduped, cols)
    out["conversion_summary"] = clean.conversion_summary(deduped, cols)
    out["rule_results"] = clean.rule_results(deduped, cols)
    out["rule_summary"] = clean.rule_summary(deduped, cols)
    out["rule_anomalies"] = clean.rule_violations(deduped, cols)
    out["trial_duration_stats"] = clean.trial_duration_stats(deduped, cols)
    out["robust_filter_impact"] = clean.robust_filter_impact(deduped, cols)
    clean_log = clean.robust_filter(deduped, cols)
    if output_path:
        schema = clean_log.schema
        write_table(clean_log, output_path, output_format)
        reader = clean_log.sparkSession.read.schema(schema)
        clean_log = reader.options(**CSV).csv(output_path) if output_format == "csv" else reader.parquet(output_path)
    else:
        # every later step reads the cleaned log: write it once
        clean_log = materialize(clean_log, "clean_log")
    out["clean_log"] = clean_log
    if through == "clean":
        return out
    feat = features.activity_categories(features.temporal_features(clean_log, cols), category_map, cols)
    out["feature_log"] = feat
    out["temporal_feature_stats"] = features.temporal_feature_stats(feat)
    out["unmapped_activities"] = features.unmapped_activities(clean_log, category_map, cols)
    out["category_distribution"] = charts.value_counts(feat, "activity_category")
    out["activity_distribution"] = charts.value_counts(feat, cols.activity)
    org = materialize(features.org_features(feat, cols), "org_features", per_org=True)
    out["org_features"] = org
    for name in segments.SEGMENT_NAMES:
        out[f"segment_{name}"] = segments.segment(feat, name, cols)
    out["segment_sizes"] = segments.segment_sizes(feat, cols)
    out["segment_conversion_rate"] = segments.segment_conversion_rate(feat, cols)
    out["activity_comparison"] = segments.activity_comparison(feat, cols)
    out["feature_comparison"] = segments.feature_comparison(org)
    out["pattern_differences"] = segments.pattern_differences(org)
    out["hourly_counts"] = charts.hourly_counts(feat, cols)
    out["weekday_counts"] = charts.weekday_counts(feat, cols)
    out["daily_counts"] = charts.daily_counts(feat, cols)
    out["weekend_counts"] = charts.weekend_counts(feat, cols)
    out["feature_histograms"] = charts.feature_histograms(org)
    out["feature_correlations"] = charts.feature_correlations(org)
    out["conversion_class_sizes"] = charts.conversion_class_sizes(org)
    out["log_summary"] = charts.log_summary(feat, cols)
    tests = stats.hypothesis_tests(org)
    out["hypothesis_tests"] = tests
    out["tests_summary"] = stats.tests_summary(tests)
    if with_models:
        m = models.build_models(org, cols.org)
        out["model_comparison"], out["feature_importance"], out["model_scores"] = m["comparison"], m["importance"], m["scores"]
    return out


def run_outputs(outputs: dict[str, DataFrame], out_dir: str | None = None, fmt: str = "parquet",
                max_workers: int = 8, skip: set[str] | None = None) -> dict[str, float]:
    """Execute every output of a pipeline: written under ``out_dir/<name>``,
    or run to completion without output when ``out_dir`` is None.  The
    outputs are independent actions, so they are submitted concurrently from
    driver threads and the scheduler interleaves their tasks.  Returns the
    seconds each took."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    from convlens.sources.sinks import write_table

    def run(item):
        name, df = item
        t0 = time.time()
        if out_dir is None:
            df.write.format("noop").mode("overwrite").save()
        else:
            write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt)
        return name, time.time() - t0

    items = [(n, d) for n, d in outputs.items() if n not in (skip or set())]
    with ThreadPoolExecutor(max_workers=max(1, min(max_workers, len(items)))) as pool:
        return dict(pool.map(run, items))
