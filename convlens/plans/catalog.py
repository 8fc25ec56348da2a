"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables through the fixture
(``sources.log.fixture_log``) and runs over all of it.  The DuckDB twin of each
query, where SQL can express it, is in ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.functions.categories import fixture_category_map
from convlens.operators import charts, clean, cohorts, features, mart, models, segments, stages, stats
from convlens.session import ensure_checkpoint_dir, materialize
from convlens.sources import inspect as inspect_
from convlens.sources.log import fixture_log, fixture_log_with_duplicates, fixture_text_log, read_log
from convlens.streaming.live_mart import live_staging_metrics, replay_as_stream, start_live_staging, state_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ the mart

def _mart_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    prepared = mart.prepare_log(fixture_log(spark, sf_dir))
    staging = materialize(mart.staging_metrics(prepared), "staging_metrics_per_org", per_org=True)
    goals = mart.activation_goals(staging)
    goals_mart = mart.trial_goals(staging, goals)
    activation = mart.trial_activation(goals_mart)
    return {"prepared": prepared, "staging": staging, "goals": goals, "goals_mart": goals_mart,
            "activation": activation}


@query("staging_metrics_per_org")
def q_staging(spark, sf_dir):
    return _mart_parts(spark, sf_dir)["staging"]


@query("staging_activation_goals")
def q_goals(spark, sf_dir):
    return _mart_parts(spark, sf_dir)["goals"]


@query("mart_trial_goals")
def q_mart_goals(spark, sf_dir):
    return _mart_parts(spark, sf_dir)["goals_mart"]


@query("mart_trial_activation")
def q_mart_activation(spark, sf_dir):
    return _mart_parts(spark, sf_dir)["activation"]


@query("trial_week_distribution")
def q_week_dist(spark, sf_dir):
    return mart.trial_week_distribution(_mart_parts(spark, sf_dir)["prepared"])


@query("goal_stats")
def q_goal_stats(spark, sf_dir):
    return mart.goal_stats(_mart_parts(spark, sf_dir)["goals_mart"])


@query("completion_stats")
def q_completion_stats(spark, sf_dir):
    return mart.completion_stats(_mart_parts(spark, sf_dir)["goals_mart"])


@query("performance_stats")
def q_performance_stats(spark, sf_dir):
    return mart.performance_stats(_mart_parts(spark, sf_dir)["activation"])


@query("mart_summary")
def q_mart_summary(spark, sf_dir):
    p = _mart_parts(spark, sf_dir)
    return mart.mart_summary(p["staging"], p["goals"], p["activation"])


@query("mart_sample")
def q_mart_sample(spark, sf_dir):
    return mart.mart_sample(_mart_parts(spark, sf_dir)["goals_mart"])


@query("mart_checks")
def q_mart_checks(spark, sf_dir):
    p = _mart_parts(spark, sf_dir)
    return mart.quality_checks(p["staging"], p["goals"], p["goals_mart"], p["activation"])


# ------------------------------------------------------------------ cleaning


@query("log_profile")
def q_log_profile(spark, sf_dir):
    return inspect_.profile(fixture_log(spark, sf_dir))


@query("log_preview")
def q_log_preview(spark, sf_dir):
    return inspect_.preview(fixture_log(spark, sf_dir), ["ORGANIZATION_ID", "TIMESTAMP", "EVENT_ID"], 5)


@query("dedup_log")
def q_dedup(spark, sf_dir):
    return clean.drop_duplicate_events(fixture_log_with_duplicates(spark, sf_dir))


@query("duplicate_report")
def q_dup_report(spark, sf_dir):
    return clean.duplicate_report(fixture_log_with_duplicates(spark, sf_dir))


@query("duplicate_top_activities")
def q_dup_top(spark, sf_dir):
    return clean.duplicate_top_activities(fixture_log_with_duplicates(spark, sf_dir))


@query("typed_log")
def q_typed_log(spark, sf_dir):
    return clean.type_log(fixture_text_log(spark, sf_dir), org_type="long")


@query("type_conversion_report")
def q_type_report(spark, sf_dir):
    return clean.type_conversion_report(fixture_text_log(spark, sf_dir))


@query("timestamp_ranges")
def q_ts_ranges(spark, sf_dir):
    return clean.timestamp_ranges(clean.type_log(fixture_text_log(spark, sf_dir), org_type="long"))


@query("missing_values")
def q_missing(spark, sf_dir):
    return clean.missing_values(clean.type_log(fixture_text_log(spark, sf_dir), org_type="long"))


@query("conversion_consistency")
def q_conv_consistency(spark, sf_dir):
    return clean.conversion_consistency(fixture_log(spark, sf_dir))


@query("conversion_summary")
def q_conv_summary(spark, sf_dir):
    return clean.conversion_summary(fixture_log(spark, sf_dir))


@query("rule_anomalies")
def q_rule_anomalies(spark, sf_dir):
    return clean.rule_violations(fixture_log(spark, sf_dir))


@query("rule_results")
def q_rule_results(spark, sf_dir):
    return clean.rule_results(fixture_log(spark, sf_dir))


@query("rule_summary")
def q_rule_summary(spark, sf_dir):
    return clean.rule_summary(fixture_log(spark, sf_dir))


@query("trial_duration_stats")
def q_duration_stats(spark, sf_dir):
    return clean.trial_duration_stats(fixture_log(spark, sf_dir))


@query("robust_orgs")
def q_robust_orgs(spark, sf_dir):
    return clean.robust_orgs(fixture_log(spark, sf_dir))


@query("robust_log")
def q_robust_log(spark, sf_dir):
    return clean.robust_filter(fixture_log(spark, sf_dir))


@query("robust_filter_impact")
def q_robust_impact(spark, sf_dir):
    return clean.robust_filter_impact(fixture_log(spark, sf_dir))


# ------------------------------------------------------ features and segments

STAT_DIGITS = 9  # order-dependent floating sums are compared at 9 decimals


def _round_doubles(df: DataFrame, digits: int = STAT_DIGITS) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _round_p(df: DataFrame) -> DataFrame:
    """p-values to the digits that an integral in SQL confirms."""
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("p_") else F.col(c) for c in df.columns])


def _feature_log(spark, sf_dir):
    log = fixture_log(spark, sf_dir)
    return features.activity_categories(features.temporal_features(log), fixture_category_map())


def _org_table(spark, sf_dir):
    # one row per org, reused by every comparison, test and model: cut its
    # lineage once (reliable checkpoint) instead of re-deriving it per use
    return materialize(features.org_features(_feature_log(spark, sf_dir)), "org_features", per_org=True)


@query("temporal_features")
def q_temporal(spark, sf_dir):
    return _feature_log(spark, sf_dir)


@query("activity_categories")
def q_activity_categories(spark, sf_dir):
    return features.activity_categories(fixture_log(spark, sf_dir), fixture_category_map())


@query("temporal_feature_stats")
def q_temporal_stats(spark, sf_dir):
    return _round_doubles(features.temporal_feature_stats(_feature_log(spark, sf_dir)))


@query("activity_distribution")
def q_activity_dist(spark, sf_dir):
    return charts.value_counts(_feature_log(spark, sf_dir), "ACTIVITY_NAME")


@query("category_distribution")
def q_category_dist(spark, sf_dir):
    return charts.value_counts(_feature_log(spark, sf_dir), "activity_category")


@query("top_activities")
def q_top_activities(spark, sf_dir):
    return charts.value_counts(_feature_log(spark, sf_dir), "ACTIVITY_NAME", top=10)


@query("unmapped_activities")
def q_unmapped(spark, sf_dir):
    return features.unmapped_activities(fixture_log(spark, sf_dir), fixture_category_map())


@query("org_features")
def q_org_features(spark, sf_dir):
    return _round_doubles(_org_table(spark, sf_dir))


@query("segment_sizes")
def q_segment_sizes(spark, sf_dir):
    return segments.segment_sizes(fixture_log(spark, sf_dir))


@query("pre_conversion_log")
def q_pre_conversion(spark, sf_dir):
    return segments.segment(fixture_log(spark, sf_dir), segments.PRE_CONVERSION)


@query("segment_conversion_rate")
def q_segment_rate(spark, sf_dir):
    return segments.segment_conversion_rate(fixture_log(spark, sf_dir))


@query("activity_comparison")
def q_activity_comparison(spark, sf_dir):
    return segments.activity_comparison(fixture_log(spark, sf_dir))


@query("feature_comparison")
def q_feature_comparison(spark, sf_dir):
    return _round_doubles(segments.feature_comparison(_org_table(spark, sf_dir)))


SEGMENT_METRICS = ["days_since_trial_start", "hour", "day_of_week", "is_weekend", "trial_week"]


@query("segment_comparison")
def q_segment_comparison(spark, sf_dir):
    log = _feature_log(spark, sf_dir)
    return _round_doubles(segments.compare_segments(
        segments.segment(log, segments.NOT_CONVERTED), segments.segment(log, segments.PRE_CONVERSION),
        SEGMENT_METRICS, segments.NOT_CONVERTED, segments.PRE_CONVERSION))


@query("pattern_differences")
def q_pattern_differences(spark, sf_dir):
    return _round_doubles(segments.pattern_differences(_org_table(spark, sf_dir)))


@query("hourly_counts")
def q_hourly(spark, sf_dir):
    return charts.hourly_counts(fixture_log(spark, sf_dir))


@query("weekday_counts")
def q_weekday(spark, sf_dir):
    return charts.weekday_counts(fixture_log(spark, sf_dir))


@query("daily_counts")
def q_daily(spark, sf_dir):
    return charts.daily_counts(fixture_log(spark, sf_dir))


@query("weekend_counts")
def q_weekend(spark, sf_dir):
    return charts.weekend_counts(fixture_log(spark, sf_dir))


@query("feature_histograms")
def q_histograms(spark, sf_dir):
    return _round_doubles(charts.feature_histograms(_org_table(spark, sf_dir)))


@query("feature_correlations")
def q_correlations(spark, sf_dir):
    return charts.feature_correlations(_org_table(spark, sf_dir), digits=STAT_DIGITS)


@query("activity_sequence")
def q_sequence(spark, sf_dir):
    return _round_doubles(charts.activity_sequence(fixture_log(spark, sf_dir)))


@query("activity_sequence_sample")
def q_sequence_sample(spark, sf_dir):
    return _round_doubles(charts.activity_sequence(fixture_log(spark, sf_dir), max_orgs=5))


@query("log_summary")
def q_log_summary(spark, sf_dir):
    return charts.log_summary(fixture_log(spark, sf_dir))


@query("conversion_class_sizes")
def q_class_sizes(spark, sf_dir):
    return charts.conversion_class_sizes(_org_table(spark, sf_dir))


# ------------------------------------------------------------------ tests


@query("chi_square_test")
def q_chi2(spark, sf_dir):
    org = _org_table(spark, sf_dir)
    return _round_doubles(stats.chi_square_test(org, "week1_engagement_binary").unionByName(
        stats.chi_square_test(org, "front_loaded_pattern")))


@query("contingency_table")
def q_contingency(spark, sf_dir):
    return stats.contingency_table(_org_table(spark, sf_dir), "front_loaded_pattern")


@query("t_test")
def q_ttest(spark, sf_dir):
    return _round_doubles(stats.t_test(_org_table(spark, sf_dir), "week1_activity_ratio"))


@query("mann_whitney_total")
def q_mwu_total(spark, sf_dir):
    return _round_doubles(stats.mann_whitney_test(_org_table(spark, sf_dir), "total_activities_count"))


@query("mann_whitney_categories")
def q_mwu_categories(spark, sf_dir):
    return _round_doubles(stats.mann_whitney_test(_org_table(spark, sf_dir), "unique_categories_count"))


@query("hypothesis_tests")
def q_tests(spark, sf_dir):
    return _round_p(_round_doubles(stats.hypothesis_tests(_org_table(spark, sf_dir))))


@query("tests_summary")
def q_tests_summary(spark, sf_dir):
    return stats.tests_summary(stats.hypothesis_tests(_org_table(spark, sf_dir)))


# ------------------------------------------------------------------ models


@query("model_split")
def q_model_split(spark, sf_dir):
    org = _org_table(spark, sf_dir).select("ORGANIZATION_ID", F.col("converted").cast("int").alias("label"))
    return models.stratified_split(org, "ORGANIZATION_ID", "label")


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    return models.build_models(_org_table(spark, sf_dir), "ORGANIZATION_ID")["comparison"]


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return models.build_models(_org_table(spark, sf_dir), "ORGANIZATION_ID")["importance"]


# ------------------------------------------- plan-document extensions (2.16)

EXT_TEST_FEATURES = ["total_activities_count", "unique_activities_count", "unique_categories_count",
                     "activities_per_day", "days_active", "week1_activity_count", "week1_activity_ratio"]
STAGE_TEST_FEATURES = ["early_stage_count", "late_stage_count", "activities_both_stages"]
TIME_PROFILE_FEATURES = ["weekend_share", "mean_hour", "active_dates"]


@query("stage_features")
def q_stage_features(spark, sf_dir):
    return _round_doubles(stages.stage_features(_feature_log(spark, sf_dir)))


@query("activity_adoption")
def q_activity_adoption(spark, sf_dir):
    return stages.activity_adoption(_feature_log(spark, sf_dir))


@query("cohort_conversion_week")
def q_cohort_week(spark, sf_dir):
    return cohorts.cohort_conversion(fixture_log(spark, sf_dir), "week")


@query("cohort_conversion_month")
def q_cohort_month(spark, sf_dir):
    return cohorts.cohort_conversion(fixture_log(spark, sf_dir), "month")


@query("time_to_conversion")
def q_time_to_conversion(spark, sf_dir):
    return cohorts.time_to_conversion(fixture_log(spark, sf_dir))


@query("activity_penetration")
def q_penetration(spark, sf_dir):
    return _round_doubles(cohorts.activity_penetration(fixture_log(spark, sf_dir)))


@query("weekly_activity_by_conversion")
def q_weekly_by_conversion(spark, sf_dir):
    return _round_doubles(cohorts.weekly_activity_by_conversion(_org_table(spark, sf_dir)))


@query("activity_transitions")
def q_transitions(spark, sf_dir):
    return cohorts.activity_transitions(fixture_log(spark, sf_dir))


@query("segment_temporal_counts")
def q_segment_temporal(spark, sf_dir):
    return cohorts.segment_temporal_counts(_feature_log(spark, sf_dir))


@query("segment_org_profiles")
def q_segment_profiles(spark, sf_dir):
    return _round_doubles(cohorts.segment_org_profiles(_feature_log(spark, sf_dir)))


@query("adoption_chi_square")
def q_adoption_chi2(spark, sf_dir):
    return _round_p(_round_doubles(stats.adoption_chi_square(_feature_log(spark, sf_dir), "ORGANIZATION_ID", "ACTIVITY_NAME",
                                                    "CONVERTED", "EVENT_ID")))


@query("feature_t_tests")
def q_feature_t_tests(spark, sf_dir):
    return _round_p(_round_doubles(stats.t_tests(_org_table(spark, sf_dir), EXT_TEST_FEATURES)))


@query("feature_mann_whitney")
def q_feature_mwu(spark, sf_dir):
    return _round_p(_round_doubles(stats.mann_whitney_tests(_org_table(spark, sf_dir), EXT_TEST_FEATURES)))


@query("feature_ks_tests")
def q_feature_ks(spark, sf_dir):
    return _round_p(_round_doubles(stats.ks_tests(_org_table(spark, sf_dir), EXT_TEST_FEATURES)))


@query("stage_change_anova")
def q_stage_anova(spark, sf_dir):
    st = stages.stage_features(_feature_log(spark, sf_dir))
    return _round_p(_round_doubles(stats.anova(st, "stage_change", "converted")))


@query("stage_t_tests")
def q_stage_t_tests(spark, sf_dir):
    """Stage-wise usage intensity and its change, converted against not converted."""
    return _round_p(_round_doubles(stats.t_tests(stages.stage_features(_feature_log(spark, sf_dir)), STAGE_TEST_FEATURES)))


@query("stage_flag_tests")
def q_stage_flag_tests(spark, sf_dir):
    """Early dominance, balance and engagement rates against conversion."""
    return _round_p(_round_doubles(stages.stage_flag_tests(_feature_log(spark, sf_dir))))


@query("stage_adoption_tests")
def q_stage_adoption_tests(spark, sf_dir):
    """Stage-wise and combined adoption patterns of every activity against conversion."""
    return _round_p(_round_doubles(stages.stage_adoption_tests(_feature_log(spark, sf_dir))))


@query("adjusted_adoption_tests")
def q_adjusted_adoption_tests(spark, sf_dir):
    """X15 over the adoption tests of all activities and patterns."""
    return _round_p(_round_doubles(stats.adjust_p_values(stages.stage_adoption_tests(_feature_log(spark, sf_dir)))))


@query("activity_intensity_tests")
def q_activity_intensity_tests(spark, sf_dir):
    """Usage intensity of every activity, converted against not converted."""
    return _round_p(_round_doubles(stages.activity_intensity_tests(_feature_log(spark, sf_dir))))


@query("time_cell_tests")
def q_time_cell_tests(spark, sf_dir):
    return _round_p(_round_doubles(cohorts.time_cell_tests(_feature_log(spark, sf_dir))))


@query("feature_auc")
def q_feature_auc(spark, sf_dir):
    return _round_doubles(stats.rank_auc(_org_table(spark, sf_dir), EXT_TEST_FEATURES))


@query("model_inputs")
def q_model_inputs(spark, sf_dir):
    return _round_doubles(models.model_inputs(_org_table(spark, sf_dir), "ORGANIZATION_ID"))


LOGISTIC_FEATURES = ["total_activities_count", "week1_activity_ratio"]


@query("logistic_coefficients")
def q_logistic_coefficients(spark, sf_dir):
    train = _round_doubles(models.model_inputs(_org_table(spark, sf_dir), "ORGANIZATION_ID")).where(~F.col("is_test"))
    fit = models.logistic_coefficients(train, LOGISTIC_FEATURES)
    return fit.select("term", *[F.round(c, 6).alias(c) for c in ("coefficient", "odds_ratio")])


@query("time_profile_tests")
def q_time_profile_tests(spark, sf_dir):
    return _round_p(_round_doubles(stats.t_tests(cohorts.per_org_time_profile(_feature_log(spark, sf_dir)), TIME_PROFILE_FEATURES)))


@query("adjusted_tests")
def q_adjusted_tests(spark, sf_dir):
    org = _org_table(spark, sf_dir)
    tests = stats.hypothesis_tests(org, stats.DEFAULT_TESTS + [
        (f"{f}_ttest", "t", f) for f in EXT_TEST_FEATURES])
    return _round_p(_round_doubles(stats.adjust_p_values(tests)))


@query("extended_model_comparison")
def q_extended_models(spark, sf_dir):
    org = _org_table(spark, sf_dir)
    st = stages.stage_features(_feature_log(spark, sf_dir)).drop("converted")
    wide = org.join(st, "ORGANIZATION_ID")
    feats = models.MODEL_FEATURES + ["early_stage_count", "late_stage_count", "early_stage_share",
                                     "activities_both_stages", "stage_change"]
    return models.build_models(wide, "ORGANIZATION_ID", feats,
                               kinds=models.MODEL_KINDS + models.EXTRA_MODEL_KINDS)["comparison"]


# ------------------------------------------------------------- streaming

@query("live_staging_metrics")
def q_live_staging(spark, sf_dir):
    """The staging table maintained by the streaming mart: the fixture log
    (with duplicate copies, which the stream must drop) replayed as four
    time-ordered file groups, run to completion with the default lateness and with
    compaction; trials of up to 31 days are held by day of activity beyond 10 days, so that state
    is evicted within the log's month.  Equals the batch table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/convlens-live/{uuid.uuid4().hex}"
    live = state_session(spark)
    stream = replay_as_stream(fixture_log_with_duplicates(live, sf_dir), base)
    q = start_live_staging(stream, f"{base}/staging", f"{base}/stream-checkpoint", lateness="7 days",
                           available_now=True, longest_trial="10 days", compact_every=2)
    q.awaitTermination()  # to the end of the input; a failed stream raises
    return live_staging_metrics(spark, f"{base}/staging")


# ------------------------------------------------------------------ sinks

@query("mart_exports")
def q_mart_exports(spark, sf_dir):
    """The mart program with CSV exports into the checkpoint folder; the
    report re-reads every written table to count its records."""
    from convlens.plans.pipelines import mart_pipeline

    out_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/convlens-exports/{uuid.uuid4().hex}"
    exports = mart_pipeline(fixture_log(spark, sf_dir), output_dir=out_dir, fmt="csv")["exports"]
    return exports.select("table_name", "records", "columns", "error")


# ------------------------------------------------------------- exploratory program

@query("exploratory_clean_log")
def q_exploratory_clean_log(spark, sf_dir):
    """The exploratory program's cleaned log from a raw text export with
    duplicate copies and bad timestamps: dedup on the raw strings, typing,
    P95 robustness filter."""
    from convlens.plans.pipelines import exploratory_pipeline

    raw = fixture_text_log(spark, sf_dir, with_duplicates=True)
    return exploratory_pipeline(raw, typed=False, category_map=fixture_category_map(), through="clean")["clean_log"]


def _explored(spark, sf_dir, **options):
    """The whole exploratory program (but the model fits) on the raw text export."""
    from convlens.plans.pipelines import exploratory_pipeline

    raw = fixture_text_log(spark, sf_dir, with_duplicates=True)
    return exploratory_pipeline(raw, typed=False, category_map=fixture_category_map(), with_models=False, **options)


@query("exploratory_log_file")
def q_exploratory_log_file(spark, sf_dir):
    """The program's cleaned log as written to CSV files, read back from them."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/convlens-exports/{uuid.uuid4().hex}"
    return _explored(spark, sf_dir, output_path=path, output_format="csv", through="clean")["clean_log"]


@query("exploratory_org_features")
def q_exploratory_org_features(spark, sf_dir):
    return _round_doubles(_explored(spark, sf_dir)["org_features"])


@query("exploratory_segment_sizes")
def q_exploratory_segment_sizes(spark, sf_dir):
    return _explored(spark, sf_dir)["segment_sizes"]


@query("exploratory_activity_comparison")
def q_exploratory_activity_comparison(spark, sf_dir):
    return _explored(spark, sf_dir)["activity_comparison"]


@query("exploratory_feature_comparison")
def q_exploratory_feature_comparison(spark, sf_dir):
    return _round_doubles(_explored(spark, sf_dir)["feature_comparison"])


@query("exploratory_hypothesis_tests")
def q_exploratory_tests(spark, sf_dir):
    return _round_p(_round_doubles(_explored(spark, sf_dir)["hypothesis_tests"]))


# ------------------------------------------------------------------ file order

@query("log_from_files")
def q_log_from_files(spark, sf_dir):
    """The fixture log written as CSV without its order column, in files whose
    sizes differ (ranges of the id's logarithm), read back through ``read_log``:
    rows per org and the first activity in input order."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/convlens-exports/{uuid.uuid4().hex}"
    log = fixture_log(spark, sf_dir)
    ordered = log.repartitionByRange(4, F.floor(F.log2(F.col("EVENT_ID") + 2)), "EVENT_ID").sortWithinPartitions("EVENT_ID")
    ordered.drop("EVENT_ID").write.option("header", True).csv(path)
    back = clean.type_log(read_log(spark, path))
    return back.groupBy(F.col("ORGANIZATION_ID").cast("long").alias("ORGANIZATION_ID")).agg(
        F.count(F.lit(1)).alias("records"), F.min_by("ACTIVITY_NAME", "EVENT_ID").alias("first_activity"),
        F.max_by("ACTIVITY_NAME", "EVENT_ID").alias("last_activity"))
