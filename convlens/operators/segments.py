"""Analysis segments and the comparisons between them.

Segments are predicates, not copies: 1 = not converted, 2 = pre-conversion
(converted and strictly before the conversion time), 3 = all converted.
Comparisons are conditional aggregates in one pass over the log or the org
table; there is no split-then-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.expr import percentage_change, rows_of

NOT_CONVERTED, PRE_CONVERSION, ALL_CONVERTED = "not_converted", "pre_conversion", "all_converted"
SEGMENT_NAMES = [NOT_CONVERTED, PRE_CONVERSION, ALL_CONVERTED]

# The feature lists of the comparisons.
BIVARIATE_FEATURES = ["total_activities_count", "unique_activities_count", "unique_categories_count",
                      "activities_per_day", "days_active", "week1_activity_count", "week1_activity_ratio",
                      "front_loaded_pattern"]


def segment_predicate(name: str, cols: LogColumns = DEFAULT_COLUMNS) -> Column:
    conv = F.col(cols.converted)
    if name == NOT_CONVERTED:
        return conv == False  # noqa: E712
    if name == ALL_CONVERTED:
        return conv == True  # noqa: E712
    if name == PRE_CONVERSION:
        return (conv == True) & (F.col(cols.ts) < F.col(cols.converted_at))  # noqa: E712
    raise ValueError(name)


def segment(log: DataFrame, name: str, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    return log.filter(F.coalesce(segment_predicate(name, cols), F.lit(False)))


def _seg_flags(cols: LogColumns) -> list[Column]:
    return [F.coalesce(segment_predicate(s, cols), F.lit(False)) for s in SEGMENT_NAMES]


def _per_org_segments(log: DataFrame, cols: LogColumns) -> DataFrame:
    flags = _seg_flags(cols)
    return log.filter(F.col(cols.org).isNotNull()).groupBy(cols.org).agg(
        *[F.count_if(f).alias(f"_s{i}") for i, f in enumerate(flags)])


def segment_sizes(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Rows and distinct orgs per segment (two-stage: per org, then total)."""
    per_org = _per_org_segments(log, cols)
    one = per_org.agg(*[F.sum(f"_s{i}").alias(f"_r{i}") for i in range(3)],
                      *[F.count_if(F.col(f"_s{i}") > 0).alias(f"_o{i}") for i in range(3)])
    return one.select(rows_of(
        ["segment", "records", "orgs"],
        [[s, F.coalesce(F.col(f"_r{i}"), F.lit(0)).cast("long"), F.col(f"_o{i}")] for i, s in enumerate(SEGMENT_NAMES)],
    ))


def segment_conversion_rate(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Converted = orgs with at least one pre-conversion row; total = that
    plus the non-converted orgs (a converted org with no pre-conversion
    activity is in neither)."""
    per_org = _per_org_segments(log, cols)
    one = per_org.agg(F.count_if(F.col("_s0") > 0).alias("_nc"), F.count_if(F.col("_s1") > 0).alias("converted_orgs"))
    total = F.col("_nc") + F.col("converted_orgs")
    return one.select(total.alias("total_orgs"), "converted_orgs",
                      F.when(total > 0, F.col("converted_orgs") / total * 100.0).alias("conversion_rate_pct"))


def activity_comparison(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, top: int = 20) -> DataFrame:
    """Per activity: rows in segment 1 and in segment 2 and the difference
    (2 - 1); the ``top`` activities by absolute difference, ties by name."""
    f1, f2 = _seg_flags(cols)[0], _seg_flags(cols)[1]
    per = log.groupBy(cols.activity).agg(F.count_if(f1).alias("not_converted_count"),
                                         F.count_if(f2).alias("pre_conversion_count"))
    per = per.filter((F.col("not_converted_count") > 0) | (F.col("pre_conversion_count") > 0))
    per = per.withColumn("difference", F.col("pre_conversion_count") - F.col("not_converted_count"))
    return per.orderBy(F.abs("difference").desc(), F.col(cols.activity)).limit(top)


def feature_comparison(org_table: DataFrame, features: list[str] | None = None, converted_col: str = "converted") -> DataFrame:
    """Mean of each feature for converted vs non-converted orgs, difference
    and % difference (0 when the non-converted mean is 0)."""
    features = features or BIVARIATE_FEATURES
    conv = F.col(converted_col) == True  # noqa: E712
    non = F.col(converted_col) == False  # noqa: E712
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(F.when(conv, F.col(f))).alias(f"_c{i}"), F.avg(F.when(non, F.col(f))).alias(f"_n{i}")]
    tidy = org_table.agg(*aggs).select(rows_of(
        ["feature", "converted_mean", "non_converted_mean"],
        [[f, F.col(f"_c{i}"), F.col(f"_n{i}")] for i, f in enumerate(features)],
    ))
    diff = F.col("converted_mean") - F.col("non_converted_mean")
    base = F.col("non_converted_mean")
    # 0 when the base mean is 0; missing (empty group) stays missing
    return tidy.select("*", diff.alias("difference"),
                       F.when(base.isNull(), F.lit(None).cast("double"))
                       .when(base != 0, diff / base * 100.0).otherwise(F.lit(0.0)).alias("percent_difference"))


def compare_segments(seg1: DataFrame, seg2: DataFrame, metrics: list[str], name1: str = "segment_1",
                     name2: str = "segment_2") -> DataFrame:
    """Generic two-segment mean comparison: one union, one aggregate."""
    both = seg1.select(F.lit(1).alias("_s"), *metrics).unionByName(seg2.select(F.lit(2).alias("_s"), *metrics))
    aggs = []
    for i, m in enumerate(metrics):
        aggs += [F.avg(F.when(F.col("_s") == 1, F.col(m))).alias(f"_a{i}"),
                 F.avg(F.when(F.col("_s") == 2, F.col(m))).alias(f"_b{i}")]
    tidy = both.agg(*aggs).select(rows_of(
        ["metric", "segment1", "segment2", "segment1_mean", "segment2_mean"],
        [[m, name1, name2, F.col(f"_a{i}"), F.col(f"_b{i}")] for i, m in enumerate(metrics)],
    ))
    return tidy.select("*", (F.col("segment2_mean") - F.col("segment1_mean")).alias("difference"),
                       percentage_change("segment1_mean", "segment2_mean").alias("pct_change"))


def pattern_differences(org_table: DataFrame, converted_col: str = "converted") -> DataFrame:
    """Week-1 engagement and front-loaded shares (percentage points) and mean
    unique activities / categories, converted vs not, in one row."""
    conv = F.col(converted_col) == True  # noqa: E712
    non = F.col(converted_col) == False  # noqa: E712

    def m(c, cond):
        return F.avg(F.when(cond, F.col(c)))

    one = org_table.agg(
        (m("week1_engagement_binary", conv) * 100.0).alias("converted_week1_engagement_pct"),
        (m("week1_engagement_binary", non) * 100.0).alias("non_converted_week1_engagement_pct"),
        (m("front_loaded_pattern", conv) * 100.0).alias("converted_front_loaded_pct"),
        (m("front_loaded_pattern", non) * 100.0).alias("non_converted_front_loaded_pct"),
        m("unique_activities_count", conv).alias("converted_unique_activities"),
        m("unique_activities_count", non).alias("non_converted_unique_activities"),
        m("unique_categories_count", conv).alias("converted_categories"),
        m("unique_categories_count", non).alias("non_converted_categories"),
    )
    return one.select(
        "*",
        (F.col("converted_week1_engagement_pct") - F.col("non_converted_week1_engagement_pct")).alias("week1_engagement_diff"),
        (F.col("converted_front_loaded_pct") - F.col("non_converted_front_loaded_pct")).alias("front_loaded_diff"),
        (F.col("converted_unique_activities") - F.col("non_converted_unique_activities")).alias("unique_activities_diff"),
        (F.col("converted_categories") - F.col("non_converted_categories")).alias("categories_diff"),
    )
