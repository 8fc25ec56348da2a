"""The data behind each chart (no drawing): value counts with shares,
temporal counts, per-group histograms, the correlation matrix, org activity
sequences, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.functions.expr import is_weekend, micros_between, rows_of
from convlens.functions.ordered import running_totals

# Weekday names, Monday first, and the chart feature lists.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HISTOGRAM_FEATURES = ["total_activities_count", "unique_activities_count", "unique_categories_count",
                      "week1_activity_count", "week1_activity_ratio", "activities_per_day"]
CORRELATION_FEATURES = ["total_activities_count", "unique_activities_count", "activities_per_day",
                        "unique_categories_count", "days_active", "week1_activity_count", "week1_activity_ratio"]
SEQUENCE_LABEL_EVERY = 5
SEQUENCE_LABEL_CHARS = 20


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count and % of rows per value (descending, ties by value); with
    ``top`` the first ``top`` values plus ``remaining_values`` = how many more
    distinct values exist."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    out = counts.select(column, "count", (F.col("count") / total * 100.0).alias("pct"))
    if top is None:
        return out
    n_distinct = counts.agg(F.count(F.lit(1))).scalar()
    return out.orderBy(F.col("count").desc(), F.col(column)).limit(top).withColumn(
        "remaining_values", F.greatest(n_distinct - F.lit(top), F.lit(0)))


def hourly_counts(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    return log.groupBy(F.hour(cols.ts).alias("hour")).agg(F.count(F.lit(1)).alias("records"))


def weekday_counts(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Counts Monday..Sunday; a day with no activity appears with a null
    count.  The pivot on the 7 known weekday values gives the full row without
    a join to a calendar."""
    one = log.select(F.weekday(cols.ts).alias("_wd")).groupBy().pivot("_wd", list(range(7))).count()
    return one.select(rows_of(
        ["day_index", "day_name", "records"],
        [[i, name, F.col(str(i))] for i, name in enumerate(WEEKDAY_NAMES)],
    ))


def daily_counts(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    return log.groupBy(F.to_date(cols.ts).alias("date")).agg(F.count(F.lit(1)).alias("records"))


def weekend_counts(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    return log.groupBy((is_weekend(cols.ts) == 1).alias("is_weekend")).agg(F.count(F.lit(1)).alias("records"))


def feature_histograms(org_table: DataFrame, features: list[str] | None = None, group_col: str = "converted",
                       bins: int = 20) -> DataFrame:
    """Density histograms: ``bins`` equal bins over each (feature, group)'s own
    range, nulls dropped; a constant group uses [x - 0.5, x + 0.5].  Rows:
    (feature, group, bin, bin_start, bin_end, count, density), all bins
    present.  With a boolean group the per-(feature, group) range table has
    at most 3 x len(features) rows and is broadcast."""
    features = features or HISTOGRAM_FEATURES
    long = org_table.select(group_col, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ]))).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ranges = long.groupBy("feature", group_col).agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"),
                                                    F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select(
        "feature", group_col, "_n",
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    )
    # a boolean group gives at most 3 x len(features) range rows: provably
    # small, so broadcast; any other group column is left to AQE
    bounded = dict(org_table.dtypes).get(group_col) == "boolean"
    binned = long.join(F.broadcast(ranges) if bounded else ranges, ["feature", group_col]).select(
        "feature", group_col,
        F.least(F.floor((F.col("value") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))).cast("int"),
                F.lit(bins - 1)).alias("bin"))
    counts = binned.groupBy("feature", group_col, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    out = grid.join(counts, ["feature", group_col, "bin"], "left").select(
        "feature", group_col, "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("_n") * width)).alias("density"),
    )
    return out


def feature_correlations(org_table: DataFrame, features: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Pearson correlation of every feature pair over the rows where both are
    present (pairwise complete), from sample covariances and deviations
    (numerically stable merges).  A constant feature gives null, not an error.

    One aggregate, whatever is missing: a pair's covariance and both deviations
    are over the rows that have both.  With nothing missing they equal the
    plain ones, as they see the same rows in the same order."""
    features = features or CORRELATION_FEATURES
    k = len(features)
    # NaN counts as missing
    x = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    pairs = [(i, j) for i in range(k) for j in range(k)]
    aggs = []
    for i in range(k):
        for j in range(i, k):
            a, b = F.when(x[j].isNotNull(), x[i]), F.when(x[i].isNotNull(), x[j])
            aggs += [F.covar_samp(a, b).alias(f"_c{i}_{j}"), F.stddev_samp(a).alias(f"_sx{i}_{j}"), F.stddev_samp(b).alias(f"_sy{i}_{j}")]
    one = org_table.agg(*aggs)

    def parts(a, b):
        return F.col(f"_c{a}_{b}"), F.col(f"_sx{a}_{b}"), F.col(f"_sy{a}_{b}")

    def r(i, j):
        a, b = (i, j) if i <= j else (j, i)
        cov, sa, sb = parts(a, b)
        den = sa * sb
        v = F.when(den > 0, cov / den)
        return F.round(v, digits) if digits is not None else v

    return one.select(rows_of(["feature_x", "feature_y", "correlation"],
                              [[features[i], features[j], r(i, j)] for i, j in pairs]))


def activity_sequence(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, org_ids: list | None = None,
                      max_orgs: int | None = None, seed: int = 42) -> DataFrame:
    """Each org's activities in time order: position, days from the org's
    first event, and a label on every 5th event.  ``org_ids`` restricts to
    given orgs; ``max_orgs`` samples that many orgs by a seeded hash (the
    sampling feature of the sequence chart).  The position is computed with
    range-partitioned running totals, so a hot org is spread over tasks."""
    src = log
    if org_ids is not None:
        src = src.filter(F.col(cols.org).isin(list(org_ids)))
    elif max_orgs is not None:
        key = F.md5(F.concat(F.col(cols.org).cast("string"), F.lit(f":{seed}")))
        picked = src.select(cols.org).distinct().orderBy(key, F.col(cols.org)).limit(max_orgs)
        src = src.join(picked, cols.org, "left_semi")
    order = [cols.ts] + ([cols.order] if cols.order else [])
    base = src.select(cols.org, cols.activity, cols.ts, *([cols.order] if cols.order else []))
    # the org's first event comes with the pieces' minima, so the log is not read again for it
    pos = running_totals(base.withColumn("_one", F.lit(1)), order, ["_one"], [cols.org], prefix="position", minima=[cols.ts])
    out = pos.filter(F.col(cols.org).isNotNull()).withColumnsRenamed({"position_one": "position", f"min_{cols.ts}": "_first"}).select(
        cols.org, cols.activity, cols.ts, *([cols.order] if cols.order else []),
        F.col("position").cast("long").alias("position"),
        (micros_between("_first", cols.ts) / F.lit(1_000_000.0) / F.lit(86400.0)).alias("days_from_start"),
        (F.col("position") % SEQUENCE_LABEL_EVERY == 0).alias("labelled"),
        F.when(F.col("position") % SEQUENCE_LABEL_EVERY == 0,
               F.substring(cols.activity, 1, SEQUENCE_LABEL_CHARS)).alias("label"),
    )
    return out


def log_summary(log: DataFrame, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Rows, orgs, time range, distinct activities, converted orgs, rate.
    One scan: a pre-aggregation per (org, activity) (partial aggregation
    map-side), then one row from that much smaller table."""
    per = log.groupBy(cols.org, cols.activity).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce(F.col(cols.converted), F.lit(False))).alias("_c"),
        F.min(cols.ts).alias("_lo"), F.max(cols.ts).alias("_hi"))
    org = F.col(cols.org)
    return per.agg(
        F.sum("_n").cast("long").alias("total_records"),
        F.count_distinct(org).alias("total_orgs"),
        F.min("_lo").alias("first_activity"), F.max("_hi").alias("last_activity"),
        F.count_distinct(cols.activity).alias("unique_activities"),
        F.count_distinct(F.when(F.col("_c") & org.isNotNull(), org)).alias("converted_orgs"),
    ).withColumn("conversion_rate_pct",
                 F.when(F.col("total_orgs") > 0, F.col("converted_orgs") / F.col("total_orgs") * 100.0))


def conversion_class_sizes(org_table: DataFrame, converted_col: str = "converted") -> DataFrame:
    """Orgs per conversion class and their share of all orgs."""
    total = org_table.agg(F.count(F.lit(1))).scalar()
    return org_table.groupBy(converted_col).agg(F.count(F.lit(1)).alias("orgs")).withColumn(
        "share_pct", F.col("orgs") / total * 100.0)
