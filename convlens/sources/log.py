"""Reading activity logs, and the events fixture.

``read_log`` is the entry for a real export: an explicit all-string schema is
read (no inference pass over the data) and typed with ``try_cast`` so bad
values become nulls that can be counted (see ``operators.clean.type_log``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlens.columns import DEFAULT_COLUMNS, LogColumns


def text_schema(cols: LogColumns = DEFAULT_COLUMNS, extra: list[str] | None = None) -> T.StructType:
    names = [cols.org, cols.activity, cols.ts, cols.converted, cols.converted_at, cols.trial_start, cols.trial_end]
    if cols.order:
        names.append(cols.order)
    names += list(extra or [])
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_log(spark: SparkSession, source, fmt: str = "csv", cols: LogColumns = DEFAULT_COLUMNS,
             schema: T.StructType | None = None) -> DataFrame:
    """Scan an activity log.  ``source`` is a path (CSV with a header, or
    Parquet) or an existing DataFrame.

    CSV columns are matched by their header names and arrive as strings (no
    inference pass over the data; type them with
    ``operators.clean.type_log``).  A log without the order column gets one that
    follows its files by path and the rows within each.  A DataFrame without it is
    numbered by partition, in whatever order it has them.  A
    missing path raises at analysis time, as a missing file should."""
    if isinstance(source, DataFrame):
        df = source
    elif fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        df = reader.schema(schema).csv(source) if schema is not None else reader.option("inferSchema", False).csv(source)
    else:
        df = spark.read.format(fmt).load(source)
    if cols.order and cols.order not in df.columns:
        if isinstance(source, DataFrame):
            return df.withColumn(cols.order, F.monotonically_increasing_id())
        return with_file_order(df, cols.order)
    return df


def with_file_order(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan by (file path, block, row in the block).
    Spark packs large splits first, so a row's task says nothing about its
    place.  The table of splits (one row each) is ranked and joined; a row's number is
    its split's rank above 33 bits of its number within the task."""
    scan = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    splits = scan.select("_file", "_block").distinct()
    ranks = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"),
                          F.row_number().over(Window.orderBy("_file", "_block")).cast("long").alias("_rank"))
    numbered = scan.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    # both scans cut the files alike; if files change between them no row may go unseen
    joined = numbered.join(ranks, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")), "left")
    rank = F.when(F.col("_rank").isNull(), F.raise_error(F.lit("the log's files have changed between two scans; read again")).cast("long")).otherwise(F.col("_rank"))
    return joined.select(*df.columns, (F.shiftleft(rank, 33) + F.col("_row")).alias(name))


# --------------------------------------------------------------------------
# Fixture: the driver's ``events`` table seen as an activity log.
# users stand in for organizations; a user's trial starts at their first
# signup; they convert at their first purchase of value >= 200 at or after the
# start; the trial lasts 14 days for user_id % 20 = 0, 31 for % 7 = 0, else 30.
# --------------------------------------------------------------------------

FIXTURE_VARIANTS = 6
CONVERSION_VALUE = 200.0


def _fixture_duration_days(user: F.Column) -> F.Column:
    return F.when(user % 20 == 0, F.lit(14)).when(user % 7 == 0, F.lit(31)).otherwise(F.lit(30))


def fixture_log(spark: SparkSession, sf_dir: str, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Typed activity log derived from ``events`` (one row per event).

    Plan: a per-user aggregate (partial aggregation, so a hot user costs
    nothing extra), a join with the qualifying purchases, and one equi-join
    back to the events on ``user_id``.
    The join output is hash-partitioned by the user, which every later
    ``groupBy(org)`` reuses; AQE turns it into a broadcast join at run time
    when the measured per-user table is small.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    variant = F.regexp_extract("props", r"(-?\d+)", 1).try_cast("long") % FIXTURE_VARIANTS
    ev = ev.withColumn("activity", F.concat(F.col("event_type"), F.lit("."), variant.cast("string")))

    starts = ev.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("trial_start")
    )
    purchases = ev.filter((F.col("event_type") == "purchase") & (F.col("value") >= CONVERSION_VALUE)).select(
        "user_id", F.col("ts").alias("p_ts")
    )
    # both sides are hash-partitioned by user_id for the join, and the
    # aggregate after it reuses that partitioning: no further exchange
    facts = starts.join(purchases, "user_id", "left").groupBy("user_id").agg(
        F.first("trial_start").alias("trial_start"),  # constant per user (one starts row per user)
        F.min(F.when(F.col("p_ts") >= F.col("trial_start"), F.col("p_ts"))).alias("converted_at"),
    )

    out = ev.join(facts, "user_id").select(
        F.col("user_id").alias(cols.org),
        F.col("activity").alias(cols.activity),
        F.col("ts").alias(cols.ts),
        F.col("converted_at").isNotNull().alias(cols.converted),
        F.col("converted_at").alias(cols.converted_at),
        F.col("trial_start").alias(cols.trial_start),
        (F.col("trial_start") + F.make_dt_interval(days=_fixture_duration_days(F.col("user_id")))).alias(cols.trial_end),
        F.col("event_id").alias(cols.order or "EVENT_ID"),
    )
    return out


DUPLICATE_ID_OFFSET = 1_000_000_000


def fixture_log_with_duplicates(spark: SparkSession, sf_dir: str, cols: LogColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Fixture log plus exact copies (same org, activity, timestamp) of every
    row whose id is a multiple of 10, appended after the originals with the
    id shifted by 1e9 so that "keep first in input order" is well defined."""
    log = fixture_log(spark, sf_dir, cols)
    order = cols.order or "EVENT_ID"
    # one pass: every 10th row is emitted twice (copy 1 carries the shifted id)
    copy = F.explode(F.when(F.col(order) % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = log.select("*", copy.alias("_copy"))
    return out.withColumn(order, F.col(order) + F.col("_copy") * F.lit(DUPLICATE_ID_OFFSET)).drop("_copy")


def fixture_text_log(spark: SparkSession, sf_dir: str, cols: LogColumns = DEFAULT_COLUMNS,
                     with_duplicates: bool = False) -> DataFrame:
    """Fixture log as text, the way a CSV export arrives; the event time of
    every 97th id is replaced by 'garbage' to exercise the typing report
    (``with_duplicates``: starting from ``fixture_log_with_duplicates``)."""
    log = fixture_log_with_duplicates(spark, sf_dir, cols) if with_duplicates else fixture_log(spark, sf_dir, cols)
    order = cols.order or "EVENT_ID"
    return log.select(
        F.col(cols.org).cast("string").alias(cols.org),
        F.col(cols.activity),
        F.when(F.col(order) % 97 == 0, F.lit("garbage")).otherwise(F.col(cols.ts).cast("string")).alias(cols.ts),
        F.col(cols.converted).cast("string").alias(cols.converted),
        F.col(cols.converted_at).cast("string").alias(cols.converted_at),
        F.col(cols.trial_start).cast("string").alias(cols.trial_start),
        F.col(cols.trial_end).cast("string").alias(cols.trial_end),
        F.col(order),
    )
