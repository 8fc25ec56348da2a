"""Dataset profile (rows, columns, per-column type / nulls / distinct) and
preview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.session import materialize


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: data type, null count, null % and distinct count, plus the
    row and column counts of the frame; a frame without columns has no rows here.

    Exact: the frame is written once, then each column is read by itself (a
    pruned scan) and its values are counted; rows, nulls and distinct values follow from those
    counts, and hot values collapse map-side.  No row is copied once a column, as
    several distinct counts in one aggregate would.  ``approximate=True`` takes one
    pass with HyperLogLog and writes nothing."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], _PROFILE)
    if approximate:
        one = df.agg(F.count(F.lit(1)).alias("_rows"), *[a for i, c in enumerate(df.columns) for a in (
            F.count_if(_named(c).isNull()).alias(f"_n{i}"), F.approx_count_distinct(_named(c)).alias(f"_d{i}"))])
        return one.select(F.inline(F.array(*[F.struct(*_profile_row(i, c, t, len(df.columns), F.col("_rows"), F.col(f"_n{i}"), F.col(f"_d{i}")))
                                             for i, (c, t) in enumerate(df.dtypes)])))
    # a column of untyped nulls cannot be written as such
    stored = materialize(df.select(*[(_named(c).cast("string") if t == "void" else _named(c)).alias(c) for c, t in df.dtypes]), "profiled")
    parts = []
    for i, (c, t) in enumerate(df.dtypes):
        values = stored.select(_named(c).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        totals = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("values"))
        parts.append(totals.select(*_profile_row(i, c, t, len(df.columns), F.col("rows"), F.col("nulls"), F.col("values"))))
    return reduce(DataFrame.unionAll, parts)


_PROFILE = ("position int, column_name string, dtype string, null_count long, null_pct double, distinct_count long, "
            "row_count long, column_count int")


def _profile_row(i: int, name: str, dtype: str, columns: int, rows: Column, nulls: Column, distinct: Column) -> list[Column]:
    return [F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.lit(dtype).alias("dtype"), nulls.alias("null_count"),
            F.when(rows > 0, nulls / rows * 100.0).otherwise(F.lit(0.0)).alias("null_pct"), distinct.alias("distinct_count"),
            rows.alias("row_count"), F.lit(columns).alias("column_count")]


def dtype_counts(df: DataFrame) -> DataFrame:
    """Histogram of column types (metadata only: no job runs)."""
    spark = df.sparkSession
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return spark.createDataFrame(sorted(counts.items()), "dtype string, columns int")


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order (a top-k, not an arbitrary head)."""
    return df.orderBy(*order_by).limit(n)
