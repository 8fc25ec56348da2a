"""Running totals along an order without sending a whole group to one task.

A window ``PARTITION BY g ORDER BY o`` sorts every group in a single task, so
one hot group (or an unpartitioned global order) serializes the work.  Here the
rows are range-partitioned on (g, o) into ``slices`` contiguous slices, the
running sum is taken inside each (group, slice) piece, and the totals of the
earlier pieces of the same group are added back.  The piece table has at most
groups + slices rows, so its own window is small; the join back is on
(group, slice).  Cost: one range shuffle, one write of the input
columns, and a join with a table of at most groups + slices rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.session import materialize


def running_totals(df: DataFrame, order_cols: list, value_cols: list[str], group_cols: list[str] | None = None,
                   slices: int | None = None, inclusive: bool = False, prefix: str = "before_",
                   minima: list[str] | None = None, following: list[str] | None = None, lows: list[str] | None = None) -> DataFrame:
    """Add ``prefix + c`` for each ``c`` in ``value_cols``: the sum of ``c``
    over the rows of the same group that come strictly before this row in
    ``order_cols`` order (``inclusive=True`` includes the row).  The order
    must be total (add a tiebreak column) for a deterministic result.  Null
    group values form groups like any other value.

    What else a piece can hand on: ``minima`` adds ``min_c``, the least ``c`` of the
    whole group; ``lows`` adds ``low_c``, the least ``c`` of the row and those before it; ``following`` adds ``next_c``, the value of ``c`` in the next row of the
    group (for the last row of a piece the first row of the group's next piece), and
    ``has_next``.  With ``following`` the order is of plain ascending columns."""
    group_cols, minima, following, lows = list(group_cols or []), list(minima or []), list(following or []), list(lows or [])
    spark = df.sparkSession
    frame_end = Window.currentRow if inclusive else -1
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # The slice id is read once and written to the shared checkpoint folder:
    # the range bounds come from a sample whose seed depends on the shuffle,
    # so two evaluations of the same plan may slice differently.  The written
    # table also survives the loss of an executor.
    keyed = materialize(df.repartitionByRange(slices, *[F.col(g) for g in group_cols], *ordered).withColumn(
        "_slice", F.spark_partition_id()), "range_slices")
    w_piece = Window.partitionBy(*group_cols, "_slice").orderBy(*ordered)
    w_local = w_piece.rowsBetween(Window.unboundedPreceding, frame_end)
    head = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(following)]) if following else None
    local = keyed.select("*", *[F.coalesce(F.sum(c).over(w_local), F.lit(0)).alias(f"_loc_{c}") for c in value_cols],
                         *[F.min(c).over(w_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_run_{c}") for c in lows],
                         *([F.lead(head).over(w_piece).alias("_lead")] if following else []))
    pieces = keyed.groupBy(*group_cols, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_tot_{c}") for c in value_cols],
        *[F.min(c).alias(f"_low_{c}") for c in dict.fromkeys(minima + lows)],
        *([F.min_by(head, F.struct(*ordered)).alias("_head")] if following else []))
    w_group = Window.partitionBy(*group_cols).orderBy("_slice")
    w_prev = w_group.rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("_slice").alias("_s"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_prev), F.lit(0)).alias(f"_off_{c}") for c in value_cols],
        *[F.min(f"_low_{c}").over(Window.partitionBy(*group_cols)).alias(f"_min_{c}") for c in minima],
        *[F.min(f"_low_{c}").over(w_prev).alias(f"_prev_{c}") for c in lows],
        *([F.lead("_head").over(w_group).alias("_after")] if following else []))
    same = F.col("_slice") == F.col("_s")
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(offsets, same)
    nxt = F.coalesce("_lead", "_after") if following else None
    return out.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_loc_{c}")).alias(prefix + c) for c in value_cols],
                      *[F.col(f"_min_{c}").alias(f"min_{c}") for c in minima],
                      *[F.least(f"_prev_{c}", f"_run_{c}").alias(f"low_{c}") for c in lows],
                      *[nxt[f"f{i}"].alias(f"next_{c}") for i, c in enumerate(following)],
                      *([nxt.isNotNull().alias("has_next")] if following else []))


def position_in_group(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "position",
                      slices: int | None = None) -> DataFrame:
    """0-based position of each row inside its group in ``order_cols`` order."""
    one = "_one"
    out = running_totals(df.withColumn(one, F.lit(1)), order_cols, [one], group_cols, slices, prefix="_p")
    return out.withColumnRenamed("_p" + one, name).drop(one)

