"""Scalar column expressions shared by the operators.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros_between(start, end) -> Column:
    """end - start in microseconds (works for TIMESTAMP and TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def floor_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored: 12 hours before the
    start is day -1, not 0 (Spark's DAY unit truncates toward zero)."""
    return F.floor(micros_between(start, end) / F.lit(float(MICROS_PER_DAY))).cast("int")


def hours_between(start, end) -> Column:
    """Fractional hours, as seconds / 3600."""
    return micros_between(start, end) / F.lit(1_000_000.0) / F.lit(3600.0)


def trial_week(days, lower: int | None = None, upper: int = 4) -> Column:
    """floor(days / 7) + 1, capped at ``upper``.  The exploratory rule caps
    above only (events before the start get week <= 0); the mart rule clips to
    1..4 (``lower=1``)."""
    d = _c(days)
    week = (F.floor(d / F.lit(7.0)) + 1).cast("int")
    week = F.least(week, F.lit(upper))
    if lower is not None:
        week = F.greatest(week, F.lit(lower))
    # least/greatest skip nulls: a null day must stay a null week
    return F.when(d.isNotNull(), week)


def safe_divide(numerator, denominator, default=0.0) -> Column:
    d = _c(denominator)
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(_c(numerator) / d)


def percentage_change(old, new) -> Column:
    """(new - old) / old * 100; null when either side is null or old is 0."""
    o, n = _c(old), _c(new)
    return F.when(o.isNull() | n.isNull() | (o == 0), F.lit(None).cast("double")).otherwise(
        (n - o) / o * F.lit(100.0)
    )


def completion_pct(value, threshold) -> Column:
    """Goal completion capped at 100: reached -> 100, zero target -> 100,
    otherwise value / target * 100."""
    v, t = _c(value), _c(threshold)
    return (
        F.when(v >= t, F.lit(100.0))
        .when(t == 0, F.lit(100.0))
        .otherwise(v.cast("double") / t * F.lit(100.0))
    )


def is_weekend(ts) -> Column:
    return F.weekday(_c(ts)).isin(5, 6).cast("int")


def python_round(x, digits: int) -> Column:
    """Round half to even, as Python's ``round``/``format`` do on the exact
    binary value for the quarter-step numbers percentiles of counts give."""
    return F.bround(_c(x), digits)


def rows_of(names: list[str], rows: list[list]) -> Column:
    """``inline`` generator turning one input row into ``len(rows)`` rows with
    columns ``names`` (an unpivot after aggregation)."""
    structs = []
    for r in rows:
        vals = [v if isinstance(v, Column) else F.lit(v) for v in r]
        structs.append(F.struct(*[v.alias(n) for v, n in zip(vals, names)]))
    return F.inline(F.array(*structs))
