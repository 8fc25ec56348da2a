from datetime import datetime, timedelta

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("ORGANIZATION_ID", T.StringType()),
    T.StructField("ACTIVITY_NAME", T.StringType()),
    T.StructField("TIMESTAMP", T.TimestampNTZType()),
    T.StructField("CONVERTED", T.BooleanType()),
    T.StructField("CONVERTED_AT", T.TimestampNTZType()),
    T.StructField("TRIAL_START", T.TimestampNTZType()),
    T.StructField("TRIAL_END", T.TimestampNTZType()),
    T.StructField("EVENT_ID", T.LongType()),
])

START = datetime(2024, 1, 1)


def day(d: float) -> datetime:
    return START + timedelta(days=d)


def log_df(spark, rows):
    """rows: (org, activity, day_offset, converted, converted_day or None, duration_days[, id])"""
    out = []
    for i, r in enumerate(rows):
        org, act, d, conv, cday, dur = r[:6]
        eid = r[6] if len(r) > 6 else i
        out.append((org, act, day(d), conv, day(cday) if cday is not None else None, START, day(dur), eid))
    return spark.createDataFrame(out, LOG_SCHEMA)
