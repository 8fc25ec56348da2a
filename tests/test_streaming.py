"""The streamed staging table equals the batch one on the same log."""

import os
import tempfile

from pyspark.sql import functions as F

from convlens.operators import mart
from convlens.sources.log import fixture_log, fixture_log_with_duplicates
from convlens.streaming.live_mart import live_staging_metrics, start_live_staging
from tests.conftest import SF_SMALL


def test_live_staging_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="convlens-stream-")
    src = os.path.join(root, "in")
    # the log (with duplicate copies, which the stream must drop) arrives as 4 files by time
    log = fixture_log_with_duplicates(spark, SF_SMALL)
    bounds = log.agg(F.min("TIMESTAMP").alias("lo"), F.max("TIMESTAMP").alias("hi")).first()
    span = (bounds.hi - bounds.lo) / 4
    for i in range(4):
        lo, hi = bounds.lo + span * i, bounds.lo + span * (i + 1)
        part = log.filter((F.col("TIMESTAMP") >= lo) & ((F.col("TIMESTAMP") < hi) if i < 3 else F.lit(True)))
        part.write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"),
                           available_now=True, longest_trial="10 days", compact_every=3)
    q.awaitTermination(300)
    # closed trials have left the aggregation's state
    removed = sum(o["numRowsRemoved"] for p in q.recentProgress for o in p["stateOperators"])
    assert removed > 0
    live = live_staging_metrics(spark, os.path.join(root, "staging"))
    batch = mart.staging_metrics(mart.prepare_log(fixture_log(spark, SF_SMALL)))
    assert live.count() == batch.count()
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_watermark_closes_trials_and_drops_late_rows(spark):
    """Trial A ends on day 30; once trials ending on day 100 are streaming and
    the lateness is 10 days, A's counts are final and a late A row is dropped."""
    from datetime import datetime, timedelta

    from tests.helpers import LOG_SCHEMA

    t0 = datetime(2024, 1, 1)
    root = tempfile.mkdtemp(prefix="convlens-late-")
    src = os.path.join(root, "in")

    def batch(i, rows):
        spark.createDataFrame(rows, LOG_SCHEMA).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))

    a = lambda d, i: ("A", "x", t0 + timedelta(days=d), False, None, t0, t0 + timedelta(days=30), i)
    b = lambda d, i: ("B", "x", t0 + timedelta(days=d), False, None, t0 + timedelta(days=70), t0 + timedelta(days=100), i)
    batch(0, [a(1, 1), a(2, 2)])
    batch(1, [b(71, 3)])          # watermark: day 100 less 10 and 31 days, so A (ends day 30) is closed
    stream = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"), lateness="10 days",
                           available_now=True)
    q.awaitTermination(300)
    batch(2, [a(3, 4)])           # late row for the closed trial
    stream = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"), lateness="10 days",
                           available_now=True)
    q.awaitTermination(300)
    live = {r.org_id: r.total_activities for r in live_staging_metrics(spark, os.path.join(root, "staging")).collect()}
    assert live == {"A": 2, "B": 1}


def test_hot_group_of_copies_counted_once(spark):
    from datetime import datetime, timedelta

    from tests.helpers import LOG_SCHEMA

    t0 = datetime(2024, 1, 1)
    root = tempfile.mkdtemp(prefix="convlens-hot-")
    src = os.path.join(root, "in")
    hot = ("H", "x", t0 + timedelta(days=2), False, None, t0, t0 + timedelta(days=30))
    for i in range(3):  # 3 micro-batches, 200 exact copies each, plus one normal row
        rows = [hot + (i * 1000 + j,) for j in range(200)]
        rows.append(("N", "y", t0 + timedelta(days=i + 1), False, None, t0, t0 + timedelta(days=30), 5000 + i))
        spark.createDataFrame(rows, LOG_SCHEMA).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"), lateness="3650 days",
                           available_now=True)
    q.awaitTermination(300)
    live = {r.org_id: r.total_activities for r in live_staging_metrics(spark, os.path.join(root, "staging")).collect()}
    assert live == {"H": 1, "N": 3}


def _replay(spark, root, rows, schema, cols):
    src = os.path.join(root, "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"), cols=cols,
                           lateness="40 days", available_now=True)
    q.awaitTermination()
    return live_staging_metrics(spark, os.path.join(root, "staging"))


def test_org_whose_trial_end_changes_keeps_its_counts(spark):
    from datetime import datetime, timedelta

    from convlens.columns import DEFAULT_COLUMNS
    from tests.helpers import LOG_SCHEMA

    t0 = datetime(2024, 1, 1)
    row = lambda d, end, i: ("A", "x", t0 + timedelta(days=d), False, None, t0, t0 + timedelta(days=end), i)
    rows = [[row(1, 30, 1)], [row(2, 30, 2), row(3, 44, 3)]]
    live = _replay(spark, tempfile.mkdtemp(prefix="convlens-ends-"), rows, LOG_SCHEMA, DEFAULT_COLUMNS)
    batch = mart.staging_metrics(mart.prepare_log(spark.createDataFrame(sum(rows, []), LOG_SCHEMA)))
    assert live.collect() == batch.collect() and live.first().total_activities == 3


def test_log_without_order_column(spark):
    from dataclasses import replace
    from datetime import datetime, timedelta

    from convlens.columns import DEFAULT_COLUMNS
    from tests.helpers import LOG_SCHEMA

    t0 = datetime(2024, 1, 1)
    schema = type(LOG_SCHEMA)([f for f in LOG_SCHEMA.fields if f.name != "EVENT_ID"])
    cols = replace(DEFAULT_COLUMNS, order=None)
    row = lambda o, d: (o, "x", t0 + timedelta(days=d), True, t0 + timedelta(days=20), t0, t0 + timedelta(days=30))
    live = _replay(spark, tempfile.mkdtemp(prefix="convlens-noorder-"), [[row("A", 1)], [row("A", 9), row("B", 2)]], schema, cols)
    got = {r.org_id: r for r in live.collect()}
    assert {o: r.total_activities for o, r in got.items()} == {"A": 2, "B": 1}
    assert all(r.converted and r.trial_start_date == t0.date() for r in got.values())


def _trial(org, start, end):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda d: t0 + timedelta(days=d)
    return lambda d, i, **kw: (org, "x", at(d), kw.get("conv", False), None, at(start), at(kw.get("end", end)) if kw.get("end", end) is not None else None, i)


def test_open_trials_keep_their_counts_whatever_ends_later(spark):
    """Trial A (days 0-30) goes on while trials that end much later, one of them
    very long, stream in; all its rows count at the default lateness."""
    from convlens.columns import DEFAULT_COLUMNS
    from tests.helpers import LOG_SCHEMA

    a, b, c, d = _trial("A", 0, 30), _trial("B", 15, 45), _trial("C", 16, 3000), _trial("D", 1, None)
    parts = [[a(1, 1), d(1, 2)], [b(16, 3), c(16, 4)], [a(17, 5), b(18, 6)], [a(29, 7), d(30, 8), c(30, 9)], [a(33, 10)]]
    root = tempfile.mkdtemp(prefix="convlens-open-")
    src = os.path.join(root, "in")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, LOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"), cols=DEFAULT_COLUMNS, available_now=True)
    q.awaitTermination(300)
    live = live_staging_metrics(spark, os.path.join(root, "staging"))
    batch = mart.staging_metrics(mart.prepare_log(spark.createDataFrame(sum(parts, []), LOG_SCHEMA)))
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
    assert {r.org_id: r.total_activities for r in live.collect()} == {"A": 4, "B": 2, "C": 2, "D": 2}


def test_files_do_not_grow_with_batches(spark):
    from tests.helpers import LOG_SCHEMA

    a = _trial("A", 0, 30)
    root = tempfile.mkdtemp(prefix="convlens-files-")
    src, staging = os.path.join(root, "in"), os.path.join(root, "staging")
    held = []
    for run in range(3):
        for i in range(3):
            rows = [_trial(f"o{n}", 0, 30)(1 + run * 3 + i, n) for n in range(5)] + [a(1 + run * 3 + i, 7, conv=run > 0)]
            spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{run}{i}"))
        stream = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(src))
        q = start_live_staging(stream, staging, os.path.join(root, "ckpt"), available_now=True, compact_every=2)
        q.awaitTermination(300)
        held.append(len(os.listdir(staging)))
        got = {r.org_id: r.total_activities for r in live_staging_metrics(spark, staging).collect()}
        assert got == {"A": 3 * (run + 1), **{f"o{n}": 3 * (run + 1) for n in range(5)}}
    assert max(held) <= 6  # two snapshots and the epochs since the older one


def test_retried_batch_after_compaction(spark):
    from convlens.streaming.live_mart import _upsert

    root = tempfile.mkdtemp(prefix="convlens-retry-")
    ddl = "org_id string, trial_week long, closes timestamp, activities long, converted struct<at: long, value: boolean>, trial_start struct<at: long, value: timestamp>, trial_end struct<at: long, value: timestamp>"
    batch = lambda n: spark.createDataFrame([("A", 1, None, n, (1, False), None, None)], ddl)
    write = _upsert(root, 2)
    for epoch, n in [(0, 1), (1, 2), (1, 2), (2, 3), (3, 5), (3, 5)]:  # epochs 1 and 3 are written again after their snapshots
        write(batch(n), epoch)
        assert live_staging_metrics(spark, root).first().total_activities == n


def _replayed(spark, root, rows, **kw):
    """The micro-batches' numbers of rows and the staging table of a replayed log."""
    from convlens.streaming.live_mart import replay_as_stream, state_session
    from tests.helpers import LOG_SCHEMA

    live = state_session(spark)
    # two tasks write each group, as they do where the log is large
    stream = replay_as_stream(live.createDataFrame(rows, LOG_SCHEMA).repartition(2), root, **kw)
    q = start_live_staging(stream, os.path.join(root, "staging"), os.path.join(root, "ckpt"), available_now=True, compact_every=2)
    q.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    sizes = [p["numInputRows"] for p in q.recentProgress]
    return sizes, dropped, live_staging_metrics(spark, os.path.join(root, "staging"))


def test_replay_has_one_micro_batch_per_group(spark):
    """The micro-batches are as many as the groups, however many files the log
    is written in; groups with few rows or none count as well."""
    from tests.helpers import LOG_SCHEMA

    a = _trial("A", 0, 30)
    days = [d / 16 for d in range(60)] + [8.5] + [23 + d / 16 for d in range(40)]  # none in the third of four groups
    rows = [(f"o{i % 7}", *a(d, i)[1:]) for i, d in enumerate(days)]
    rows += [(*r[:-1], r[-1] + 1000) for r in rows if r[-1] % 10 == 0]
    last = [("Z", *a(30, 950)[1:])]  # the log's end
    batch = mart.staging_metrics(mart.prepare_log(spark.createDataFrame(rows + last, LOG_SCHEMA).dropDuplicates(["ORGANIZATION_ID", "ACTIVITY_NAME", "TIMESTAMP"])))
    sizes, dropped, live = _replayed(spark, tempfile.mkdtemp(prefix="convlens-groups-"), rows + last, rows_per_file=10)
    assert [n for n in sizes if n] == [66, 2, 45] and len(sizes) <= 5 and dropped == 0
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_replay_of_long_groups_loses_no_rows(spark):
    """A group of half a year comes in one micro-batch, so none of its rows is late."""
    rows = [_trial(f"o{i}", i * 2, i * 2 + 30)(i * 2 + 1, i) for i in range(360)]
    sizes, dropped, live = _replayed(spark, tempfile.mkdtemp(prefix="convlens-long-"), rows, rows_per_file=20)
    assert dropped == 0 and [n for n in sizes if n] == [90] * 4
    assert live.count() == 360 and live.agg(F.sum("total_activities")).first()[0] == 360
