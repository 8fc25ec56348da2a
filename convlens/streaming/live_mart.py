"""The mart's staging counts maintained from a stream of log rows.

Plan
----
log stream -> mart week rule (stateless projection)
           -> ``closes``: when a row's trial is over, the watermarked time
           -> dropDuplicatesWithinWatermark on (org, activity, timestamp), in
              two stages (salted, then by key) so a hot group of copies is
              spread over tasks
           -> groupBy(org, trial_week, closes).agg(count, trial facts)
              (streaming aggregation: partial aggregation map-side, state in
              the state store, evicted by the watermark; update mode)
           -> foreachBatch: the updated rows under ``epoch=<batch id>``, folded
              into ``snapshot=<batch id>`` every few batches

When a trial is closed
----------------------
``closes`` is the trial's end, but at most the day ``longest_trial`` after the
row's activity (so a long trial cannot push the watermark past the others) and,
for activity after the trial, the end of that day.  The watermark trails the
greatest ``closes`` by ``lateness`` plus ``longest_trial``; since no ``closes`` is
more than ``longest_trial`` after its row, the watermark is never later than the
newest activity less ``lateness``.  So what counts is the activities' time,
however far ahead trials end: a row is dropped only if it comes more than ``lateness``
behind the newest activity and its trial was over by then too.  State goes at
most ``longest_trial`` after that.  A trial longer than ``longest_trial`` has a
state for each day of activity; ``longest_trial`` changes what is held (and for how
long after a trial), never what is counted of rows that come in time.

The table
---------
An update is keyed by the state's key, and a key's latest update holds its whole
count.  Compaction reads the last snapshot and the epochs after it, keeps the
latest update of each key, writes the next snapshot, and only then deletes what
the snapshot before the last one and its epochs held; a reader takes the newest
complete snapshot and the epochs after it.  A retried batch rewrites its own
epoch or snapshot, so it is idempotent.  The number of files is bounded by the
snapshots' and those of ``compact_every`` epochs, however many batches ran.

``live_staging_metrics`` folds the table into the ``staging_metrics_per_org``
shape with one ``groupBy``; an org whose trial end changes in the log keeps all
its counts.  The goal thresholds are then computed in batch from it
(``operators.mart.activation_goals``), exactly as for a batch log.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convlens.columns import DEFAULT_COLUMNS, LogColumns
from convlens.operators.mart import prepare_log

KEY = ["org_id", "trial_week", "closes"]
FACTS = ["converted", "trial_start", "trial_end"]

DEDUP_SALTS = 16
LONGEST_TRIAL = "31 days"
COMPACT_EVERY = 8
ROWS_PER_FILE = 200_000
STATE_STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.boundedMemoryUsage": "true",  # one bound for all partitions on an executor
    "rocksdb.trackTotalNumberOfRows": "false",  # a lookup per write, for a metric only
}


def closing_time(cols: LogColumns, longest_trial: str = LONGEST_TRIAL) -> Column:
    """When the trial of a row is over, in the activities' time (see above).  A
    row without a trial end or without a time takes what it has."""
    ts, start, end = (F.col(c).cast("timestamp") for c in (cols.ts, cols.trial_start, cols.trial_end))
    longest = F.expr(f"INTERVAL {longest_trial}")
    last = F.date_trunc("day", F.coalesce(ts, start) + longest)
    next_day = F.date_trunc("day", ts) + F.expr("INTERVAL 1 day")
    return F.greatest(F.least(F.coalesce(end, last), last), next_day)


def week_count_updates(log_stream: DataFrame, cols: LogColumns = DEFAULT_COLUMNS, lateness: str = "7 days",
                       salts: int = DEDUP_SALTS, longest_trial: str = LONGEST_TRIAL) -> DataFrame:
    """Streaming aggregate of activities per (org, trial week).

    Duplicates are dropped in two stages: first on (key, random salt), which
    spreads a group of copies over ``salts`` tasks and drops most of it there,
    then on the key alone, which sees at most ``salts`` survivors per key.
    The second stage alone decides what is kept (one row per key within the
    watermark), so the result does not depend on the salt."""
    order = F.col(cols.order) if cols.order else F.col(cols.ts)
    prepared = prepare_log(log_stream, cols).withColumn("closes", closing_time(cols, longest_trial))
    watermarked = prepared.withWatermark("closes", f"{lateness} {longest_trial}")
    if salts > 1:
        watermarked = watermarked.withColumn("_salt", (F.rand(42) * salts).cast("int")).dropDuplicatesWithinWatermark(
            [*cols.dedup_key, "_salt"]).drop("_salt")
    deduped = watermarked.dropDuplicatesWithinWatermark(cols.dedup_key)

    def first(column: str) -> Column:
        c = F.col(column)
        return F.min(F.when(c.isNotNull(), F.struct(order.alias("at"), c.alias("value"))))

    return deduped.filter(F.col(cols.org).isNotNull()).groupBy(F.col(cols.org).alias("org_id"), "trial_week", "closes").agg(
        F.count(F.lit(1)).alias("activities"),
        *[first(c).alias(n) for n, c in zip(FACTS, (cols.converted, cols.trial_start, cols.trial_end))])


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system and path of a folder (local or any shared storage)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbered(spark: SparkSession, table_dir: str, kind: str) -> list[int]:
    """The numbers of the complete ``<kind>=<number>`` folders, in order."""
    fs, p = _folder(spark, table_dir)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    found = [int(m[1]) for m in (re.fullmatch(rf"{kind}=(\d+)", n) for n in names) if m]
    return sorted(n for n in found if fs.exists(_folder(spark, f"{table_dir}/{kind}={n}/_SUCCESS")[1]))


def _count_files(spark: SparkSession, path: str) -> int:
    """The data files of a written folder."""
    fs, p = _folder(spark, path)
    return sum(s.isFile() and s.getPath().getName().startswith("part-") for s in fs.listStatus(p))


def live_state(spark: SparkSession, table_dir: str) -> DataFrame:
    """The latest update of every (org, week, closes): the newest snapshot and the epochs after it."""
    table_dir = table_dir.rstrip("/")
    snapshot = max(_numbered(spark, table_dir, "snapshot"), default=-1)
    parts = [(-1, f"{table_dir}/snapshot={snapshot}")] if snapshot >= 0 else []
    parts += [(e, f"{table_dir}/epoch={e}") for e in _numbered(spark, table_dir, "epoch") if e > snapshot]
    if not parts:
        raise FileNotFoundError(f"no batch has been written under {table_dir}")
    updates = None
    for epoch, path in parts:  # one snapshot and at most compact_every epochs
        part = spark.read.parquet(path).withColumn("epoch", F.lit(epoch))
        updates = part if updates is None else updates.unionByName(part)
    latest = updates.groupBy(*KEY).agg(F.max_by(F.struct("activities", *FACTS), F.col("epoch")).alias("u"))
    return latest.select(*KEY, "u.*")


def compact(spark: SparkSession, table_dir: str, epoch: int) -> None:
    """Write the state up to ``epoch`` as a snapshot; delete what the snapshot
    before it made superfluous (readers may still hold the last one's files)."""
    table_dir = table_dir.rstrip("/")
    before = [s for s in _numbered(spark, table_dir, "snapshot") if s < epoch]
    live_state(spark, table_dir).write.mode("overwrite").parquet(f"{table_dir}/snapshot={epoch}")
    keep = max(before, default=-1)
    for kind in ("snapshot", "epoch"):
        for n in _numbered(spark, table_dir, kind):
            if n < keep or (kind == "epoch" and n == keep):
                fs, p = _folder(spark, f"{table_dir}/{kind}={n}")
                fs.delete(p, True)


def _upsert(table_dir: str, compact_every: int):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/epoch={epoch}")
        if epoch % compact_every == compact_every - 1:
            compact(batch.sparkSession, table_dir, epoch)
    return write


def start_live_staging(log_stream: DataFrame, table_dir: str, checkpoint_dir: str, cols: LogColumns = DEFAULT_COLUMNS,
                       lateness: str = "7 days", available_now: bool = False, processing_time: str | None = None,
                       longest_trial: str = LONGEST_TRIAL, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start the stream.  ``checkpoint_dir`` must be on shared storage (it
    holds offsets and the aggregation state)."""
    updates = week_count_updates(log_stream, cols, lateness, longest_trial=longest_trial)
    w = (updates.writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint_dir).foreachBatch(_upsert(table_dir, compact_every)))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def live_staging_metrics(spark: SparkSession, table_dir: str) -> DataFrame:
    """``staging_metrics_per_org`` from the streamed table: one ``groupBy(org)`` over its state."""
    wk = F.col("trial_week")
    per_org = live_state(spark, table_dir).groupBy("org_id").agg(
        *[F.sum(F.when(wk == w, F.col("activities")).otherwise(0)).cast("long").alias(f"week{w}_activities") for w in (1, 2, 3, 4)],
        F.sum("activities").cast("long").alias("total_activities"),
        *[F.min(n)["value"].alias(n) for n in FACTS])
    return per_org.select(
        "org_id", "week1_activities", "week2_activities", "week3_activities", "week4_activities", "total_activities",
        F.coalesce(F.col("converted").cast("boolean"), F.lit(False)).alias("converted"),
        F.to_date("trial_start").alias("trial_start_date"), F.to_date("trial_end").alias("trial_end_date"),
    )


def state_session(spark: SparkSession) -> SparkSession:
    """An isolated session (same context, own SQL conf) to run the stream in.
    The state goes to RocksDB: on the executors' disks and, in memory, within a
    fixed bound, where the default store holds every key on the heap.  It has one
    partition per shuffle partition, fixed at the stream's first run: as
    many as the cluster runs at a time."""
    live = spark.newSession()
    for name, value in STATE_STORE.items():
        live.conf.set(f"spark.sql.streaming.stateStore.{name}", value)
    try:
        live.conf.set("spark.sql.shuffle.partitions", str(max(1, spark.sparkContext.defaultParallelism)))
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): keep the session's setting
        pass
    return live


def replay_as_stream(log: DataFrame, work_dir: str, chunks: int = 4, ts_col: str = "TIMESTAMP",
                     rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write a batch log as ``chunks`` time-ordered file groups under
    ``work_dir`` (shared storage) and return a file stream over them, read
    one group per micro-batch.  Used to feed the live mart from a table.

    A micro-batch takes a number of files, so every group is written as equally
    many, by the rows of the largest; where Spark writes none for an empty task, files
    without rows make up the number.  So there are ``chunks`` micro-batches
    whatever the log's size, and none holds a part of a group, whose rest
    might come too late after it."""
    spark = log.sparkSession
    stored = f"{work_dir.rstrip('/')}/log"
    log.write.mode("overwrite").parquet(stored)
    table = spark.read.parquet(stored)
    bounds = table.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    src = f"{work_dir.rstrip('/')}/in"
    files = 1
    if bounds.lo is not None:
        span = (bounds.hi - bounds.lo) / chunks
        conds = []
        for i in range(chunks):
            lo, hi = bounds.lo + span * i, bounds.lo + span * (i + 1)
            cond = F.col(ts_col) >= lo if i > 0 else (F.col(ts_col) >= lo) | F.col(ts_col).isNull()
            conds.append(cond & (F.col(ts_col) < hi) if i < chunks - 1 else cond)
        largest = max(table.agg(*[F.count_if(c) for c in conds]).first())
        files = max(1, -(-largest // rows_per_file))
        for i, cond in enumerate(conds):
            group = f"{src}/part{i:04d}"
            table.filter(cond).repartition(files).write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(group)
            for _ in range(files - _count_files(spark, group)):
                table.limit(0).coalesce(1).write.mode("append").parquet(group)
    return (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
            .option("recursiveFileLookup", "true").parquet(src))
