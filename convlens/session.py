"""Spark session helpers.

Library code never creates a session; it takes the caller's.  ``local_session``
exists for tests, the benchmark and the command line.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("convlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot org's join partition even when the following
        # aggregation then needs its own (partially aggregated) exchange
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # checkpoints of released intermediates are deleted, not accumulated
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``.  Only where it is unset and
    all tasks run in this process (a laptop or a test) take a fresh scratch
    folder; on a cluster every executor would write to its own disk."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server reads spark.checkpoint.dir
        return configured
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="convlens-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, name: str = "table", per_org: bool = False) -> DataFrame:
    """Cut the lineage of a reused intermediate so that a lost executor
    re-reads stored data instead of re-deriving it from the raw log.

    Row-level tables (the cleaned log, range slices) are written as Parquet
    under the shared checkpoint folder and read back: compressed, columnar,
    pruned and filtered on every re-read.  Small per-org tables (staging,
    goals, org features, the model split; one row per org or fewer) use a
    reliable ``checkpoint()`` into the same folder, which re-reads faster when
    the table is read many times."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if per_org or not base:
        return df.checkpoint(eager=True)
    path = f"{base.rstrip('/')}/convlens-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
