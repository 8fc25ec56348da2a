"""Command line: the two programs on an activity-log export.

    python -m convlens mart    LOG_PATH OUT_DIR [--format csv|parquet] [--input-format csv|parquet]
    python -m convlens explore LOG_PATH OUT_DIR [--no-models] [--format ...] [--input-format ...]
    python -m convlens live    LOG_DIR  OUT_DIR [--input-format ...] [--lateness "7 days"] [--available-now]

``mart`` writes the four mart tables plus stats and checks; ``explore`` writes
the cleaned log and every report of the exploratory program; ``live`` follows
a folder that receives log files and keeps the staging counts current
(OUT_DIR/staging holds the updates, OUT_DIR/stream-checkpoint the stream
state; the staging table is then ``streaming.live_mart.live_staging_metrics``).  Each output is a
folder under OUT_DIR.  The session comes from ``spark-submit`` / the cluster
defaults; nothing here sets cluster resources.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="convlens")
    ap.add_argument("program", choices=["mart", "explore", "live"])
    ap.add_argument("log_path")
    ap.add_argument("out_dir")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--input-format", default="csv", choices=["parquet", "csv"])
    ap.add_argument("--no-models", action="store_true")
    ap.add_argument("--lateness", default="7 days")
    ap.add_argument("--available-now", action="store_true")
    a = ap.parse_args(argv)

    from dataclasses import replace

    from convlens.columns import DEFAULT_COLUMNS
    from convlens.operators.clean import type_log
    from convlens.plans.pipelines import exploratory_pipeline, mart_pipeline, run_outputs
    from convlens.session import ensure_checkpoint_dir
    from convlens.sources.log import read_log

    spark = SparkSession.builder.appName(f"convlens-{a.program}").getOrCreate()
    ensure_checkpoint_dir(spark)
    if a.program == "live":
        from convlens.streaming.live_mart import start_live_staging

        files = spark.read.option("recursiveFileLookup", "true")  # schema from the files already there
        sample = files.option("header", True).csv(a.log_path) if a.input_format == "csv" else files.parquet(a.log_path)
        # a log without the order column is ordered by its event times: a stream has no file order
        cols = DEFAULT_COLUMNS if DEFAULT_COLUMNS.order in sample.columns else replace(DEFAULT_COLUMNS, order=None)
        typed = type_log(sample, cols) if a.input_format == "csv" else sample
        reader = spark.readStream.schema(sample.schema).option("recursiveFileLookup", "true")
        stream = reader.option("header", True).csv(a.log_path) if a.input_format == "csv" else reader.parquet(a.log_path)
        if a.input_format == "csv":
            stream = type_log(stream, cols)
        stream = stream.select(*typed.columns)
        q = start_live_staging(stream, os.path.join(a.out_dir, "staging"), os.path.join(a.out_dir, "stream-checkpoint"),
                               cols=cols, lateness=a.lateness, available_now=a.available_now)
        q.awaitTermination()
        return
    raw = read_log(spark, a.log_path, a.input_format)
    if a.program == "mart":
        log = type_log(raw) if a.input_format == "csv" else raw
        out = mart_pipeline(log, output_dir=os.path.join(a.out_dir, "tables"), fmt=a.format)
        skip = {"staging_metrics_per_org", "staging_activation_goals", "mart_trial_goals", "mart_trial_activation"}
    else:
        out = exploratory_pipeline(raw, typed=a.input_format != "csv", with_models=not a.no_models,
                                   output_path=os.path.join(a.out_dir, "data_clean"), output_format=a.format)
        skip = {"clean_log"}
    run_outputs(out, a.out_dir, a.format, skip=skip)
    # the console report of each program: small result tables only
    report = (["summary", "staging_activation_goals", "completion_stats", "performance_stats", "quality_checks"]
              if a.program == "mart" else ["log_summary", "rule_results", "robust_filter_impact", "hypothesis_tests"])
    for name in report:
        if name in out:
            print(f"== {name}")
            out[name].show(truncate=False)


if __name__ == "__main__":
    main()
