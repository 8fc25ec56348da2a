import os
import tempfile

from pyspark.sql import functions as F

from convlens.functions.categories import fixture_category_map
from convlens.operators import clean
from convlens.plans.pipelines import exploratory_pipeline, mart_pipeline
from convlens.sources import inspect
from convlens.sources.log import fixture_log, fixture_log_with_duplicates, fixture_text_log, read_log
from convlens.sources.sinks import export_tables
from tests.conftest import SF_SMALL


def test_csv_roundtrip_and_typing(spark):
    d = tempfile.mkdtemp(prefix="convlens-csv-")
    text = fixture_text_log(spark, SF_SMALL)
    text.write.mode("overwrite").option("header", True).csv(os.path.join(d, "log"))
    raw = read_log(spark, os.path.join(d, "log"))
    assert all(t == "string" for _, t in raw.dtypes)
    typed = clean.type_log(raw, org_type="long")
    rep = {r.column_name: r.failures for r in clean.type_conversion_report(raw).collect()}
    n_bad = fixture_log(spark, SF_SMALL).filter(F.col("EVENT_ID") % 97 == 0).count()
    assert rep["TIMESTAMP"] == n_bad and rep["TRIAL_START"] == 0
    assert typed.filter(F.col("TIMESTAMP").isNull()).count() == n_bad


def test_profile_and_dtypes(spark):
    log = fixture_log(spark, SF_SMALL)
    prof = {r.column_name: r for r in inspect.profile(log).collect()}
    assert prof["EVENT_ID"].distinct_count == log.count() and prof["CONVERTED_AT"].null_count > 0
    approx = {r.column_name: r for r in inspect.profile(log, approximate=True).collect()}
    assert approx["ORGANIZATION_ID"].distinct_count == prof["ORGANIZATION_ID"].distinct_count
    dt = {r.dtype: r.columns for r in inspect.dtype_counts(log).collect()}
    assert dt["timestamp_ntz"] == 4


def test_profile_of_nulls_ties_and_odd_names(spark):
    rows = [(1, None, float("nan"), None), (1, "a", float("nan"), None), (None, "a", -0.0, None), (2, "b", 0.0, None)]
    df = spark.createDataFrame(rows, "`a.b` int, v string, `x``y` double, n void")
    want = {"a.b": (1, 2), "v": (1, 2), "x`y": (0, 2), "n": (4, 0)}
    for frame, approximate in ((df, False), (df.drop("n"), True)):
        got = {r.column_name: r for r in inspect.profile(frame, approximate).collect()}
        assert {c: (r.null_count, r.distinct_count) for c, r in got.items()} == {c: want[c] for c in frame.columns}
        assert all(r.row_count == 4 and r.column_count == len(frame.columns) and r.null_pct == 25.0 * r.null_count for r in got.values())
    assert [(r.null_count, r.null_pct, r.distinct_count, r.row_count) for r in inspect.profile(df.limit(0)).collect()] == [(0, 0.0, 0, 0)] * 4
    assert inspect.profile(spark.range(2).select()).collect() == []


def test_mart_pipeline_exports(spark):
    out_dir = tempfile.mkdtemp(prefix="convlens-mart-")
    res = mart_pipeline(fixture_log(spark, SF_SMALL), output_dir=out_dir)
    ex = {r.table_name: r for r in res["exports"].collect()}
    assert ex["mart_trial_goals"].records == res["mart_trial_goals"].count() and ex["mart_trial_goals"].error is None
    assert spark.table("mart_trial_activation").count() == res["mart_trial_activation"].count()
    bad = {r.table_name: r for r in export_tables(spark, ["staging_metrics_per_org", "no_such_view"],
                                                   os.path.join(out_dir, "again")).collect()}
    assert bad["no_such_view"].error and bad["staging_metrics_per_org"].records > 0  # one failure does not stop the rest


def test_exploratory_pipeline(spark):
    res = exploratory_pipeline(fixture_log_with_duplicates(spark, SF_SMALL), category_map=fixture_category_map())
    assert res["duplicate_report"].first().duplicate_rows > 0
    clean_n = res["clean_log"].count()
    assert 0 < clean_n <= fixture_log(spark, SF_SMALL).count()
    org = res["org_features"]
    assert org.count() == res["clean_log"].select("ORGANIZATION_ID").distinct().count()
    assert res["tests_summary"].first().tests_performed == 4


def test_missing_log_path_raises(spark):
    import pytest
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        read_log(spark, os.path.join(tempfile.mkdtemp(prefix="convlens-none-"), "no_such_log.csv"))


def test_csv_by_header_names_without_order_column(spark):
    d = tempfile.mkdtemp(prefix="convlens-csv2-")
    path = os.path.join(d, "log.csv")
    with open(path, "w") as f:
        f.write("TRIAL_END,ACTIVITY_NAME,ORGANIZATION_ID,TIMESTAMP,CONVERTED,CONVERTED_AT,TRIAL_START\n")
        f.write("2024-01-31,A.B,abc,2024-01-02 10:00:00,True,,2024-01-01\n")
        f.write("2024-01-31,A.B,abc,2024-01-02 10:00:00,False,,2024-01-01\n")  # duplicate key, later in the file
        f.write("2024-01-31,C.D,abc,2024-01-03 10:00:00,True,2024-01-05 00:00:00,2024-01-01\n")
    raw = read_log(spark, path)
    assert raw.first().ACTIVITY_NAME == "A.B" and "EVENT_ID" in raw.columns
    dedup = clean.drop_duplicate_events(clean.type_log(raw))
    kept = {r.ACTIVITY_NAME: r.CONVERTED for r in dedup.collect()}
    assert kept == {"A.B": True, "C.D": True}  # the first copy in file order is kept


def test_cli_explore_on_csv(spark):
    from convlens.__main__ import main as cli

    d = tempfile.mkdtemp(prefix="convlens-cli-")
    fixture_text_log(spark, SF_SMALL).write.option("header", True).csv(os.path.join(d, "log"))
    cli(["explore", os.path.join(d, "log"), os.path.join(d, "out"), "--format", "parquet"])
    tests = spark.read.parquet(os.path.join(d, "out", "hypothesis_tests"))
    assert tests.count() == 4
    clean_log = spark.read.parquet(os.path.join(d, "out", "data_clean"))
    assert clean_log.count() > 0 and dict(clean_log.dtypes)["TIMESTAMP"] == "timestamp_ntz"


def test_first_in_input_order_follows_the_files(spark):
    """A small first file and a larger second one: the first file's copy is kept."""
    d = tempfile.mkdtemp(prefix="convlens-two-")
    head = "ORGANIZATION_ID,ACTIVITY_NAME,TIMESTAMP,CONVERTED,CONVERTED_AT,TRIAL_START,TRIAL_END\n"
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write(head + "o,x,2024-01-02 10:00:00,True,,2024-01-01,2024-01-31\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write(head + "".join(f"o{i},y,2024-01-02 10:00:00,False,,2024-01-01,2024-01-31\n" for i in range(3000)))
        f.write("o,x,2024-01-02 10:00:00,False,,2024-01-01,2024-01-31\n")
    log = read_log(spark, d)
    kept = clean.drop_duplicate_events(clean.type_log(log)).filter("ACTIVITY_NAME = 'x'").collect()
    assert [r.CONVERTED for r in kept] == [True]
    assert log.count() == log.select("EVENT_ID").distinct().count() == 3002


def test_csv_keeps_times_to_the_microsecond(spark, tmp_path):
    from datetime import datetime

    from convlens.sources.sinks import CSV, write_table

    rows = [("A", datetime(2024, 1, 5, 0, 0, 49, 826080), datetime(2024, 1, 5, 7, 1, 2, 3)), ("B, \"x\"", None, None)]
    df = spark.createDataFrame(rows, "org string, at timestamp_ntz, z timestamp")
    write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(spark.read.schema(df.schema).options(**CSV).csv(str(tmp_path / "t")).collect()) == sorted(df.collect())
