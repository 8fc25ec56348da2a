from convlens.functions.categories import PRODUCT_CATEGORY_MAP
from convlens.operators import charts, features, segments
from tests.helpers import log_df

ROWS = [("a", "x", 1, True, 5, 30), ("a", "y", 6, True, 5, 30), ("a", "y", 7, True, 5, 30),
        ("b", "x", 1, False, None, 30), ("b", "x", 2, False, None, 30), ("b", "z", 3, False, None, 30),
        ("c", "y", 9, True, 2, 30)]  # c converted before its only activity


def test_segments(spark):
    log = log_df(spark, ROWS)
    s = {r.segment: r for r in segments.segment_sizes(log).collect()}
    assert (s["not_converted"].records, s["not_converted"].orgs) == (3, 1)
    assert (s["pre_conversion"].records, s["pre_conversion"].orgs) == (1, 1)
    assert (s["all_converted"].records, s["all_converted"].orgs) == (4, 2)
    # segments 1 and 3 partition the log; segment 2 is inside segment 3
    assert s["not_converted"].records + s["all_converted"].records == log.count()
    r = segments.segment_conversion_rate(log).first()
    assert (r.total_orgs, r.converted_orgs) == (2, 1)  # c has no pre-conversion row


def test_activity_comparison_order(spark):
    log = log_df(spark, ROWS)
    out = [(r.ACTIVITY_NAME, r.not_converted_count, r.pre_conversion_count, r.difference)
           for r in segments.activity_comparison(log).collect()]
    assert out == [("x", 2, 1, -1), ("z", 1, 0, -1)]  # ties by absolute difference broken by name


def test_compare_and_patterns(spark):
    org = spark.createDataFrame([(True, 2.0, 1, 1, 10, 3), (True, 4.0, 0, 1, 20, 4), (False, 1.0, 1, 0, 5, 2)],
                                "converted boolean, f double, front_loaded_pattern int, week1_engagement_binary int, "
                                "unique_activities_count long, unique_categories_count long")
    fc = segments.feature_comparison(org, ["f"]).first()
    assert (fc.converted_mean, fc.non_converted_mean, fc.difference, fc.percent_difference) == (3.0, 1.0, 2.0, 200.0)
    p = segments.pattern_differences(org).first()
    assert p.week1_engagement_diff == 100.0 and p.front_loaded_diff == -50.0
    cs = segments.compare_segments(org.filter("converted"), org.filter("not converted"), ["f"]).first()
    assert cs.difference == -2.0 and abs(cs.pct_change - (-66.66666666666667)) < 1e-9


def test_weekday_counts_missing_day_is_null(spark):
    log = log_df(spark, [("a", "x", 0.5, False, None, 30), ("a", "x", 1.5, False, None, 30)])  # Mon, Tue
    wd = {r.day_name: r.records for r in charts.weekday_counts(log).collect()}
    assert wd["Monday"] == 1 and wd["Tuesday"] == 1 and wd["Sunday"] is None and len(wd) == 7


def test_histogram_constant_group_and_density(spark):
    org = spark.createDataFrame([(True, 5.0), (True, 5.0), (False, 0.0), (False, 10.0)], "converted boolean, f double")
    h = charts.feature_histograms(org, ["f"], bins=20).collect()
    assert len(h) == 40
    const = [r for r in h if r.converted and r["count"] > 0]
    assert len(const) == 1 and const[0].bin == 10  # [4.5, 5.5] -> middle bin
    non = [r for r in h if not r.converted]
    assert sum(r["count"] for r in non) == 2 and [r.bin for r in non if r["count"]] == [0, 19]
    width = 10.0 / 20
    assert all(abs(r.density - r["count"] / (2 * width)) < 1e-12 for r in non)


def test_correlations_constant_is_null(spark):
    org = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 7.0, 3.0)], "a double, b double, c double")
    r = {(x.feature_x, x.feature_y): x.correlation for x in charts.feature_correlations(org, ["a", "b", "c"]).collect()}
    assert abs(r[("a", "a")] - 1.0) < 1e-12 and r[("a", "c")] is None
    assert abs(r[("a", "b")] - 0.9933992677987828) < 1e-12


def test_activity_sequence_positions(spark):
    log = log_df(spark, [("a", f"act{i}", 10 - i * 0.5, False, None, 30, 100 + i) for i in range(12)])
    seq = charts.activity_sequence(log).orderBy("position").collect()
    assert [r.position for r in seq] == list(range(12))
    assert seq[0].days_from_start == 0.0 and seq[0].ACTIVITY_NAME == "act11"
    assert [r.position for r in seq if r.labelled] == [0, 5, 10]


def test_feature_comparison_empty_group_is_missing(spark):
    org = spark.createDataFrame([(True, 2.0), (True, 4.0)], "converted boolean, f double")
    r = segments.feature_comparison(org, ["f"]).first()
    assert r.converted_mean == 3.0 and r.non_converted_mean is None and r.percent_difference is None


def test_correlations_pairwise_complete_with_missing(spark):
    rows = [(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, 5.0, 2.0), (4.0, None, 4.0), (5.0, 11.0, 3.0)]
    org = spark.createDataFrame(rows, "a double, b double, c double")
    r = {(x.feature_x, x.feature_y): x.correlation for x in charts.feature_correlations(org, ["a", "b", "c"]).collect()}
    import statistics as S

    def pearson(u, v):
        pts = [(p, q) for p, q in zip(u, v) if p is not None and q is not None]
        return S.correlation([p for p, _ in pts], [q for _, q in pts])

    cols = list(zip(*rows))
    assert abs(r[("a", "b")] - pearson(cols[0], cols[1])) < 1e-12
    assert abs(r[("b", "c")] - pearson(cols[1], cols[2])) < 1e-12
    assert abs(r[("c", "a")] - pearson(cols[2], cols[0])) < 1e-12
