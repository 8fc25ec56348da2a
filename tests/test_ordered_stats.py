import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convlens.functions.ordered import position_in_group, running_totals
from convlens.operators import stats


def test_running_totals_match_brute_force_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.randint(0, 50), i, rnd.randint(1, 5)) for i in range(600)]
    nid = 1000
    for g in range(20):
        for _ in range(rnd.randint(1, 10)):
            rows.append((f"g{g}", rnd.randint(0, 50), nid, rnd.randint(1, 5)))
            nid += 1
    df = spark.createDataFrame(rows, "g string, o long, id long, v long")
    out = running_totals(df, ["o", "id"], ["v"], ["g"], slices=6).collect()
    expect = {}
    for g in {r[0] for r in rows}:
        acc = 0
        for r in sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2])):
            expect[r[2]] = acc
            acc += r[3]
    assert {r.id: r.before_v for r in out} == expect
    pos = position_in_group(df, ["g"], ["o", "id"], "p", slices=5).filter("g = 'hot'").collect()
    assert sorted(r.p for r in pos) == list(range(600))


def _brute_u(a, b):
    return sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=2, max_size=15), st.lists(st.integers(0, 6), min_size=2, max_size=15))
def test_mann_whitney_u_equals_pair_count(spark, conv, non):
    org = spark.createDataFrame([(True, float(x)) for x in conv] + [(False, float(x)) for x in non],
                                "converted boolean, f double")
    r = stats.mann_whitney_test(org, "f").first()
    assert abs(r.u_statistic - _brute_u(conv, non)) < 1e-9
    assert r.n_converted == len(conv) and r.n_non_converted == len(non)


def test_chi_square_yates_2x2(spark):
    # table (converted x flag): [[10, 20], [30, 40]]
    rows = [(True, 0)] * 10 + [(True, 1)] * 20 + [(False, 0)] * 30 + [(False, 1)] * 40
    org = spark.createDataFrame(rows, "converted boolean, f int")
    r = stats.chi_square_test(org, "f").first()
    n = 100.0
    e = {(1, 0): 30 * 40 / n, (1, 1): 30 * 60 / n, (0, 0): 70 * 40 / n, (0, 1): 70 * 60 / n}
    o = {(1, 0): 10, (1, 1): 20, (0, 0): 30, (0, 1): 40}
    expect = sum((abs(o[k] - e[k]) - 0.5) ** 2 / e[k] for k in o)
    assert r.degrees_of_freedom == 1 and abs(r.chi2_statistic - expect) < 1e-12
    one_col = spark.createDataFrame([(True, 1), (False, 1)], "converted boolean, f int")
    r0 = stats.chi_square_test(one_col, "f").first()
    assert r0.degrees_of_freedom == 0 and r0.chi2_statistic == 0.0


def test_t_test_pooled(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0]
    org = spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b], "converted boolean, f double")
    r = stats.t_test(org, "f").first()
    import statistics as S
    sp2 = ((len(a) - 1) * S.variance(a) + (len(b) - 1) * S.variance(b)) / (len(a) + len(b) - 2)
    t = (S.mean(a) - S.mean(b)) / (sp2 * (1 / len(a) + 1 / len(b))) ** 0.5
    assert abs(r.t_statistic - t) < 1e-12 and r.degrees_of_freedom == 5


def test_hypothesis_tests_have_p_values(spark):
    rows = [(True, 1, 0.9, 30, 3), (True, 1, 0.8, 40, 4), (True, 1, 0.7, 35, 4),
            (False, 1, 0.2, 10, 2), (False, 1, 0.3, 12, 3), (False, 1, 0.1, 8, 2), (False, 1, 0.25, 11, 2)]
    org = spark.createDataFrame(rows, "converted boolean, week1_engagement_binary int, week1_activity_ratio double, "
                                      "total_activities_count long, unique_categories_count long")
    t = {r.test_id: r for r in stats.hypothesis_tests(org).collect()}
    assert t["week1_engagement_chi2"].p_value == 1.0
    assert t["week1_ratio_ttest"].p_value < 0.001 and t["week1_ratio_ttest"].significant
    # exact U distribution (no ties, 3 vs 4): U = 12 -> p = 2 / 35
    assert abs(t["total_activities_mannwhitney"].p_value - 2 / 35) < 1e-12
    s = stats.tests_summary(stats.hypothesis_tests(org)).first()
    assert s.tests_performed == 4


def test_stratified_allocation(spark):
    from convlens.operators.models import class_allocation, stratified_split

    labels = spark.createDataFrame([(1,)] * 29 + [(0,)] * 121, "label int")
    alloc = {r.label: r._n_test for r in class_allocation(labels).collect()}
    # n_test = 30; training shares 23.2 / 96.8 -> 23 / 97 -> test 6 / 24
    assert alloc == {1: 6, 0: 24}
    org = spark.createDataFrame([(i, 1 if i < 29 else 0) for i in range(150)], "k long, label int")
    sp = stratified_split(org, "k").collect()
    assert sum(r.is_test for r in sp) == 30
    assert sorted({r.fold for r in sp if not r.is_test}) == [0, 1, 2, 3, 4]


def test_t_test_zero_spread_is_infinite(spark):
    org = spark.createDataFrame([(True, 2.0), (True, 2.0), (False, 1.0), (False, 1.0)], "converted boolean, f double")
    r = stats.t_test(org, "f").first()
    assert r.t_statistic == float("inf")
    t = {x.test_id: x for x in stats.hypothesis_tests(org, [("t", "t", "f")]).collect()}
    assert t["t"].p_value == 0.0 and t["t"].significant


def test_running_totals_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", 3, 2)], "g string, o long, v long")
    out = {(r.g, r.o): r.before_v for r in running_totals(df, ["o"], ["v"], ["g"], slices=3).collect()}
    assert out == {(None, 1): 0, (None, 2): 5, ("a", 1): 0, ("a", 3): 1}


def test_u_test_survives_millions_of_ties(spark):
    # t * t * t of one value shared by 2.2 million organizations exceeds a long
    from pyspark.sql import functions as F

    org = spark.range(2_200_000).select((F.col("id") % 2 == 0).alias("converted"), F.lit(1.0).alias("f"))
    r = stats.mann_whitney_test(org, "f").first()
    assert r.n_converted == 1_100_000 and abs(r.tie_term / 2.2e6**3 - 1) < 1e-9
    assert stats.mann_whitney_tests(org, ["f"]).first().tie_term == r.tie_term


def test_medians_from_counts(spark):
    import statistics

    for conv, non in (([1, 2, 2, 9], [4]), ([3.5], [1, 8, 8, 2, 5]), ([1, 1, 1], [])):
        org = spark.createDataFrame([(True, float(x)) for x in conv] + [(False, float(x)) for x in non], "converted boolean, f double")
        r = stats.mann_whitney_test(org, "f").first()
        assert r.converted_median == statistics.median(conv)
        assert r.non_converted_median == (statistics.median(non) if non else None)


def test_following_and_minima_match_brute_force_with_hot_group(spark):
    rnd = random.Random(9)
    rows = [("hot", rnd.randint(0, 40), i, rnd.choice(["a", "b", None])) for i in range(500)]
    rows += [(rnd.choice(["x", "y", "z", None]), rnd.choice([None, *range(9)]), 1000 + i, rnd.choice("abc")) for i in range(60)]
    rows += [("alone", None, 5000, "a")]
    df = spark.createDataFrame(rows, "g string, o long, id long, v string").repartition(3)
    out = running_totals(df, ["o", "id"], [], ["g"], slices=7, minima=["o"], following=["v", "id"])
    assert out.columns == ["g", "o", "id", "v", "min_o", "next_v", "next_id", "has_next"]
    got = {r.id: (r.min_o, r.next_v, r.next_id, r.has_next) for r in out.collect()}
    expect = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        low = min((r[1] for r in mine if r[1] is not None), default=None)
        for r, after in zip(mine, [*mine[1:], None]):
            expect[r[2]] = (low, after and after[3], after and after[2], after is not None)
    assert got == expect


def test_cell_tests_count_the_empty_cells(spark):
    import statistics

    rnd = random.Random(2)
    classes = [(i, i % 3 == 0) for i in range(30)] + [(99, None)]
    cells = [(o, c, f"hour_{h}", rnd.randint(1, 4)) for o, c in classes for h in (1, 2, 5) if rnd.random() < 0.3] + [(0, True, "hour_9", 2)]
    got = {r.feature: r for r in stats.cell_t_tests(spark.createDataFrame(cells, "org long, converted boolean, feature string, n int"),
                                                    spark.createDataFrame(classes, "org long, converted boolean")).collect()}
    assert set(got) == {c[2] for c in cells}
    for f, r in got.items():
        n = {o: n for o, _, feature, n in cells if feature == f}
        a, b = ([n.get(o, 0) for o, c in classes if c is k] for k in (True, False))
        assert (r.n_converted, r.n_non_converted) == (10, 20) and abs(r.converted_mean - statistics.mean(a)) < 1e-12
        sp2 = ((len(a) - 1) * statistics.variance(a) + (len(b) - 1) * statistics.variance(b)) / 28
        assert abs(r.t_statistic - (statistics.mean(a) - statistics.mean(b)) / (sp2 * (1 / 10 + 1 / 20)) ** 0.5) < 1e-9
        assert 0 <= r.p_value <= 1


def test_rank_auc_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rnd = random.Random(5)
    rows = [(rnd.random() < 0.4, float(rnd.randint(0, 6))) for _ in range(120)]
    df = spark.createDataFrame(rows, "converted boolean, f double")
    auc = stats.rank_auc(df, ["f"]).first().auc
    assert abs(auc - _brute_u([x for c, x in rows if c], [x for c, x in rows if not c]) / (sum(c for c, _ in rows) * sum(not c for c, _ in rows))) < 1e-12
    label = df.selectExpr("CAST(converted AS double) AS label", "f")
    assert abs(auc - BinaryClassificationEvaluator(rawPredictionCol="f", labelCol="label", numBins=0).evaluate(label)) < 1e-9
    assert stats.rank_auc(df.where("converted"), ["f"]).first().auc is None


def test_logistic_coefficients_equal_the_library_fit(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from convlens.operators import models

    r = random.Random(4)
    rows = []
    for _ in range(300):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((a, b, a + 0.1 * r.gauss(0, 1), int(r.random() < 1 / (1 + math.exp(-(0.5 + 2 * a - b))))))
    df = spark.createDataFrame(rows, "a double, b double, c double, label int")
    got = models.logistic_coefficients(df.unionByName(df.select(F.lit(None).cast("double").alias("a"), "b", "c", "label")), ["a", "b", "c"]).collect()
    assert [x.term for x in got] == ["intercept", "a", "b", "c"]
    fit = LogisticRegression(featuresCol="f", labelCol="label", maxIter=1000, tol=1e-13, regParam=1.0 / len(rows), standardization=False).fit(
        VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df))
    for x, want in zip(got, [fit.intercept, *fit.coefficients]):
        assert abs(x.coefficient - want) < 1e-6 and abs(x.odds_ratio - math.exp(x.coefficient)) < 1e-9
    # classes that a feature separates have a finite fit; one class alone and no rows have none
    apart = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, label int")
    slope = models.logistic_coefficients(apart, ["x"]).collect()[1].coefficient
    assert 0.5 < slope < 5
    for frame in (apart.where("label = 1"), apart.limit(0)):
        assert [x.coefficient for x in models.logistic_coefficients(frame, ["x"]).collect()] == [None, None]
