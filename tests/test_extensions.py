import math
import statistics as S

from convlens.functions.categories import PRODUCT_CATEGORY_MAP
from convlens.operators import cohorts, features, stages, stats
from tests.helpers import log_df


def _feat(spark, rows):
    return features.activity_categories(features.temporal_features(log_df(spark, rows)), PRODUCT_CATEGORY_MAP)


def test_stage_features(spark):
    rows = [("a", "x", 1, False, None, 30), ("a", "x", 2, False, None, 30), ("a", "y", 15, False, None, 30),
            ("a", "x", 20, False, None, 30), ("b", "x", 1, True, 3, 30)]
    st = {r.ORGANIZATION_ID: r for r in stages.stage_features(_feat(spark, rows)).collect()}
    a = st["a"]
    assert (a.early_stage_count, a.late_stage_count, a.activities_both_stages) == (2, 2, 1)
    assert a.early_stage_share == 0.5 and a.early_late_ratio == 1.0 and a.balanced and not a.early_dominated
    b = st["b"]
    assert b.early_late_ratio is None and b.early_dominated and not b.late_engaged and b.converted is True
    ad = {(r.ORGANIZATION_ID, r.ACTIVITY_NAME): r for r in stages.activity_adoption(_feat(spark, rows)).collect()}
    assert ad[("a", "x")].intensity == 3 and ad[("a", "x")].both_stages and not ad[("a", "y")].early_adopted


def test_cohorts_and_time_to_conversion(spark):
    rows = [("a", "x", 1, True, 3.5, 30), ("b", "x", 1, False, None, 30), ("c", "x", 1, True, 10.2, 30)]
    log = log_df(spark, rows)
    c = cohorts.cohort_conversion(log, "month").first()
    assert (c.orgs, c.converted_orgs) == (3, 2) and str(c.cohort_start) == "2024-01-01"
    ttc = {r.days_to_conversion: r.orgs for r in cohorts.time_to_conversion(log).collect()}
    assert ttc == {3: 1, 10: 1}


def test_transitions_and_penetration(spark):
    rows = [("a", "x", 0.1, True, 9, 30, 1), ("a", "y", 0.2, True, 9, 30, 2), ("a", "x", 0.3, True, 9, 30, 3),
            ("a", "z", 9.5, True, 9, 30, 4),  # after conversion: not in the pre-conversion sequence
            ("b", "x", 0.1, False, None, 30, 5), ("b", "x", 0.2, False, None, 30, 6)]
    log = log_df(spark, rows)
    tr = {(r.ACTIVITY_NAME, r.next_activity): r.transitions for r in cohorts.activity_transitions(log).collect()}
    assert tr == {("x", "y"): 1, ("y", "x"): 1}
    pen = {(r.segment, r.ACTIVITY_NAME): r for r in cohorts.activity_penetration(log).collect()}
    assert pen[("not_converted", "x")].intensity == 2.0 and pen[("not_converted", "x")].penetration_pct == 100.0
    assert pen[("all_converted", "z")].orgs_using == 1


def test_t_tests_cohens_d_and_ks(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 9.0], [2.0, 4.0, 6.0, 6.5]
    org = spark.createDataFrame([(True, x) for x in a] + [(False, x) for x in b], "converted boolean, f double")
    r = stats.t_tests(org, ["f"]).first()
    sp2 = ((len(a) - 1) * S.variance(a) + (len(b) - 1) * S.variance(b)) / (len(a) + len(b) - 2)
    assert abs(r.cohens_d - (S.mean(a) - S.mean(b)) / math.sqrt(sp2)) < 1e-12
    ks = stats.ks_tests(org, ["f"]).first()
    grid = sorted(set(a + b))
    d = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in grid)
    assert abs(ks.d_statistic - d) < 1e-12 and 0.0 <= ks.p_value <= 1.0
    mw = stats.mann_whitney_tests(org, ["f"]).first()
    assert mw.u_statistic == sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)


def test_anova_matches_hand_computation(spark):
    groups = {True: [1.0, 2.0, 3.0], False: [4.0, 6.0, 8.0, 10.0]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g boolean, v double")
    r = stats.anova(df, "v", "g").first()
    allv = [x for xs in groups.values() for x in xs]
    gm = S.mean(allv)
    ssb = sum(len(xs) * (S.mean(xs) - gm) ** 2 for xs in groups.values())
    ssw = sum(sum((x - S.mean(xs)) ** 2 for x in xs) for xs in groups.values())
    f = (ssb / 1) / (ssw / (len(allv) - 2))
    assert abs(r.f_statistic - f) < 1e-9 and (r.df_between, r.df_within) == (1, 5) and 0 < r.p_value < 0.05


def test_adjust_p_values(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "test_id string, p_value double")
    r = {x.test_id: x for x in stats.adjust_p_values(t).collect()}
    assert r["a"].p_bonferroni == 0.04 and r["d"].p_bonferroni == 1.0
    # BH: sorted p = .01 .03 .04 .5 -> raw .04 .06 .0533 .5 -> step-up min: .04 .0533 .0533 .5
    assert abs(r["a"].p_fdr_bh - 0.04) < 1e-12 and abs(r["c"].p_fdr_bh - 0.04 * 4 / 3) < 1e-12
    assert abs(r["b"].p_fdr_bh - 0.04 * 4 / 3) < 1e-12 and r["d"].p_fdr_bh == 0.5


def test_adjusted_p_values_of_many_tests_with_ties_and_missing_ones(spark):
    import random

    rng = random.Random(9)
    ps = [rng.choice([None, 1.0, 0.0, round(rng.random() ** 4, 3)]) for _ in range(400)]
    got = {r.i: r for r in stats.adjust_p_values(spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    least = 1.0
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        least = min(least, p * len(known) / rank)
        assert abs(got[i].p_fdr_bh - least) < 1e-12 and got[i].p_bonferroni == min(1.0, p * len(known))
    assert all(got[i].p_fdr_bh is None and got[i].significant_fdr is None for i, p in enumerate(ps) if p is None)
    assert len(got) == 400 and stats.adjust_p_values(spark.createDataFrame([], "i int, p_value double")).collect() == []


def test_adoption_chi_square(spark):
    rows = ([(f"c{i}", "x", 1, True, 20, 30) for i in range(6)] + [(f"c{i}", "y", 1, True, 20, 30) for i in range(6, 10)]
            + [(f"n{i}", "x", 1, False, None, 30) for i in range(3)] + [(f"n{i}", "y", 1, False, None, 30) for i in range(3, 12)])
    r = {x.ACTIVITY_NAME: x for x in stats.adoption_chi_square(_feat(spark, rows), "ORGANIZATION_ID", "ACTIVITY_NAME",
                                                                "CONVERTED", "EVENT_ID").collect()}
    # activity x: used by 6 of 10 converted and 3 of 12 non-converted
    o = [[6, 4], [3, 9]]
    rt, ct, n = [10, 12], [9, 13], 22
    exp = sum((abs(o[i][j] - rt[i] * ct[j] / n) - 0.5) ** 2 / (rt[i] * ct[j] / n) for i in range(2) for j in range(2))
    assert r["x"].degrees_of_freedom == 1 and abs(r["x"].chi2_statistic - exp) < 1e-12


def test_stage_adoption_and_flag_tests_against_counts(spark):
    import itertools
    import random

    rng = random.Random(5)
    rows = [(f"o{o}", rng.choice("xyz"), rng.uniform(0, 29), o % 3 == 0, None, 30) for o in range(24) for _ in range(rng.randrange(1, 9))]
    rows += [("null activity", None, 1, True, None, 30), (None, "x", 1, True, None, 30)]
    feat = _feat(spark, rows)
    orgs = {r.ORGANIZATION_ID: r for r in stages.stage_features(feat).collect()}
    sizes = [sum(r.converted == v for r in orgs.values()) for v in (True, False)]
    used = {(r.ORGANIZATION_ID, r.ACTIVITY_NAME): r for r in stages.activity_adoption(feat).collect()}

    def chi2(a):
        table = [a, [sizes[0] - a[0], sizes[1] - a[1]]]
        n, total = sum(sizes), 0.0
        if not 0 < sum(a) < n:
            return 0.0
        for i, k in itertools.product(range(2), range(2)):
            e = sum(table[i]) * sizes[k] / n
            total += max(abs(table[i][k] - e) - 0.5, 0.0) ** 2 / e
        return total

    got = stages.stage_flag_tests(feat).collect()
    assert sorted(r.feature for r in got) == sorted(stages.STAGE_FLAGS)
    for r in got:
        a = [sum(o[r.feature] and o.converted == v for o in orgs.values()) for v in (True, False)]
        assert [r.converted_users, r.non_converted_users] == a and abs(r.chi2_statistic - chi2(a)) < 1e-9
        assert abs(r.p_value - (math.erfc(math.sqrt(r.chi2_statistic / 2)) if r.degrees_of_freedom else 1.0)) < 1e-9
    got = stages.stage_adoption_tests(feat).collect()
    assert len(got) == 3 * (len(stages.PATTERNS) + len(stages.COMBINED_PATTERNS))
    for r in got:
        flag = stages.COMBINED_PATTERNS.get(r.pattern)
        shown = [orgs[o].converted for (o, act), u in used.items() if act == r.ACTIVITY_NAME and (orgs[o][flag] if flag else u[r.pattern])]
        a = [shown.count(True), shown.count(False)]
        assert [r.converted_users, r.non_converted_users] == a and abs(r.chi2_statistic - chi2(a)) < 1e-9
    for r in stages.activity_intensity_tests(feat).collect():
        xs = [[used[o, r.feature].intensity if (o, r.feature) in used else 0 for o, x in orgs.items() if x.converted == v] for v in (True, False)]
        assert abs(r.converted_mean - S.mean(xs[0])) < 1e-9 and abs(r.non_converted_mean - S.mean(xs[1])) < 1e-9
        pooled = ((len(xs[0]) - 1) * S.variance(xs[0]) + (len(xs[1]) - 1) * S.variance(xs[1])) / (len(orgs) - 2)
        assert abs(r.t_statistic - (S.mean(xs[0]) - S.mean(xs[1])) / math.sqrt(pooled * (1 / len(xs[0]) + 1 / len(xs[1])))) < 1e-9


def test_stage_tests_of_an_empty_log(spark):
    feat = _feat(spark, [])
    assert stages.stage_adoption_tests(feat).collect() == [] and stages.activity_intensity_tests(feat).collect() == []
    assert [r.chi2_statistic for r in stages.stage_flag_tests(feat).collect()] == [0.0] * 4
