"""Hypothesis tests on the org feature table, converted vs not.

Counts, sums, moments and ranks are Spark aggregates; the result of each test
is one row.  Ranks for the U test come from counts per distinct value and a
range-partitioned running total (``functions.ordered``), never from a global
window over all rows.  The tail probability is added by ``hypothesis_tests``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.distributions import f_sf_udf, kolmogorov_sf_udf, p_value_udf
from convlens.functions.ordered import running_totals
from convlens.session import materialize

SIGNIFICANCE = 0.05
# Fixed value: with method "auto" the U test's tail is exact if a sample has at
# most this many values and there are no ties, else asymptotic.
EXACT_MAX_SAMPLE = 8


def _conv(group_col: str):
    return F.col(group_col) == True  # noqa: E712


def _non(group_col: str):
    return F.col(group_col) == False  # noqa: E712


def contingency_table(org_table: DataFrame, feature: str, group_col: str = "converted") -> DataFrame:
    """Counts per feature value (rows) and group (columns ``converted`` /
    ``non_converted``), zeros filled: a pivot on the two known group values,
    so no cross join is needed to complete the grid."""
    t = org_table.filter(F.col(group_col).isNotNull()).groupBy(F.col(feature).alias("value")).pivot(
        group_col, [True, False]).count()
    return t.select("value", F.coalesce(F.col("true"), F.lit(0)).alias("converted"),
                    F.coalesce(F.col("false"), F.lit(0)).alias("non_converted"))


def chi_square_test(org_table: DataFrame, feature: str, group_col: str = "converted", correction: bool = True) -> DataFrame:
    """Pearson chi-square of group x feature value with Yates' correction when
    the table has one degree of freedom.  A table with one non-empty row or
    column has dof 0 and statistic 0."""
    ct = contingency_table(org_table, feature, group_col)
    # one scalar subquery (a struct) for all three totals, projected into
    # columns once so the cell expressions below refer to plain columns
    tot = ct.agg(F.struct(F.sum("converted").alias("r1"), F.sum("non_converted").alias("r0"),
                          F.count(F.lit(1)).alias("c"))).scalar()
    ct = ct.select("*", tot.alias("_tot")).select("*", F.col("_tot.r1").alias("_r1"), F.col("_tot.r0").alias("_r0"),
                                                  F.col("_tot.c").alias("_nc")).drop("_tot")
    r1, r0, ncols = F.col("_r1"), F.col("_r0"), F.col("_nc")
    n = r1 + r0
    nrows = (F.when(r1 > 0, 1).otherwise(0) + F.when(r0 > 0, 1).otherwise(0))
    dof = ((nrows - 1) * (ncols - 1)).cast("long")
    col_total = F.col("converted") + F.col("non_converted")

    def term(obs, row_total):
        e = row_total * col_total / n
        dev = F.abs(F.col(obs) - e)
        if correction:
            dev = F.when(dof == 1, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
        return F.when(row_total > 0, dev * dev / e).otherwise(F.lit(0.0))

    stat = ct.groupBy("_r1", "_r0", "_nc").agg(F.sum(term("converted", r1) + term("non_converted", r0)).alias("s"))
    return stat.select(
        F.lit(feature).alias("feature"),
        F.when(dof > 0, F.col("s")).otherwise(F.lit(0.0)).alias("chi2_statistic"),
        dof.alias("degrees_of_freedom"),
        n.cast("long").alias("n_orgs"),
        (F.lit(correction) & (dof == 1)).alias("yates_correction"),
    )


def _t_value(dof, se):
    """(m1 - m2) / se; with zero spread the difference of means decides the
    sign of an infinite t (equal means: undefined), without dividing by 0."""
    diff = F.col("m1") - F.col("m2")
    return (F.when((dof > 0) & (se > 0), diff / se)
            .when((dof > 0) & (se == 0) & (diff > 0), F.lit(float("inf")))
            .when((dof > 0) & (se == 0) & (diff < 0), F.lit(float("-inf"))))


def t_test(org_table: DataFrame, feature: str, group_col: str = "converted") -> DataFrame:
    """Two-sample Student t with pooled variance (converted minus not)."""
    x = F.col(feature).cast("double")
    one = org_table.agg(
        F.count(F.when(_conv(group_col), x)).alias("n1"), F.count(F.when(_non(group_col), x)).alias("n2"),
        F.avg(F.when(_conv(group_col), x)).alias("m1"), F.avg(F.when(_non(group_col), x)).alias("m2"),
        F.var_samp(F.when(_conv(group_col), x)).alias("v1"), F.var_samp(F.when(_non(group_col), x)).alias("v2"),
    )
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return one.select(
        F.lit(feature).alias("feature"),
        _t_value(dof, se).alias("t_statistic"),
        dof.cast("long").alias("degrees_of_freedom"),
        F.col("m1").alias("converted_mean"), F.col("m2").alias("non_converted_mean"),
        F.col("n1").alias("n_converted"), F.col("n2").alias("n_non_converted"),
    )


def _with_p(df: DataFrame, kind: str, statistic: str, dof: str | None = None, tie: str | None = None) -> DataFrame:
    """Add ``p_value``; U tests take the asymptotic tail."""
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    n1, n2 = (F.col("n_converted"), F.col("n_non_converted")) if kind == "mwu" else (zero, zero)
    return df.withColumn("p_value", p_value_udf(
        F.lit(kind), F.col(statistic), F.col(dof).cast("double") if dof else none, n1, n2,
        F.col(tie) if tie else F.lit(0.0), F.lit(False)))


def _cubes(t):
    """t**3 - t in doubles: the cube of a long overflows from 2 097 152 on."""
    t = t.cast("double")
    return t * t * t - t


def mann_whitney_test(org_table: DataFrame, feature: str, group_col: str = "converted", method: str = "auto") -> DataFrame:
    """Mann-Whitney U of the converted sample (average ranks for ties), with
    the tie term and the group medians, all from the counts per distinct value.
    ``method``: how the tail is to be computed, ``exact``, ``asymptotic`` or
    ``auto`` (see ``EXACT_MAX_SAMPLE``)."""
    if method not in ("auto", "exact", "asymptotic"):
        raise ValueError(f"unknown method {method!r}")
    x = F.col(feature).cast("double")
    clean = org_table.filter(F.col(group_col).isNotNull() & x.isNotNull())
    by_value = clean.groupBy(x.alias("value")).agg(
        F.count_if(_conv(group_col)).alias("t1"), F.count_if(_non(group_col)).alias("t2"))
    by_value = by_value.withColumn("t", F.col("t1") + F.col("t2"))
    ranked = running_totals(by_value, ["value"], ["t", "t1", "t2"])
    size = ranked.agg(F.struct(F.sum("t1").alias("t1"), F.sum("t2").alias("t2"))).scalar()
    ranked = ranked.select("*", size.alias("_size"))

    def at(c, place):
        return F.max(F.when((F.col(f"before_{c}") <= place) & (place < F.col(f"before_{c}") + F.col(c)), F.col("value")))

    def median(c):
        return (at(c, F.expr(f"(_size.{c} - 1) div 2")) + at(c, F.expr(f"_size.{c} div 2"))) / 2.0

    avg_rank = F.col("before_t") + (F.col("t") + 1) / 2.0
    one = ranked.agg(
        F.sum(F.col("t1") * avg_rank).alias("r1"),
        F.sum("t1").alias("n1"), F.sum("t2").alias("n2"),
        F.sum(_cubes(F.col("t"))).alias("tie_term"),
        F.max("t").alias("max_tie"),
        median("t1").alias("med1"), median("t2").alias("med2"),
    )
    n1, n2 = F.coalesce(F.col("n1"), F.lit(0)).cast("long"), F.coalesce(F.col("n2"), F.lit(0)).cast("long")
    pairs = n1.cast("double") * n2
    u1 = F.col("r1") - n1.cast("double") * (n1 + 1) / 2.0
    n = (n1 + n2).cast("double")
    var = pairs / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1)))
    u = F.greatest(u1, pairs - u1)
    exact = {"exact": F.lit(True), "asymptotic": F.lit(False),
             "auto": (F.coalesce(F.col("max_tie"), F.lit(1)) <= 1) & (F.least(n1, n2) <= EXACT_MAX_SAMPLE)}[method]
    return one.select(
        F.lit(feature).alias("feature"),
        u1.alias("u_statistic"),
        n1.alias("n_converted"), n2.alias("n_non_converted"),
        F.col("r1").alias("rank_sum_converted"),
        F.coalesce(F.col("tie_term"), F.lit(0)).cast("double").alias("tie_term"),
        F.when(var > 0, (u - pairs / 2.0 - 0.5) / F.sqrt(var)).alias("z_statistic"),
        exact.alias("exact"),
        F.col("med1").alias("converted_median"),
        F.col("med2").alias("non_converted_median"),
    )


# The four tests of the conversion-driver analysis.
DEFAULT_TESTS = [
    ("week1_engagement_chi2", "chi2", "week1_engagement_binary"),
    ("week1_ratio_ttest", "t", "week1_activity_ratio"),
    ("total_activities_mannwhitney", "mwu", "total_activities_count"),
    ("categories_mannwhitney", "mwu", "unique_categories_count"),
]
TEST_NAMES = {"chi2": "Chi-square test", "t": "Independent t-test", "mwu": "Mann-Whitney U test"}


def hypothesis_tests(org_table: DataFrame, tests: list[tuple[str, str, str]] | None = None,
                     group_col: str = "converted", alpha: float = SIGNIFICANCE, method: str = "auto") -> DataFrame:
    """One row per test: id, test name, feature, statistic, dof, p-value,
    significance at ``alpha``."""
    rows = []
    for test_id, kind, feature in tests or DEFAULT_TESTS:
        if kind == "chi2":
            r = chi_square_test(org_table, feature, group_col).select(
                F.col("chi2_statistic").alias("statistic"), F.col("degrees_of_freedom").cast("double").alias("dof"),
                F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"),
                F.lit(0.0).alias("tie"), F.lit(False).alias("exact"))
        elif kind == "t":
            r = t_test(org_table, feature, group_col).select(
                F.col("t_statistic").alias("statistic"), F.col("degrees_of_freedom").cast("double").alias("dof"),
                F.col("n_converted").alias("n1"), F.col("n_non_converted").alias("n2"),
                F.lit(0.0).alias("tie"), F.lit(False).alias("exact"))
        else:
            r = mann_whitney_test(org_table, feature, group_col, method).select(
                F.col("u_statistic").alias("statistic"), F.lit(None).cast("double").alias("dof"),
                F.col("n_converted").alias("n1"), F.col("n_non_converted").alias("n2"),
                F.col("tie_term").alias("tie"), F.col("exact"))
        rows.append(r.select(F.lit(test_id).alias("test_id"), F.lit(TEST_NAMES[kind]).alias("test"),
                             F.lit(kind).alias("kind"), F.lit(feature).alias("feature"), "*"))
    allr = rows[0]
    for r in rows[1:]:
        allr = allr.unionByName(r)
    p = p_value_udf(F.col("kind"), F.col("statistic"), F.col("dof"), F.col("n1"), F.col("n2"), F.col("tie"), F.col("exact"))
    out = allr.withColumn("p_value", p)
    return out.select("test_id", "test", "feature", "statistic", F.col("dof").alias("degrees_of_freedom"), "p_value",
                      (F.col("p_value") < alpha).alias("significant"))


def tests_summary(tests: DataFrame) -> DataFrame:
    return tests.agg(F.count(F.lit(1)).alias("tests_performed"),
                     F.count_if(F.coalesce(F.col("significant"), F.lit(False))).alias("significant_tests"))


# --------------------------------------------------------------------------
# Tests named by the analysis plan (X12-X17, X22).  The same operators as
# above, run for many features or activities at once: the features are
# unpivoted AFTER the org rollup and every test is one grouped aggregation.
# --------------------------------------------------------------------------

def _long(org_table: DataFrame, features: list[str], group_col: str) -> DataFrame:
    return org_table.select(group_col, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))


def t_tests(org_table: DataFrame, features: list[str], group_col: str = "converted") -> DataFrame:
    """Pooled t statistic and Cohen's d for every feature, one
    grouped aggregation over the unpivoted features."""
    x = F.col("value")
    g = _long(org_table, features, group_col).groupBy("feature").agg(
        F.count(F.when(_conv(group_col), x)).alias("n1"), F.count(F.when(_non(group_col), x)).alias("n2"),
        F.avg(F.when(_conv(group_col), x)).alias("m1"), F.avg(F.when(_non(group_col), x)).alias("m2"),
        F.var_samp(F.when(_conv(group_col), x)).alias("v1"), F.var_samp(F.when(_non(group_col), x)).alias("v2"))
    return _t_from_moments(g)


def _t_from_moments(g: DataFrame) -> DataFrame:
    """The t test of every row (feature, n1, n2, m1, m2, v1, v2)."""
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    se = F.sqrt(sp2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    tests = g.select(
        "feature",
        _t_value(dof, se).alias("t_statistic"),
        dof.cast("long").alias("degrees_of_freedom"),
        F.when((dof > 0) & (sp2 > 0), (F.col("m1") - F.col("m2")) / F.sqrt(sp2)).alias("cohens_d"),
        F.col("m1").alias("converted_mean"), F.col("m2").alias("non_converted_mean"),
        F.col("n1").alias("n_converted"), F.col("n2").alias("n_non_converted"))
    return _with_p(tests, "t", "t_statistic", "degrees_of_freedom")


def cell_t_tests(cells: DataFrame, org_classes: DataFrame, group_col: str = "converted") -> DataFrame:
    """T tests of counts per org in many cells (hours, weekdays, days) of which
    most are empty.  ``cells`` has a row (org class, feature, n) for each org and
    cell that exist; the zeros of all other orgs enter through the number of
    orgs alone (``org_classes`` has a row for each org) and are never written."""
    sizes = org_classes.agg(F.struct(F.count_if(_conv(group_col)).alias("n1"), F.count_if(_non(group_col)).alias("n2"))).scalar()
    n = F.col("n").cast("long")
    sums = cells.groupBy("feature").agg(*[
        F.coalesce(F.sum(F.when(test(group_col), x)), F.lit(0)).alias(f"{name}{k}")
        for k, test in ((1, _conv), (2, _non)) for name, x in (("s", n), ("q", n * n))])

    def moments(k: int):
        size = sizes.getField(f"n{k}")
        # from exact integer sums, so that a cell without spread has none
        wide = {x: F.col(f"{x}{k}").cast("decimal(19,0)") for x in "sq"}
        spread = (size.cast("decimal(19,0)") * wide["q"] - wide["s"] * wide["s"]).cast("double") / (size * (size - 1))
        return [size.alias(f"n{k}"), F.when(size > 0, F.col(f"s{k}") / size).alias(f"m{k}"), F.when(size > 1, spread).alias(f"v{k}")]

    return _t_from_moments(sums.select("feature", *moments(1), *moments(2)))


def rank_auc(scores: DataFrame, features: list[str], label_col: str = "converted") -> DataFrame:
    """M7: the area under the ROC curve of each feature taken as a score of
    conversion: U / (n1 * n2), which counts ties by half."""
    u = mann_whitney_tests(scores, features, label_col)
    pairs = F.col("n_converted") * F.col("n_non_converted")
    return u.select("feature", F.when(pairs > 0, F.col("u_statistic") / pairs).alias("auc"), "n_converted", "n_non_converted")


def _value_counts_by_feature(org_table: DataFrame, features: list[str], group_col: str) -> DataFrame:
    long = _long(org_table, features, group_col).filter(F.col(group_col).isNotNull() & F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count_if(_conv(group_col)).alias("t1"),
                                                F.count_if(_non(group_col)).alias("t2")) \
        .withColumn("t", F.col("t1") + F.col("t2"))


def mann_whitney_tests(org_table: DataFrame, features: list[str], group_col: str = "converted") -> DataFrame:
    """U statistic, tie term and z for every feature (ranks per feature
    from running totals grouped by feature)."""
    ranked = running_totals(_value_counts_by_feature(org_table, features, group_col), ["value"], ["t"], ["feature"])
    avg_rank = F.col("before_t") + (F.col("t") + 1) / 2.0
    one = ranked.groupBy("feature").agg(
        F.sum(F.col("t1") * avg_rank).alias("r1"), F.sum("t1").cast("long").alias("n1"),
        F.sum("t2").cast("long").alias("n2"),
        F.sum(_cubes(F.col("t"))).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1)))
    u = F.greatest(u1, n1 * n2 - u1)
    tests = one.select("feature", u1.alias("u_statistic"), F.col("n1").alias("n_converted"),
                       F.col("n2").alias("n_non_converted"), "tie_term",
                       F.when(var > 0, (u - n1 * n2 / 2.0 - 0.5) / F.sqrt(var)).alias("z_statistic"))
    return _with_p(tests, "mwu", "u_statistic", tie="tie_term")


def ks_tests(org_table: DataFrame, features: list[str], group_col: str = "converted", with_p: bool = True) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D = max |F1 - F2| per feature, from
    inclusive running totals over the distinct values, and its asymptotic
    p-value (Kolmogorov distribution of sqrt(n1 n2 / (n1 + n2)) D)."""
    vc = _value_counts_by_feature(org_table, features, group_col)
    cum = running_totals(vc, ["value"], ["t1", "t2"], ["feature"], inclusive=True, prefix="cum_")
    totals = vc.groupBy("feature").agg(F.sum("t1").alias("n1"), F.sum("t2").alias("n2"))
    d = cum.join(totals, "feature").groupBy("feature").agg(
        F.max(F.abs(F.col("cum_t1") / F.col("n1") - F.col("cum_t2") / F.col("n2"))).alias("d_statistic"),
        F.first("n1").cast("long").alias("n_converted"), F.first("n2").cast("long").alias("n_non_converted"))
    if not with_p:
        return d
    en = F.sqrt(F.col("n_converted").cast("double") * F.col("n_non_converted") / (F.col("n_converted") + F.col("n_non_converted")))
    return d.withColumn("p_value", kolmogorov_sf_udf(en * F.col("d_statistic")))


def adoption_chi_square(feature_log: DataFrame, org_col: str, activity_col: str, converted_col: str,
                        order_col: str | None = None, correction: bool = True) -> DataFrame:
    """For every activity, chi-square of (used it / did not) x converted
    over all orgs, with Yates on the 2x2 table, and its p-value.  The log is read
    once, into a row per (org, activity); orgs, class sizes (a struct scalar) and
    counts per activity come from that table."""
    order = F.col(order_col) if order_col else F.lit(0)
    pairs = materialize(feature_log.filter(F.col(org_col).isNotNull()).groupBy(org_col, activity_col).agg(
        F.min_by(F.col(converted_col), order).alias("_first"), F.min(order).alias("_at")), "org_activity")
    orgs = pairs.groupBy(org_col).agg(F.min_by("_first", "_at").alias("_c"))
    used = pairs.select(org_col, activity_col).join(orgs, org_col)
    per = used.groupBy(activity_col).agg(F.count_if(_conv("_c")).alias("a_c"), F.count_if(_non("_c")).alias("a_n"))
    return chi_square_of_counts(per, [activity_col], class_sizes(orgs, "_c"), correction)


def class_sizes(org_table: DataFrame, group_col: str = "converted"):
    """The number of converted (``c``) and other (``n``) orgs, a struct scalar."""
    return org_table.agg(F.struct(F.count_if(_conv(group_col)).alias("c"), F.count_if(_non(group_col)).alias("n"))).scalar()


def flag_chi_square(org_table: DataFrame, flags: list[str], group_col: str = "converted", correction: bool = True) -> DataFrame:
    """Chi-square of each boolean column x converted, all from one aggregate
    that is unpivoted after it.  A null flag counts as not set."""
    one = org_table.agg(F.count_if(_conv(group_col)).alias("c"), F.count_if(_non(group_col)).alias("n"), *[
        F.count_if(F.col(f) & test(group_col)).alias(f"{tag}{i}") for i, f in enumerate(flags) for tag, test in (("c", _conv), ("n", _non))])
    per = one.select(F.struct("c", "n").alias("sizes"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("a_c"), F.col(f"n{i}").alias("a_n")) for i, f in enumerate(flags)])))
    return chi_square_of_counts(per, ["feature"], F.col("sizes"), correction)


def chi_square_of_counts(per: DataFrame, keys: list[str], sizes, correction: bool = True) -> DataFrame:
    """Chi-square of each row's 2x2 table, with Yates' correction, and its p-value:
    ``a_c`` and ``a_n`` orgs of the classes show what the row stands for, of ``sizes.c`` and ``sizes.n``."""
    per = per.select(*keys, "a_c", "a_n", sizes.alias("_cls")).select("*", F.col("_cls.c").alias("_ct"), F.col("_cls.n").alias("_nt"))
    c_tot, n_tot = F.col("_ct"), F.col("_nt")
    N = c_tot + n_tot
    cells = [("a_c", F.col("a_c"), c_tot), ("a_n", F.col("a_n"), n_tot),
             ("b_c", c_tot - F.col("a_c"), c_tot), ("b_n", n_tot - F.col("a_n"), n_tot)]
    used_tot = F.col("a_c") + F.col("a_n")
    col_tot = {"a": used_tot, "b": N - used_tot}
    n_rows = F.when(c_tot > 0, 1).otherwise(0) + F.when(n_tot > 0, 1).otherwise(0)
    n_cols = F.when(used_tot > 0, 1).otherwise(0) + F.when(N - used_tot > 0, 1).otherwise(0)
    dof = ((n_rows - 1) * (n_cols - 1)).cast("long")
    stat = F.lit(0.0)
    for name, obs, row_tot in cells:
        e = row_tot * col_tot[name[0]] / F.nullif(N, F.lit(0))
        dev = F.abs(obs - e)
        if correction:
            dev = F.when(dof == 1, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
        stat = stat + F.when(e > 0, dev * dev / e).otherwise(F.lit(0.0))
    tests = per.select(*keys, F.col("a_c").alias("converted_users"), F.col("a_n").alias("non_converted_users"),
                       F.when(dof > 0, stat).otherwise(F.lit(0.0)).alias("chi2_statistic"),
                       dof.alias("degrees_of_freedom"))
    return _with_p(tests, "chi2", "chi2_statistic", "degrees_of_freedom")


def anova(df: DataFrame, value_col: str, group_col: str, with_p: bool = True) -> DataFrame:
    """One-way ANOVA F of ``value_col`` across ``group_col`` from group
    counts, means and variances (one grouped aggregation, then one row)."""
    x = F.col(value_col).cast("double")
    g = df.filter(x.isNotNull() & F.col(group_col).isNotNull()).groupBy(group_col).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    tot = g.agg(F.struct(F.sum("n").alias("N"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
                         F.count(F.lit(1)).alias("k"))).scalar()
    out = g.agg(F.sum(F.col("n") * (F.col("m") - tot.getField("gm")) ** 2).alias("ssb"),
                F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"))
    k, N = tot.getField("k"), tot.getField("N")
    df_b, df_w = (k - 1).cast("long"), (N - k).cast("long")
    f = F.when((df_b > 0) & (df_w > 0) & (F.col("ssw") > 0), (F.col("ssb") / df_b) / (F.col("ssw") / df_w))
    res = out.select(F.lit(value_col).alias("feature"), f.alias("f_statistic"), df_b.alias("df_between"),
                     df_w.alias("df_within"), "ssb", "ssw")
    if not with_p:
        return res
    return res.withColumn(
        "p_value", f_sf_udf(F.col("f_statistic"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def adjust_p_values(tests: DataFrame, p_col: str = "p_value", alpha: float = SIGNIFICANCE) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg adjusted p-values over a table of test
    results of any length: ranks are running counts over the distinct p-values, and
    the step-up minimum is carried down the same order, slice by slice.  Equal
    p-values get equal results; a missing one stays missing and counts for none."""
    tests = materialize(tests, "tests")
    p = F.col(p_col)
    m = tests.agg(F.count(p)).scalar()
    upto = running_totals(tests.filter(p.isNotNull()).groupBy(p.alias("_p")).agg(F.count(F.lit(1)).alias("_n")), ["_p"], ["_n"], inclusive=True, prefix="_upto")
    step = running_totals(upto.select("_p", (F.col("_p") * m / F.col("_upto_n")).alias("_raw")), [F.col("_p").desc()], [], lows=["_raw"])
    out = tests.join(step.select("_p", "low__raw"), p == F.col("_p"), "left")
    # least() skips nulls: keep a missing p-value missing
    out = out.withColumn("p_bonferroni", F.when(p.isNotNull(), F.least(p * m, F.lit(1.0)))).withColumn(
        "p_fdr_bh", F.when(p.isNotNull(), F.least(F.col("low__raw"), F.lit(1.0))))
    return out.withColumn("significant_bonferroni", F.col("p_bonferroni") < alpha).withColumn(
        "significant_fdr", F.col("p_fdr_bh") < alpha).drop("_p", "low__raw")
