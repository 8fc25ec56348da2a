"""Invariants from the test plan: AUC equals U / (n1 n2); a hot organization
(a third of all rows) gives the same rollup as a brute-force computation."""

import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from convlens.functions.categories import PRODUCT_CATEGORY_MAP
from convlens.operators import clean, features, mart, stats
from tests.helpers import log_df


def test_auc_equals_u_over_n1n2(spark):
    rnd = random.Random(3)
    rows = [(bool(rnd.random() < 0.4), float(rnd.randint(0, 9))) for _ in range(80)]
    df = spark.createDataFrame(rows, "converted boolean, f double")
    u = stats.mann_whitney_test(df, "f").first()
    pred = spark.createDataFrame([(Vectors.dense([-s, s]), 1.0 if c else 0.0) for c, s in rows],
                                 ["rawPrediction", "label"])
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(pred)
    assert abs(auc - u.u_statistic / (u.n_converted * u.n_non_converted)) < 1e-12


def test_hot_org_rollups_match_brute_force(spark):
    rnd = random.Random(11)
    rows, eid = [], 0
    for org, n in [("hot", 900)] + [(f"o{i}", rnd.randint(5, 60)) for i in range(40)]:
        conv = rnd.random() < 0.3
        for _ in range(n):
            d = rnd.uniform(-2, 31)
            rows.append((org, rnd.choice(["PunchClock.PunchedIn", "Absence.Request.Created", "Z"]), d, conv,
                         15 if conv else None, 30, eid))
            eid += 1
    # duplicate copies of the hot org's first 300 rows, appended later in input order
    rows += [(o, a, d, c, cd, du, 10_000 + i) for i, (o, a, d, c, cd, du, _) in enumerate(rows[:300])]
    log = log_df(spark, rows)
    dedup = clean.drop_duplicate_events(log)
    assert dedup.count() == eid
    st = {r.org_id: r for r in mart.staging_metrics(mart.prepare_log(dedup)).collect()}
    hot_days = [int((d // 1)) for o, a, d, *_ in rows[:eid] if o == "hot"]
    weeks = [min(max(d // 7 + 1, 1), 4) for d in hot_days]
    assert st["hot"].total_activities == 900
    assert [st["hot"][f"week{w}_activities"] for w in (1, 2, 3, 4)] == [weeks.count(w) for w in (1, 2, 3, 4)]
    feat = features.activity_categories(features.temporal_features(dedup), PRODUCT_CATEGORY_MAP)
    org = {r.ORGANIZATION_ID: r for r in features.org_features(feat).collect()}
    assert org["hot"].days_active == len(set(hot_days))
    assert org["hot"].week1_activity_count == sum(1 for d in hot_days if d < 7)
