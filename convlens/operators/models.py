"""Conversion models on the org feature table (Spark ML).

* Stratified split and folds: inside each class the orgs are ordered by a
  seeded md5 of the key and numbered with range-partitioned running totals
  (no global window); each class's test share follows the stratified
  allocation of ``class_allocation``, the rest are dealt round-robin into
  folds.  Deterministic and exact.
* Logistic regression: L2, C = 1 expressed as regParam = 1 / n_train on the
  standardized features (scaler fit on the training rows only).
* Random forest: 100 trees, depth 5, seed 42, unscaled features.
* AUC from ``BinaryClassificationEvaluator`` without binning.
Only model summaries (a few numbers per model) reach the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.ordered import position_in_group
from convlens.session import materialize

# Model features, seed, split and folds of the conversion models.
MODEL_FEATURES = ["total_activities_count", "unique_activities_count", "unique_categories_count",
                  "activities_per_day", "days_active", "week1_activity_count", "week1_activity_ratio",
                  "front_loaded_pattern", "week1_engagement_binary"]
SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5
LR_MAX_ITER = 1000
RF_TREES = 100
RF_DEPTH = 5


def class_allocation(labels: DataFrame, label_col: str = "label", test_fraction: float = TEST_FRACTION) -> DataFrame:
    """Test rows per class for a stratified split: ``n_test = ceil(f * n)``;
    each class gets the floor of its share of the ``n - n_test`` training rows,
    the rows still missing go to the classes with the largest fractional
    parts (ties to the lower label), and the rest of each class is its test
    share.  Windows over the class-size table (one row per label)."""
    sizes = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n_class"))
    everything = Window.partitionBy()  # one row per label: bounded
    n = F.sum("_n_class").over(everything)
    n_train = n - F.ceil(n * F.lit(test_fraction))
    cont = F.col("_n_class") / n * n_train
    with_share = sizes.select(label_col, "_n_class", cont.alias("_cont"), n_train.alias("_n_train"))
    with_share = with_share.select("*", F.floor("_cont").alias("_floor"), (F.col("_cont") - F.floor("_cont")).alias("_rem"))
    need = F.col("_n_train") - F.sum("_floor").over(everything)
    rank = F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label_col)))
    train = F.col("_floor") + F.when(rank <= need, 1).otherwise(0)
    return with_share.select(label_col, "_n_class", (F.col("_n_class") - train).cast("long").alias("_n_test"))


def stratified_split(org_table: DataFrame, key_col: str, label_col: str = "label", test_fraction: float = TEST_FRACTION,
                     folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` and ``fold`` (0..folds-1 for training rows, -1 test)."""
    keyed = org_table.withColumn("_h", F.md5(F.concat(F.col(key_col).cast("string"), F.lit(f":{seed}"))))
    pos = position_in_group(keyed, [label_col], ["_h", key_col], "_pos")
    # at most one row per class label: a proven-small broadcast side
    out = pos.join(F.broadcast(class_allocation(org_table.select(label_col), label_col, test_fraction)), label_col)
    is_test = F.col("_pos") < F.col("_n_test")
    return out.select(*org_table.columns, is_test.alias("is_test"),
                      F.when(is_test, F.lit(-1)).otherwise(((F.col("_pos") - F.col("_n_test")) % folds).cast("int")).alias("fold"))


def _auc(pred: DataFrame, label_col: str) -> float:
    ev = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol=label_col,
                                       metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(pred))


def _std0(xs: list[float]) -> float:
    m = sum(xs) / len(xs)
    return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


MODEL_KINDS = ("logistic_regression", "random_forest")
EXTRA_MODEL_KINDS = ("decision_tree", "gradient_boosted_trees")
GBT_ITERATIONS = 50


def _estimator(kind: str, n_fit: int, seed: int):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
    if kind == "logistic_regression":
        return LogisticRegression(featuresCol="features", labelCol="label", maxIter=LR_MAX_ITER,
                                  regParam=1.0 / max(n_fit, 1), elasticNetParam=0.0, standardization=False,
                                  fitIntercept=True)
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="raw_features", labelCol="label", numTrees=RF_TREES,
                                      maxDepth=RF_DEPTH, seed=seed)
    if kind == "decision_tree":
        return DecisionTreeClassifier(featuresCol="raw_features", labelCol="label", maxDepth=RF_DEPTH, seed=seed)
    if kind == "gradient_boosted_trees":
        return GBTClassifier(featuresCol="raw_features", labelCol="label", maxDepth=RF_DEPTH, maxIter=GBT_ITERATIONS,
                             seed=seed)
    raise ValueError(kind)


def _weights(kind: str, model) -> list[float]:
    if kind == "logistic_regression":
        return list(model.coefficients)
    return list(model.featureImportances.toArray())


def _prepared(org_table: DataFrame, key_col: str, features: list[str], converted_col: str, seed: int):
    """Train and test rows with ``raw_features`` and ``features`` (scaled by the
    training rows' mean and population deviation), the two scalers and the folds' sizes."""
    data = org_table.select(key_col, *[F.col(f).cast("double").alias(f) for f in features],
                            F.col(converted_col).cast("int").alias("label")).na.fill(0.0, subset=features)
    data = materialize(stratified_split(data, key_col, "label", seed=seed), "model_split", per_org=True)
    assembled = VectorAssembler(inputCols=features, outputCol="raw_features").transform(data)
    train = assembled.filter(~F.col("is_test"))
    test = assembled.filter(F.col("is_test"))
    scaler = StandardScaler(inputCol="raw_features", outputCol="sample_scaled", withMean=True, withStd=True).fit(train)
    fold_sizes = {r["fold"]: int(r["n"]) for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train = sum(fold_sizes.values())
    # the scaler divides by the sample deviation; the model's inputs have population deviation 1
    to_population = ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(n_train / max(n_train - 1, 1))] * len(features)),
                                       inputCol="sample_scaled", outputCol="features")
    train_s, test_s = (to_population.transform(scaler.transform(part)) for part in (train, test))
    return train_s, test_s, scaler, to_population, fold_sizes


def model_inputs(org_table: DataFrame, key_col: str, features: list[str] | None = None, converted_col: str = "converted",
                 seed: int = SEED) -> DataFrame:
    """M1, M3: what the models are fitted on and scored with: key, label, ``is_test``, ``fold`` and the scaled features."""
    features = features or MODEL_FEATURES
    train, test, *_ = _prepared(org_table, key_col, features, converted_col, seed)
    x = vector_to_array("features")
    return train.unionByName(test).select(key_col, "label", "is_test", "fold", *[x[i].alias(f) for i, f in enumerate(features)])


def logistic_coefficients(inputs: DataFrame, features: list[str], label_col: str = "label", ridge: float = 1.0,
                          tolerance: float = 1e-10, max_rounds: int = 50) -> DataFrame:
    """M4: logistic regression by iteratively reweighted least squares: one row
    per term (``intercept`` first) with its coefficient and odds ratio.

    Minimizes the summed log loss plus ``ridge / 2`` times the squared coefficients
    (not the intercept's).  A round is one aggregate of the rows into the normal equations,
    (terms + 1) ** 2 / 2 sums, of which the driver solves the small system; a step that
    raises the loss is halved.  Rows with a null label or feature are left out; without rows of
    both classes the coefficients are null."""
    import numpy as np

    used = inputs.select(*[F.col(f).cast("double").alias(f"x{i + 1}") for i, f in enumerate(features)],
                         F.col(label_col).cast("double").alias("y")).na.drop()
    used = materialize(used.withColumn("x0", F.lit(1.0)), "logistic_rows", per_org=True)
    d = len(features) + 1
    x = [F.col(f"x{i}") for i in range(d)]
    penalty = np.diag([0.0] + [float(ridge)] * (d - 1))

    def equations(beta):
        z = sum((x[i] * F.lit(float(beta[i])) for i in range(1, d)), F.lit(float(beta[0])))
        loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("y") * z
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
        rows = used.select("*", z.alias("z"), loss.alias("loss")).withColumn("r", F.col("y") - p).withColumn("w", p * (F.lit(1.0) - p))
        sums = rows.agg(F.sum("loss"), *[F.sum(F.col("r") * x[i]) for i in range(d)],
                        *[F.sum(F.col("w") * x[i] * x[j]) for i in range(d) for j in range(i, d)]).first()
        hessian = np.zeros((d, d))
        hessian[np.triu_indices(d)] = sums[1 + d:]
        hessian = hessian + np.triu(hessian, 1).T + penalty
        return sums[0] + beta @ penalty @ beta / 2, np.array(sums[1:1 + d]) - penalty @ beta, hessian

    schema = "term string, coefficient double, odds_ratio double"
    terms = ["intercept", *features]
    classes = used.agg(F.min("y"), F.max("y")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return inputs.sparkSession.createDataFrame([(t, None, None) for t in terms], schema)
    beta = np.zeros(d)
    loss, gradient, hessian = equations(beta)
    for _ in range(max_rounds):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]  # least norm where terms repeat each other without a ridge
        if np.abs(step).max() <= tolerance:
            break
        after = equations(beta + step)
        while after[0] > loss + 1e-9 * abs(loss) and np.abs(step).max() > tolerance:
            step = step / 2
            after = equations(beta + step)
        beta, (loss, gradient, hessian) = beta + step, after
    return inputs.sparkSession.createDataFrame([(t, float(b), float(np.exp(b))) for t, b in zip(terms, beta)], schema)


def build_models(org_table: DataFrame, key_col: str, features: list[str] | None = None, converted_col: str = "converted",
                 seed: int = SEED, kinds: tuple[str, ...] = MODEL_KINDS) -> dict[str, DataFrame]:
    """Fit the models; returns ``comparison``, ``importance`` and ``scores`` (key, model,
    probability, is_test) frames and the fitted pipelines by kind (``models``).  The
    best model has the highest test AUC; on a tie the later kind wins (so
    with the default pair, logistic regression must be strictly better)."""
    spark = org_table.sparkSession
    features = features or MODEL_FEATURES
    train_s, test_s, scaler, to_population, fold_sizes = _prepared(org_table, key_col, features, converted_col, seed)
    n_train, k = sum(fold_sizes.values()), len(fold_sizes)

    def fold_auc(kind, f):
        fit_part = train_s.filter(F.col("fold") != f)
        model = _estimator(kind, n_train - fold_sizes.get(f, 0), seed).fit(fit_part)
        return _auc(model.transform(train_s.filter(F.col("fold") == f)), "label")

    def final(kind):
        model = _estimator(kind, n_train, seed).fit(train_s)
        return model, _auc(model.transform(test_s), "label")

    # The folds and the final fits are independent Spark jobs: submit them
    # concurrently (the scheduler interleaves their tasks).
    with ThreadPoolExecutor(max_workers=min(16, len(kinds) * (k + 1))) as pool:
        fold_futs = {kind: [pool.submit(fold_auc, kind, f) for f in sorted(fold_sizes)] for kind in kinds}
        final_futs = {kind: pool.submit(final, kind) for kind in kinds}
        done = {kind: ([fu.result() for fu in fold_futs[kind]], final_futs[kind].result()) for kind in kinds}
    results, importance = [], []
    for kind in kinds:
        fold_aucs, (model, test_auc) = done[kind]
        results.append((kind, sum(fold_aucs) / len(fold_aucs), _std0(fold_aucs), test_auc, n_train))
        weights = _weights(kind, model)
        ranked = sorted(range(len(features)), key=lambda i: -abs(weights[i]))
        for r, i in enumerate(ranked):
            importance.append((kind, features[i], float(weights[i]), abs(float(weights[i])), r + 1))
    best = None
    for name, _, _, auc, _ in results:
        if best is None or not auc < best[1]:
            best = (name, auc)
    scored = None
    for kind in kinds:
        s = done[kind][1][0].transform(train_s.unionByName(test_s)).select(
            key_col, F.lit(kind).alias("model"), vector_to_array("probability")[1].alias("probability"), "is_test")
        scored = s if scored is None else scored.unionByName(s)
    comparison = spark.createDataFrame(
        [(n, m, s, t, nt, n == best[0]) for n, m, s, t, nt in results],
        "model string, cv_auc_mean double, cv_auc_std double, test_auc double, n_train long, best boolean")
    imp = spark.createDataFrame(importance, "model string, feature string, importance double, abs_importance double, rank int")
    # each fitted model with all that precedes it: applies to a table with the feature columns
    fitted = {kind: PipelineModel(stages=[VectorAssembler(inputCols=features, outputCol="raw_features"), scaler, to_population, done[kind][1][0]])
              for kind in kinds}
    return {"comparison": comparison, "importance": imp, "scores": scored, "models": fitted}
