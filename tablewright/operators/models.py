"""Spark ML models as table operators."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tablewright.functions.sampling import hash_uniform
from tablewright.operators.table import binarize_at_mean

DAY_FEATURES = ["day_of_year", "latitude", "longitude", "elevation"]


def assemble(df, cols, out="features"):
    """Vector column; rows with a missing value are skipped."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


# -- regression over places and days ---------------------------------------


def day_pipeline(label="tmax", date="date", place=("latitude", "longitude", "elevation"), rounds=20, depth=10, seed=7):
    """Gradient-boosted trees on day of year and place."""
    sql = SQLTransformer(
        statement=f"SELECT *, dayofyear(`{date}`) AS day_of_year FROM __THIS__"
    )
    features = VectorAssembler(inputCols=["day_of_year", *place], outputCol="features")
    trees = GBTRegressor(
        featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[sql, features, trees])


def save_model(model, path):
    model.write().overwrite().save(path)


def load_model(path):
    return PipelineModel.load(path)


def score(model, df, test_share=None, key=None, seed=7):
    """Score a table, or only its held-out share."""
    if test_share is not None:
        df = df.where(hash_uniform(seed, F.lit(0), F.col(key)) >= 1 - test_share)
    return model.transform(df)


def grid_score(model, spark, day, latitudes, longitudes, elevation, date_col="date"):
    """Score a grid of places at one day.

    ``latitudes`` and ``longitudes`` are ``(start, stop, steps)``;
    ``elevation`` is a frame ``(latitude, longitude, elevation)`` on the grid
    points, rounded to four decimals.  Cells are numbered and turned into
    coordinates, so the grid is generated in parallel.
    """
    (a0, a1, na), (o0, o1, no) = latitudes, longitudes
    at = lambda lo, hi, n, i: F.round(F.lit(float(lo)) + (hi - lo) / max(n - 1, 1) * i, 4)
    cells = spark.range(na * no).select(
        at(a0, a1, na, F.floor(F.col("id") / no)).alias("latitude"),
        at(o0, o1, no, F.col("id") % no).alias("longitude"),
        F.lit(day).cast("date").alias(date_col),
    )
    points = elevation.select(
        F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), "elevation"
    )
    return model.transform(cells.join(points, ["latitude", "longitude"]))


def station_errors(scored, station, actual, predicted="prediction", max_first=False):
    """Error per station.

    By default the largest error of its rows; with ``max_first`` the error
    between the largest prediction and the largest actual value.
    """
    if max_first:
        top = scored.groupBy(station).agg(F.max(predicted).alias("_p"), F.max(actual).alias("_a"))
        return top.select(station, F.abs(F.col("_p") - F.col("_a")).alias("error"))
    return scored.groupBy(station).agg(F.max(F.abs(F.col(predicted) - F.col(actual))).alias("error"))


def evaluate_regression(scored, label, predicted="prediction"):
    make = lambda m: RegressionEvaluator(labelCol=label, predictionCol=predicted, metricName=m)
    return {"r2": make("r2").evaluate(scored), "rmse": make("rmse").evaluate(scored)}


# -- estimators -------------------------------------------------------------


def elastic_logistic(n, c=1.0, mix=0.3, label="label", **params):
    """Logistic regression, penalty ``1 / (c n)``, elastic-net mix."""
    return LogisticRegression(
        labelCol=label, elasticNetParam=mix, regParam=1.0 / (c * n), standardization=False, **params
    )


def boosted_classifier(label="label", seed=7, **params):
    return GBTClassifier(labelCol=label, seed=seed, **params)


def perceptron(inputs, classes=2, hidden=(100,), label="label", seed=7, **params):
    return MultilayerPerceptronClassifier(
        labelCol=label, layers=[inputs, *hidden, classes], seed=seed, **params
    )


def forest_classifier(label="label", trees=400, seed=7, **params):
    return RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed, **params)


def forest_regressor(label="label", trees=10, seed=7, depth=30, **params):
    return RandomForestRegressor(
        labelCol=label, numTrees=trees, seed=seed, maxDepth=depth, featureSubsetStrategy="all",
        minInstancesPerNode=1, **params
    )


def least_squares(label="label", **params):
    return LinearRegression(labelCol=label, solver="normal", **params)


def cross_auc(estimator, df, label, key, folds=3, seed=7, metric="areaUnderROC"):
    """Mean ROC AUC over hashed folds, the same on any layout."""
    folded = df.withColumn("fold", F.floor(hash_uniform(seed, F.lit(0), F.col(key)) * folds).cast("int"))
    judge = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=judge,
        numFolds=folds,
        foldCol="fold",
        parallelism=folds,
    )
    return cv.fit(folded).avgMetrics[0]


# -- importance -------------------------------------------------------------


def add_probe(df, key, out="probe", seed=7):
    """A column of noise, to compare importances with."""
    return df.withColumn(out, hash_uniform(seed, F.lit(0), F.col(key)))


def importance_table(model, names, spark):
    """``(feature, importance, rank)`` of a tree model."""
    rows = sorted(zip(names, [float(v) for v in model.featureImportances.toArray()]), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int"
    )


def forest_importance(df, features, label, key, probe="probe", seed=7, **params):
    """Importances of a forest regressor, a noise column among the features."""
    names = [*features, probe]
    ready = assemble(add_probe(df, key, probe, seed), names)
    model = forest_regressor(label, seed=seed, **params).fit(ready)
    return importance_table(model, names, df.sparkSession)


def _r2(estimator, df, label):
    return evaluate_regression(estimator.fit(df).transform(df), label)["r2"]


def drop_column_importance(df, features, label, estimator):
    """``(feature, importance)``: loss of R squared when refitted without it."""
    base = df.select(*features, label).dropna().persist()
    try:
        full = _r2(estimator, assemble(base, features), label)
        rows = [
            (f, full - _r2(estimator, assemble(base, [c for c in features if c != f]), label)) for f in features
        ]
    finally:
        base.unpersist()
    rows.sort(key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def binarized_variants(df, features, label, column, estimator, key, test_share=0.2, seed=7):
    """R squared on held-out rows of three feature sets.

    The given features; with ``column`` also as 0/1 around its mean; with
    that 0/1 in its place.
    """
    flag = column + "_high"
    rows = binarize_at_mean(df.select(key, *features, label).dropna(), column, flag)
    parts = rows.withColumn("_test", hash_uniform(seed, F.lit(0), F.col(key)) < test_share).persist()
    sets = {
        "base": list(features),
        "added": [*features, flag],
        "replaced": [flag if c == column else c for c in features],
    }
    out = []
    try:
        for name, cols in sets.items():
            ready = assemble(parts, cols)
            model = estimator.fit(ready.where("NOT _test"))
            out.append((name, evaluate_regression(model.transform(ready.where("_test")), label)["r2"]))
    finally:
        parts.unpersist()
    return df.sparkSession.createDataFrame(out, "variant string, r2 double")
