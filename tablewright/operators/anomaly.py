"""Rows in rare clusters."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewright.operators.encode import one_hot, standardize
from tablewright.plans.lineage import cut

TASK_ROWS = 50_000  # rows that one task clusters


def group_sizes(df, group, out="size"):
    """Rows with the size of their group.

    Sizes are counted apart and joined back: a window over a hot group would
    pull it into one task.
    """
    return df.join(df.groupBy(group).agg(F.count(F.lit(1)).alias(out)), group)


def rare_group_score(df, group, threshold=None, out="score"):
    """Score ``(max - size) / (max - min)``; 1 for the rarest group.

    NULL when all groups have one size, and then no row passes a threshold.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.agg(F.struct(F.max("_n").alias("hi"), F.min("_n").alias("lo"))).scalar()
    scores = sizes.withColumn("_e", ends).select(
        group, F.try_divide(F.col("_e")["hi"] - F.col("_n"), F.col("_e")["hi"] - F.col("_e")["lo"]).alias(out)
    )
    if threshold is not None:
        scores = scores.where(F.col(out) >= threshold)
    return df.join(scores, group)


def clusters(df, features, k, seed=7, out="cluster", restarts=10, **params):
    """KMeans cluster of an array column; the cheapest of some restarts."""
    vec = cut(df.withColumn("_vec", array_to_vector(F.col(features).cast("array<double>"))))
    data = vec.select("_vec")  # not persisted: each fit keeps its rows as vectors, which a persisted frame is not
    fits = [
        KMeans(k=k, seed=seed + i, featuresCol="_vec", predictionCol=out, **params).fit(data)
        for i in range(restarts)
    ]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(vec).drop("_vec")


def detect(df, features, k, threshold, seed=7, **params):
    """Rows whose cluster is rare enough, with their score."""
    return rare_group_score(clusters(df, features, k, seed, **params), "cluster", threshold).drop("cluster")


def anomaly_pipeline(df, features, pos, categorical=(0, 1), numeric=range(12, 48), k=8, threshold=0.97, seed=7, **params):
    """One-hot, standardise, cluster, score."""
    coded = one_hot(df, features, list(categorical), pos)
    return detect(standardize(coded, features, list(numeric)), features, k, threshold, seed, **params)


def spread(df, key, task_rows=None):
    """Rows dealt by ``key`` where its partitions would have more than ``task_rows``; few rows stay as they are."""
    tasks = -(-df.count() // (task_rows or TASK_ROWS))
    return df.repartition(tasks, key) if tasks > 1 else df


def detect_coded(df, features, pos, categorical, numeric_from, k, threshold, seed=7, **params):
    """As ``anomaly_pipeline``, standardising all positions that are not one-hot.

    ``numeric_from`` is the first numeric position before encoding.  All rows
    must have the same number of positions.
    """
    df = cut(spread(cut(df), pos))  # or the lambdas below would compute the positions for each level anew
    size = F.size(features)
    before = df.where(F.col(features).isNotNull()).agg(F.min(size), F.max(size)).first()
    if before[0] != before[1]:
        raise ValueError(f"rows of {before[0]} to {before[1]} positions")
    coded = one_hot(df, features, list(categorical), pos)
    numeric = []
    if before[0] is not None:
        width = coded.where(F.col(features).isNotNull()).select(size).first()[0]
        numeric = range(width - (before[0] - numeric_from), width)
    return detect(standardize(cut(coded), features, list(numeric)), features, k, threshold, seed, **params)
