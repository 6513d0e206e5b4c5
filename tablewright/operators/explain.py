"""Explaining fitted models, with batch jobs over tables.

The models take a vector column ``features``.  Rows are copied in place
(``explode``), changed by expressions and scored by ``model.transform``; what
is shuffled are per-group sums.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from tablewright.functions import draws
from tablewright.functions.sampling import hash_normal, hash_uniform
from tablewright.operators.stats import log_loss
from tablewright.plans.lineage import cut
from tablewright.plans.ordering import exact_quantiles, numbered


def _names(df, names):
    return df.withColumn("feature", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1))


def _replaced(value):
    """The array ``x`` with position ``f`` set to ``value``."""
    return F.transform("x", lambda v, i: F.when(i == F.col("f"), value).otherwise(v))


def _scored(model, df, array, out="p"):
    """Probability of class 1 (or the prediction) for an array column."""
    vec = df.withColumn("features", array_to_vector(array))
    done = model.transform(vec)
    if "probability" in done.columns:
        value = vector_to_array("probability")[1]
    else:
        value = F.col("prediction")
    return done.withColumn(out, value)


def _rows(df, key, features, *more):
    """Rows as arrays, spread by key before the callers multiply them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("row"), vector_to_array(features).alias("x"), *more)
    return rows.repartition(tasks, "row")


def coefficient_table(model, names, spark):
    """``(feature, coefficient)`` with the intercept."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame([("intercept", float(model.intercept)), *rows], "feature string, coefficient double")


def contributions(model, df, key, names, features="features"):
    """``(row, feature, contribution)``: coefficient times value."""
    coef = F.array(*[F.lit(float(c)) for c in model.coefficients.toArray()])
    cells = _rows(df, key, features).select(
        "row", F.posexplode(F.zip_with("x", coef, lambda v, c: v * c)).alias("f", "contribution")
    )
    return _names(cells, names).select("row", "feature", "contribution")


def permutation_importance(model, df, key, names, label, features="features", seed=7, hard=True):
    """``(feature, importance)``: log loss after shuffling a column, minus before.

    Rows are numbered in key order; row ``i`` takes the values of row
    ``draws.permuted(i)``.  One bijection serves all columns, as each is judged
    by itself, so a row travels once.  ``hard`` scores 0/1 predictions.
    """
    p = "prediction" if hard else "p"
    rows = _rows(df, key, features, F.col(label).cast("double").alias("y"))
    rows = cut(numbered(rows, "row", "rn").select((F.col("rn") - 1).alias("rn"), "x", "y"))
    n = rows.count()
    base = _scored(model, rows, F.col("x")).agg(log_loss("y", p)).scalar()

    def deal(batches):
        for batch in batches:
            taken = pa.array(draws.permuted(batch.column(0).to_numpy(), n, seed))
            yield pa.RecordBatch.from_arrays([taken, *batch.columns[1:]], ["from", *batch.schema.names[1:]])

    takers = rows.mapInArrow(deal, "from long, x array<double>, y double")
    mixed = takers.join(rows.select(F.col("rn").alias("from"), F.col("x").alias("z")), "from").drop("from")
    mixed = mixed.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    losses = _scored(model, mixed, _replaced(F.get("z", F.col("f")))).groupBy("f").agg(log_loss("y", p).alias("loss"))
    return _names(losses.withColumn("_base", base), names).select(
        "feature", (F.col("loss") - F.col("_base")).alias("importance")
    )


def partial_dependence(model, df, key, names, features="features", grid=100, low=0.05, high=0.95, chosen=None):
    """``(feature, value, mean)`` on an even grid between two percentiles, for all features or the ``chosen``."""
    chosen = list(chosen if chosen is not None else range(len(names)))
    rows = _rows(df, key, features)
    picked = F.array(*[F.lit(f) for f in chosen])
    cells = rows.select(F.explode(picked).alias("f"), "x").select("f", F.get("x", F.col("f")).alias("v"))
    ends = exact_quantiles(cells, "v", [low, high], ["f"], names=["lo", "hi"])
    steps = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    packed = ends.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("lo", "hi"))))).scalar()
    spread = (
        rows.withColumn("_ends", packed)
        .withColumn("f", F.explode(picked))
        .withColumn("step", steps)
        .withColumn("_e", F.try_element_at("_ends", F.col("f")))
        .withColumn(
            "value", F.col("_e.lo") + (F.col("_e.hi") - F.col("_e.lo")) * F.col("step") / max(grid - 1, 1)
        )
        .drop("_ends", "_e")
    )
    means = _scored(model, spread, _replaced(F.col("value"))).groupBy("f", "step").agg(
        F.first("value").alias("value"), F.avg("p").alias("mean")
    )
    return _names(means, names).select("feature", "step", "value", "mean")


def surrogate(model, df, key, names, features="features", **params):
    """A logistic regression fitted on a model's labels.

    Returns its coefficient table and its fidelity, the share of rows on
    which both agree.
    """
    labelled = cut(model.transform(df).select(F.col(key).alias("row"), features, F.col("prediction").alias("_label")))
    simple = LogisticRegression(featuresCol=features, labelCol="_label", **params).fit(labelled)
    agree = simple.transform(labelled).agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()[0]
    return coefficient_table(simple, names, df.sparkSession), agree


def background_rows(df, key, features="features", size=50, seed=7):
    """A fixed number of rows as one array of arrays (scalar column)."""
    return (
        _rows(df, key, features)
        .orderBy(hash_uniform(seed, F.lit("bg"), "row"), "row")
        .limit(size)
        .agg(F.array_sort(F.collect_list(F.struct("row", "x"))).alias("b"))
        .select(F.transform("b", lambda s: s["x"]))
        .scalar()
    )


def shapley(model, df, key, names, background, features="features", orders=20, seed=7):
    """``(row, feature, value)``: Monte-Carlo estimate of Shapley values.

    For each row and each of ``orders`` hashed feature orders, a background
    row is turned into the row one feature at a time; the change of the score
    goes to the feature.  The estimate's error falls with the square root of
    ``orders``.
    """
    d = len(names)
    rank = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(d - 1)),
            lambda f: F.struct(hash_uniform(seed, "row", "perm", f).alias("u"), f.alias("f")),
        )
    )
    pick = F.floor(hash_uniform(f"{seed}b", "row", "perm") * F.size("_bg")).cast("int")
    walks = (
        _rows(df, key, features)
        .withColumn("_bg", background)
        .withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(orders))))
        .withColumn("z", F.get("_bg", pick))
        .withColumn("order", F.transform(rank, lambda s: s["f"]))
        .drop("_bg")
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    )
    mixed = F.transform(
        "x",
        lambda v, i: F.when(F.array_position("order", i) <= F.col("step"), v).otherwise(F.get("z", i)),
    )
    moves = F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("f"), F.col("p").alias("c")),
        F.struct(F.get("order", F.col("step")).alias("f"), (-F.col("p")).alias("c")),
    )
    parts = _scored(model, walks, mixed).select("row", F.inline(moves)).where("f IS NOT NULL")
    sums = parts.groupBy("row", "f").agg((F.sum("c") / orders).alias("value"))
    return _names(sums, names).select("row", "feature", "value")


def tree_arrays(model):
    """The trees of a fitted tree model: ``(weight, feature, threshold, left, right, value, cover)`` each.

    ``feature`` is -1 in leaves, ``cover`` the weight of the training rows of a
    node.  Splits must be on numeric features.
    """
    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    if not isinstance(model, (GBTClassificationModel, GBTRegressionModel)):
        weights = [w / sum(weights) for w in weights]
    return [(float(w), *_tree_arrays(t)) for w, t in zip(weights, trees)]


def _tree_arrays(tree):
    nodes, todo = [], [(tree._call_java("rootNode"), None, 0)]
    while todo:
        node, parent, side = todo.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(node.prediction()), float(node.impurityStats().count())])
        if parent is not None:
            nodes[parent][2 + side] = at
        if node.subtreeDepth():
            split = node.split()
            nodes[at][0], nodes[at][1] = int(split.featureIndex()), float(split.threshold())
            todo += [(node.leftChild(), at, 0), (node.rightChild(), at, 1)]
    columns = [np.array(c) for c in zip(*nodes)]
    return [columns[0].astype(int), columns[1], columns[2].astype(int), columns[3].astype(int), columns[4], columns[5]]


def _leaves(tree):
    """``(value, [(feature, low, high, share)])``: each leaf, and by feature the interval of its path.

    ``share`` is the part of the rows that would go the path's way at the feature's splits.
    """
    weight, feature, threshold, left, right, value, cover = tree
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        if feature[at] < 0:
            yield weight * value[at], [(f, *p) for f, p in path.items()]
            continue
        f = int(feature[at])
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, edge in ((left[at], (low, min(high, threshold[at]))), (right[at], (max(low, threshold[at]), high))):
            if cover[child] > 0:
                todo.append((child, path | {f: (*edge, share * cover[child] / cover[at])}))


def _path_values(leaves, x):
    """Shapley values (rows x features) of the sum of leaves, and its value without any feature.

    A leaf is reached with the known features S with weight prod(inside, S) *
    prod(share, others).  The Shapley value of a product is an integral over t of
    prod(share * (1 - t) + inside * t) over the other features, a polynomial; a
    Gauss-Legendre rule with enough points gives it exactly.
    """
    out, base = np.zeros(x.shape), 0.0
    rules = {}
    for value, path in leaves:
        k = len(path)
        base += value * np.prod([p[3] for p in path])
        if not k:
            continue
        if k not in rules:
            t, w = np.polynomial.legendre.leggauss(k // 2 + 1)
            rules[k] = ((t + 1) / 2)[:, None], w / 2
        t, w = rules[k]
        inside = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
        factors = [share * (1 - t) + own * t for own, (_, _, _, share) in zip(inside, path)]
        whole = np.prod(factors, axis=0)
        for own, factor, (f, _, _, share) in zip(inside, factors, path):
            out[:, f] += value * (own - share) * (w @ (whole / factor))
    return out, base


def tree_shapley(trees, df, key, names, features="features"):
    """``(row, feature, value, base)``: exact Shapley values of a tree ensemble.

    ``trees`` as from ``tree_arrays``.  Unknown features follow both branches by
    their cover.  Values of a row add up to its raw score (the weighted sum of
    the trees) less ``base``.  Time grows with leaves x depth squared, not with
    the subsets of features; rows are scored in batches, nothing is shuffled.
    Missing values go right, as no comparison holds for them.
    """
    leaves = [leaf for tree in trees for leaf in _leaves(tree)]
    d = len(names)

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d).astype(float)
            found, base = _path_values(leaves, np.where(np.isnan(x), np.inf, x))
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), d))), pa.array(list(names) * n, pa.string()),
                 pa.array(found.ravel()), pa.array(np.full(n * d, base))],
                ["row", "feature", "value", "base"],
            )

    rows = df.select(F.col(key).alias("row"), vector_to_array(features).alias("x"))
    return rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, feature string, value double, base double")


def local_surrogate(model, df, key, names, features="features", samples=500, kernel_width=5.0, ridge=1.0, seed=7):
    """``(row, feature, weight)``: a weighted ridge fit around each row.

    Samples add normal noise of each column's spread.  They are made and scored
    where the row is; what is shuffled are sums of a fixed size for each row (of
    weights, values, scores and their products), from which batches of rows are
    solved at once.
    """
    d = len(names)
    rows = _rows(df, key, features)
    spread = rows.agg(F.array(*[F.stddev_pop(F.get("x", F.lit(i))) for i in range(d)])).scalar()
    noise = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda i: F.when(F.col("sample") == 0, F.lit(0.0)).otherwise(hash_normal(seed, "row", "sample", i)),
    )
    tried = (
        rows.withColumn("_sd", spread)
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("e", noise)
        .withColumn("z", F.transform("x", lambda v, i: v + F.get("e", i) * F.get("_sd", i)))
    )
    dist2 = F.aggregate("e", F.lit(0.0), lambda acc, v: acc + v * v)
    weighed = _scored(model, tried, F.col("z")).select(
        "row", "e", "p", F.exp(-dist2 / F.lit(2.0 * kernel_width * kernel_width)).alias("w")
    )
    w, p, e = F.col("w"), F.col("p"), [F.get("e", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    moments = [w, w * p, *[w * v for v in e], *[w * v * p for v in e], *[w * e[i] * e[j] for i, j in pairs]]
    sums, width = weighed.groupBy("row").agg(F.array(*[F.sum(m) for m in moments]).alias("m")), len(moments)

    def solve(batches):
        for batch in batches:
            m = batch.column(1).flatten().to_numpy().reshape(-1, width)
            n, (sw, sp) = len(m), (m[:, 0], m[:, 1])
            se, sep = m[:, 2 : 2 + d], m[:, 2 + d : 2 + 2 * d]
            left = np.zeros((n, d, d))
            for k, (i, j) in enumerate(pairs):
                left[:, i, j] = left[:, j, i] = m[:, 2 + 2 * d + k] - se[:, i] * se[:, j] / sw
            right = sep - se * (sp / sw)[:, None]
            beta = np.linalg.solve(left + ridge * np.eye(d), right[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), d))), pa.array(list(names) * n, pa.string()), pa.array(beta.ravel())],
                ["row", "feature", "weight"],
            )

    return sums.mapInArrow(solve, f"row {dict(rows.dtypes)['row']}, feature string, weight double")
