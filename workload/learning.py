"""Models and their explanation; fitted models have no SQL, those that SQL can repeat have."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W, functions as F

from tablewright.functions import text as tx
from tablewright.functions.sampling import hash_uniform
from tablewright.operators import anomaly as an, explain as ex, forest as fo, models as ml
from tablewright.plans.lineage import cut
from workload.numbers import order_features
from workload.registry import mixed, query, rounded, u
from workload.tables import scratch

DOC = ["n_chars", "n_words", "n_distinct", "mean_word", "n_lines"]


def documents(t):
    """Labelled documents with counts over the whole text, in thousands."""
    w = tx.words("text")
    base = t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        (F.col("n_chars") / 1000.0).alias("n_chars"),
        (F.size(w) / 100.0).alias("n_words"),
        (F.size(F.array_distinct(w)) / 100.0).alias("n_distinct"),
        F.coalesce(F.try_divide(F.length(F.array_join(w, "")), F.size(w)), F.lit(0.0)).alias("mean_word"),
        (F.size(F.split("text", "\n")) / 10.0).alias("n_lines"),
        F.col("quality").cast("double").alias("label"),
    )
    return cut(ml.assemble(base, DOC))


def boosted(df):
    """A hundred rounds of trees of depth 3."""
    return ml.boosted_classifier(maxIter=100, maxDepth=3).fit(df)


@query()
def station_model(t):
    """Boosted trees on day and place, saved, loaded, errors per station."""
    df = t.lineitem.select(
        "l_suppkey", "l_orderkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("latitude"),
        F.col("l_discount").alias("longitude"), F.col("l_tax").alias("elevation"), (F.col("l_extendedprice") / 1000).alias("tmax"),
    )
    held_out = hash_uniform(7, F.lit(0), "l_orderkey") >= 1 - 0.3  # as ``score`` takes them
    model = ml.day_pipeline().fit(df.where(~held_out))
    path = scratch(t, "model")
    ml.save_model(model, path)
    scored = ml.score(ml.load_model(path), df, 0.3, "l_orderkey")
    return ml.station_errors(scored, "l_suppkey", "tmax", max_first=True)


@query()
def grid_score(t):
    """The same kind of model on a grid of places at one day."""
    df = t.lineitem.select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_discount").alias("latitude"), F.col("l_tax").alias("longitude"),
        F.col("l_quantity").alias("elevation"), (F.col("l_extendedprice") / 1000).alias("tmax"),
    )
    model = ml.day_pipeline().fit(df)
    height = df.groupBy(F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude")).agg(
        F.avg("elevation").alias("elevation")
    )
    grid = ml.grid_score(model, t.spark, "2000-01-15", (0.0, 0.1, 11), (0.0, 0.08, 9), height)
    return grid.select("latitude", "longitude", "elevation", "prediction")


@query()
def kmeans_anomaly(t):
    return an.detect(t.embeddings.select("vec_id", "embedding"), "embedding", 8, 0.9).select("vec_id", "score")


@query()
def coded_anomalies(t):
    f = F.array("event_type", F.hour("ts").cast("string"), F.col("value").cast("string"), F.get_json_object("props", "$.k"))
    df = t.events.select("event_id", f.alias("f"))
    return an.detect_coded(df, "f", "event_id", [0, 1], numeric_from=2, k=8, threshold=0.9).select("event_id", "score")


@query()
def coefficient_table(t):
    df = documents(t)
    model = ml.elastic_logistic(df.count(), c=10.0).fit(df)
    return ex.coefficient_table(model, DOC, t.spark)


@query()
def contributions(t):
    df = documents(t)
    return ex.contributions(ml.elastic_logistic(df.count(), c=10.0).fit(df), df, "doc_id", DOC)


@query()
def permutation_importance(t):
    df = documents(t)
    return ex.permutation_importance(boosted(df), df, "doc_id", DOC, "label")


@query()
def partial_dependence(t):
    df = documents(t)
    return ex.partial_dependence(boosted(df), df, "doc_id", DOC)


@query()
def surrogate(t):
    df = documents(t)
    table, agree = ex.surrogate(boosted(df), df, "doc_id", DOC)
    return table.withColumn("fidelity", F.lit(agree))


@query()
def shapley_values(t):
    """Exact values of the raw score of the boosted trees."""
    df = documents(t)
    return ex.tree_shapley(ex.tree_arrays(boosted(df)), df, "doc_id", DOC)


@query()
def sampled_shapley(t):
    """The estimate for any model, here of the probability."""
    df = documents(t)
    return ex.shapley(boosted(df), df, "doc_id", DOC, ex.background_rows(df, "doc_id"))


CUT = "o_custkey <= 700, month(o_orderdate) <= 6, day(o_orderdate) <= 15".split(", ")
PARTS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def known(s, i, own, share):
    return own if s[i] else share


REACH = ", ".join(
    f"""{known(s, 0, 'a', 'za')} * ({known(s, 1, 'b', 'zb')} * vab + (1 - {known(s, 1, 'b', 'zb')}) * va)
      + (1 - {known(s, 0, 'a', 'za')}) * ({known(s, 2, 'c', 'zc')} * vc + (1 - {known(s, 2, 'c', 'zc')}) * v) AS f{''.join(map(str, s))}"""
    for s in PARTS
)


def shares(i):
    """Shapley's weights of the subsets without feature ``i`` of three."""
    terms = []
    for s in PARTS:
        if not s[i]:
            more = s[:i] + (1,) + s[i + 1 :]
            terms.append(f"(f{''.join(map(str, more))} - f{''.join(map(str, s))}) / {6.0 if sum(s) == 1 else 3.0}")
    return " + ".join(terms)


@query(
    f"""WITH o AS (SELECT o_orderkey AS row, o_totalprice AS y, ({CUT[0]})::INT AS a, ({CUT[1]})::INT AS b, ({CUT[2]})::INT AS c FROM orders),
    t AS (SELECT avg(a) AS za, sum(b) FILTER (a = 1) / count(*) FILTER (a = 1) AS zb, sum(c) FILTER (a = 0) / count(*) FILTER (a = 0) AS zc,
      avg(y) FILTER (a = 1 AND b = 1) AS vab, avg(y) FILTER (a = 1 AND b = 0) AS va, avg(y) FILTER (a = 0 AND c = 1) AS vc,
      avg(y) FILTER (a = 0 AND c = 0) AS v FROM o),
    f AS (SELECT row, {REACH} FROM o, t),
    w AS (SELECT row, 'customer' AS feature, {shares(0)} AS value, f000 AS base FROM f UNION ALL SELECT row, 'month', {shares(1)}, f000 FROM f
      UNION ALL SELECT row, 'day', {shares(2)}, f000 FROM f)
    SELECT row, feature, round(value, 2) + 0 AS value, round(base, 2) AS base FROM w"""
)
def tree_attribution(t):
    """A tree with given cuts, its leaves the mean prices: first by customer, then by month or by day."""
    df = t.orders.select(
        "o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("customer"),
        F.month("o_orderdate").cast("double").alias("month"), F.dayofmonth("o_orderdate").cast("double").alias("day"),
    )
    side = (F.col("customer") <= 700).cast("int")
    under = F.when(side == 1, F.col("month") <= 6).otherwise(F.col("day") <= 15).cast("int")
    leaf = {(r[0], r[1]): (r[2], r[3]) for r in df.groupBy(side, under).agg(F.avg("y"), F.count(F.lit(1))).collect()}  # four rows
    names, ends = ["customer", "month", "day"], ((1, 1), (1, 0), (0, 1), (0, 0))
    if any(k not in leaf for k in ends):  # the mean of no rows: as in SQL, no value is known
        none = F.lit(None).cast("double")
        return ml.assemble(df, names).select(
            F.col("o_orderkey").alias("row"), F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), none.alias("value"), none.alias("base")
        )
    mean, size = [[leaf[k][i] for k in ends] for i in (0, 1)]
    cover = [sum(size), size[0] + size[1], size[2] + size[3], *size]
    tree = (
        1.0, np.array([0, 1, 2, -1, -1, -1, -1]), np.array([700.0, 6.0, 15.0, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]),
        np.array([2, 4, 6, -1, -1, -1, -1]), np.array([0.0, 0, 0, *mean]), np.array(cover, float),
    )
    return rounded(ex.tree_shapley([tree], ml.assemble(df, names), "o_orderkey", names), "value", "base", digits=2)


@query()
def local_surrogate(t):
    df = documents(t)
    return ex.local_surrogate(boosted(df), df, "doc_id", DOC)


@query()
def perceptron_accuracy(t):
    df = documents(t)
    model = ml.perceptron(len(DOC)).fit(df)
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


LINE = ["l_quantity", "l_discount", "l_tax", "day"]


def line_features(t):
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), "l_quantity", "l_discount", "l_tax",
        F.dayofyear("l_shipdate").cast("double").alias("day"), F.col("l_extendedprice").alias("label"),
    )


@query()
def forest_importance(t):
    """Importances of ten full trees, a column of noise among the features."""
    df = cut(ml.add_probe(line_features(t), "key"))
    found = fo.importances(fo.forests(df, "key", {"all": [*LINE, "probe"]}, "label", predict=False))
    return found.select("feature", "importance", F.row_number().over(W.orderBy(F.desc("importance"), "feature")).alias("rank"))


@query()
def drop_column_importance(t):
    return fo.drop_column_importance(cut(line_features(t)), "key", LINE, "label")


@query()
def binarized_variants(t):
    return fo.binarized_variants(line_features(t), "key", LINE, "label", "l_quantity")


@query()
def selected_features_auc(t):
    """AUC of a forest on order features, over three hashed folds."""
    cols = ["count", "total", "mean", "std", "latest"]
    df = order_features(t).withColumn("label", (F.col("label") > 5000).cast("double"))
    ready = cut(ml.assemble(df, cols).select("c_custkey", "features", "label"))
    auc = ml.cross_auc(ml.forest_classifier(), ready, "label", "c_custkey")
    return ready.agg(F.count(F.lit(1)).alias("rows")).withColumn("auc", F.lit(auc))


class Line:
    """A logistic line with given coefficients, which SQL can repeat; it scores by ``prediction``."""

    def __init__(self, coefficients, bias):
        self.coefficients, self.bias = coefficients, bias

    def transform(self, df):
        x = vector_to_array("features")
        total = sum((F.get(x, F.lit(i)) * c for i, c in enumerate(self.coefficients)), F.lit(self.bias))
        return df.withColumn("prediction", 1 / (1 + F.exp(-total)))


def dealt(k):
    """DuckDB: one Feistel round of ``functions.draws.permuted`` after another, of columns rn, place, n, half."""
    q = "SELECT rn, n, half, step, place & ((1 << half) - 1) AS low, place >> half AS high FROM walk WHERE step = 0 OR place >= n"
    for i in range(1, 5):
        drawn = mixed(f"SELECT *, {i} AS i, low AS x1, {k}::UBIGINT AS x2 FROM ({q})")
        q = f"SELECT rn, n, half, step, low AS high, xor(high, m & ((1 << half) - 1)) AS low FROM ({drawn})"
    return f"SELECT rn, n, half, step + 1 AS step, (high << half) | low AS place FROM ({q})"


SCORED = "1 / (1 + exp(-(-3.0 + 2.0 * {} + 0.3 * {} - 0.01 * {})))"
LOSS = "avg(-(y * ln({p}) + (1 - y) * ln(1 - {p})))"


def loss_with(f):
    at = [f"{'z' if i == f else 'e'}.{c}" for i, c in enumerate("abc")]
    return f"SELECT '{['price', 'customer', 'month'][f]}' AS feature, {LOSS.format(p='(' + SCORED.format(*at) + ')')} AS loss FROM e JOIN found ON e.rn = found.rn JOIN z ON z.rn = found.place"


@query(
    f"""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, o_totalprice / 100000 AS a, o_custkey / 1000.0 AS b,
      month(o_orderdate)::DOUBLE AS c, (o_totalprice > 150000)::INT AS y FROM orders),
    z AS (SELECT rn, a, b, c FROM e),
    s AS (SELECT count(*)::UBIGINT AS n, ((floor(log2(greatest(count(*) - 1, 1)))::BIGINT + 2) // 2)::UBIGINT AS half FROM e),
    walk AS (SELECT rn::UBIGINT AS rn, n, half, 0 AS step, rn::UBIGINT AS place FROM e, s UNION ALL {dealt(7)}),
    found AS (SELECT rn, place FROM walk WHERE step > 0 AND place < n),
    l AS ({" UNION ALL ".join(loss_with(f) for f in range(3))}),
    base AS (SELECT {LOSS.format(p='(' + SCORED.format('a', 'b', 'c') + ')')} AS loss FROM e)
    SELECT feature, round(l.loss - base.loss, 6) AS importance FROM l, base"""
)
def line_importance(t):
    """Permutation importance of a given line."""
    df = t.orders.select(
        "o_orderkey", (F.col("o_totalprice") / 100000).alias("price"), (F.col("o_custkey") / 1000).alias("customer"),
        F.month("o_orderdate").cast("double").alias("month"), (F.col("o_totalprice") > 150000).cast("double").alias("label"),
    )
    names = ["price", "customer", "month"]
    done = ex.permutation_importance(Line([2.0, 0.3, -0.01], -3.0), ml.assemble(df, names), "o_orderkey", names, "label", hard=False)
    return rounded(done, "importance")


NORMAL = f"sqrt(-2 * ln(1 - {u('7a', 'row', 'sample', '0')})) * cos(2 * pi() * {u('7b', 'row', 'sample', '0')})"


@query(
    f"""WITH d AS (SELECT doc_id AS row, n_chars / 1000.0 AS x, stddev_pop(n_chars / 1000.0) OVER () AS sd FROM documents),
    n AS (SELECT row, x, sd, CASE WHEN sample = 0 THEN 0.0 ELSE {NORMAL} END AS e FROM d, range(500) s(sample)),
    w AS (SELECT row, e, exp(-e * e / 50) AS w, 1 / (1 + exp(-(0.8 * (x + e * sd) - 2))) AS p FROM n)
    SELECT row, 'n_chars' AS feature,
      round((sum(w * e * p) - sum(w * e) * sum(w * p) / sum(w)) / (sum(w * e * e) - sum(w * e) * sum(w * e) / sum(w) + 1), 6) AS weight
    FROM w GROUP BY row"""
)
def line_surrogate(t):
    """Local fits around every document of a given line of its length."""
    df = t.documents.select("doc_id", (F.col("n_chars") / 1000.0).alias("n_chars"))
    return rounded(ex.local_surrogate(Line([0.8], -2.0), ml.assemble(df, ["n_chars"]), "doc_id", ["n_chars"]), "weight")
