"""Models, explanations and synthesized features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import explain as ex, models as ml, synth as sy

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 3)).round(3)
    y = (2 * x[:, 0] - x[:, 1] + rnd.normal(0, 0.3, 300) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=NAMES).assign(key=range(300), label=y, target=3 * x[:, 0] + x[:, 1])
    return spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def ready(table):
    return ml.assemble(table, NAMES)


@pytest.fixture(scope="module")
def model(ready):
    return ml.elastic_logistic(300, c=100.0).fit(ready)


def prob(model, ready):
    return model.transform(ready).select("key", vector_to_array("probability")[1].alias("p")).toPandas().set_index("key")["p"]


def test_contributions_add_up_to_the_logit(model, ready, spark):
    table = {r.feature: r.coefficient for r in ex.coefficient_table(model, NAMES, spark).collect()}
    parts = ex.contributions(model, ready, "key", NAMES).toPandas().groupby("row")["contribution"].sum()
    p = prob(model, ready)
    assert np.allclose(1 / (1 + np.exp(-(parts + table["intercept"]))), p)


def test_importances_rank_the_features(model, ready):
    for hard in (True, False):
        got = {r.feature: r.importance for r in ex.permutation_importance(model, ready, "key", NAMES, "label", hard=hard).collect()}
        assert got["a"] > got["b"] > got["c"] - 1e-9
    assert abs(got["c"]) < 0.05


def test_partial_dependence_equals_direct_means(model, ready):
    got = ex.partial_dependence(model, ready, "key", NAMES, grid=3, chosen=[1]).toPandas().sort_values("step")
    x = np.array(ready.select(vector_to_array("features").alias("x")).toPandas()["x"].tolist())
    grid = np.linspace(*np.quantile(x[:, 1], [0.05, 0.95]), 3)
    coef, bias = model.coefficients.toArray(), model.intercept
    for (_, row), v in zip(got.iterrows(), grid):
        z = x.copy()
        z[:, 1] = v
        assert row["value"] == pytest.approx(v)
        assert row["mean"] == pytest.approx((1 / (1 + np.exp(-(z @ coef + bias)))).mean())


def test_shapley_values_add_up(model, ready):
    bg = ex.background_rows(ready, "key", size=1)
    got = ex.shapley(model, ready.limit(20), "key", NAMES, bg, orders=4).toPandas()
    base = np.array(ready.select(bg.alias("b")).first()["b"][0])
    coef, bias = model.coefficients.toArray(), model.intercept
    p0 = 1 / (1 + np.exp(-(base @ coef + bias)))
    p = prob(model, ready.limit(20))
    sums = got.groupby("row")["value"].sum()
    assert np.allclose(sums, p[sums.index] - p0)


def test_local_surrogate_and_surrogate(model, ready):
    got = ex.local_surrogate(model, ready.limit(10), "key", NAMES, samples=200).toPandas()
    means = got.groupby("feature")["weight"].mean()
    assert means["a"] > 0 > means["b"] and abs(means["c"]) < abs(means["b"])
    again = ex.local_surrogate(model, ready.limit(10).repartition(5), "key", NAMES, samples=200).toPandas()
    both = got.merge(again, on=["row", "feature"])
    assert np.allclose(both["weight_x"], both["weight_y"])
    coef, agree = ex.surrogate(model, ready, "key", NAMES)
    assert agree > 0.97 and {r.feature for r in coef.collect()} == {"intercept", *NAMES}


def test_regression_reports(table):
    drop = ml.drop_column_importance(table, NAMES, "target", ml.least_squares("target")).collect()
    assert [r.feature for r in drop[:2]] == ["a", "b"] and drop[2].importance == pytest.approx(0, abs=1e-6)
    forest = {r.feature: r for r in ml.forest_importance(table, NAMES, "target", "key", depth=6).collect()}
    assert forest["a"]["rank"] == 1 and forest["probe"].importance < forest["b"].importance
    variants = {r.variant: r.r2 for r in ml.binarized_variants(table, NAMES, "target", "a", ml.least_squares("target"), "key").collect()}
    assert variants["base"] == pytest.approx(1) and variants["replaced"] < variants["added"] + 1e-9


def test_folded_auc(ready):
    auc = ml.cross_auc(LogisticRegression(), ready, "label", "key")
    assert 0.9 < auc <= 1
    assert ml.cross_auc(LogisticRegression(), ready.repartition(3), "label", "key") == pytest.approx(auc, abs=1e-6)


def test_day_pipeline_and_grid(spark, tmp_path):
    rnd = np.random.default_rng(1)
    rows = [(f"s{i % 5}", f"2001-{1 + i % 12:02d}-15", float(i % 5), float(i % 3), 10.0, float(i % 12 + i % 5)) for i in range(240)]
    df = spark.createDataFrame(rows, "station string, date string, latitude double, longitude double, elevation double, tmax double").withColumn(
        "date", F.to_date("date")
    )
    model = ml.day_pipeline(rounds=5, depth=4).fit(df)
    ml.save_model(model, str(tmp_path / "m"))
    scored = ml.score(ml.load_model(str(tmp_path / "m")), df)
    assert ml.evaluate_regression(scored, "tmax")["r2"] > 0.9
    each = {r.station: r.error for r in ml.station_errors(scored, "station", "tmax").collect()}
    tops = {r.station: r.error for r in ml.station_errors(scored, "station", "tmax", max_first=True).collect()}
    assert each.keys() == tops.keys() and all(each[k] >= 0 for k in each)
    height = spark.createDataFrame([(float(a), float(o), 10.0) for a in range(5) for o in range(3)], "latitude double, longitude double, elevation double")
    grid = ml.grid_score(model, spark, "2001-06-15", (0, 4, 5), (0, 2, 3), height)
    assert grid.count() == 15 and grid.where("prediction IS NULL").count() == 0


def test_synthesized_features(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user long")
    orders = spark.createDataFrame([(10, 1, "2020-01-01 10:30:00"), (11, 1, "2020-02-03 11:00:00"), (12, 2, "2020-02-02 00:00:00")], "ord long, user long, t string").withColumn("t", F.to_timestamp("t"))
    items = spark.createDataFrame(
        [(100, 10, "x", 1.0, True), (101, 10, "y", 2.0, False), (102, 11, "y", 4.0, True), (103, 11, "x", 6.0, None)],
        "item long, ord long, name string, price double, again boolean",
    )
    tables = [
        sy.Table("users", users, "user"), sy.Table("orders", orders, "ord", time=["t"]),
        sy.Table("items", items, "item", numeric=["price"], category=["name"], boolean=["again"]),
    ]
    rels = [sy.Relation("users", "orders", "user"), sy.Relation("orders", "items", "ord")]
    out = {r["user"]: r for r in sy.synthesize(tables, rels, "users", parts=("DAY", "MINUTE"), median=True).collect()}
    one, two, three = out[1], out[2], out[3]
    assert one["COUNT(orders)"] == 2 and three["COUNT(orders)"] == 0
    assert one["MODE(items.name)"] == "x"  # two each: the smaller wins
    assert one["MODE(orders.MODE(items.name))"] == "x"
    assert one["SUM(orders.NUM_UNIQUE(items.name))"] == 4
    assert one["MEAN(items.price)"] == 3.25 and one["MEDIAN(items.price)"] == 3.0
    assert one["PERCENT_TRUE(items.again)"] == pytest.approx(2 / 3)
    assert one["STD(orders.SUM(items.price))"] == pytest.approx(np.std([3, 10], ddof=1))
    assert one["NUM_UNIQUE(orders.MINUTE(t))"] == 2
    assert two["SUM(items.price)"] == 0 and two["MEAN(items.price)"] is None
    top = sy.encode_top(items, "name", 1)
    assert {r.item: r["name = x"] for r in top.collect()} == {100: 1, 101: 0, 102: 0, 103: 1}
    skew = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double").agg(sy.bias_corrected_skew(F.col("v"))).first()[0]
    assert skew == pytest.approx(1.6301, abs=1e-4)


def test_features_of_four_levels(spark):
    from tablewright.operators import synth as sy

    a = spark.createDataFrame([(1,), (2,)], "a long")
    b = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "b long, a long")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "c long, b long")
    d = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 3, 1.0), (4, 4, 2.0)], "d long, c long, x double")
    tables = [sy.Table("a", a, "a"), sy.Table("b", b, "b"), sy.Table("c", c, "c"), sy.Table("d", d, "d", numeric=["x"])]
    relations = [sy.Relation("a", "b", "a"), sy.Relation("b", "c", "b"), sy.Relation("c", "d", "c")]
    two, three = sy.synthesize(tables, relations, "a", 2), sy.synthesize(tables, relations, "a", 3)
    assert set(two.columns) < set(three.columns)
    got = {r["a"]: r for r in three.collect()}
    # each d of 1 hangs from c 1 and 3, and those from b 1 and 2
    assert (got[1]["COUNT(d)"], got[1]["SUM(d.x)"], got[1]["MAX(b.SUM(c.SUM(d.x)))"]) == (3, 13.0, 12.0)
    assert (got[2]["COUNT(d)"], got[2]["MEAN(b.MEAN(d.x))"], got[2]["SUM(c.COUNT(d))"]) == (1, 2.0, 1)
