import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import stats as st, table as tb
from tablewright.plans.ordering import exact_quantiles, nearest_on_line, numbered, with_range


def skewed(seed=0, n=3000):
    rnd = np.random.default_rng(seed)
    v = np.where(rnd.random(n) < 0.35, 7.0, np.round(rnd.normal(0, 50, n), 2))
    g = np.where(rnd.random(n) < 0.4, "hot", rnd.integers(0, 9, n).astype(str))
    return pd.DataFrame({"id": np.arange(n), "g": g, "v": v})


def test_quantiles_with_a_hot_group_and_a_hot_value(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9], ["g"]).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.1, 0.25, 0.5, 0.9]).unstack()
    for a, b in zip(["q10", "q25", "q50", "q90"], want.columns):
        assert np.allclose(got[a].sort_index(), want[b].sort_index())
    one = exact_quantiles(df, "v", [0.5]).first()["q50"]
    assert one == pytest.approx(pdf["v"].median())


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert exact_quantiles(df, "v", [0.5]).first()["q50"] is None
    assert exact_quantiles(df, "v", [0.5], ["id"]).count() == 0


def test_numbered_on_many_types(spark):
    pdf = skewed(1, 500)
    pdf["s"] = [f"k{i % 77:03d}" for i in range(500)]
    df = spark.createDataFrame(pdf).repartition(7)
    got = numbered(df, ["v", "id"]).toPandas().sort_values("rn")
    want = pdf.sort_values(["v", "id"])
    assert got["id"].tolist() == want["id"].tolist() and got["rn"].tolist() == list(range(1, 501))
    pdf["s"] = "prefix-longer-than-seven#" + pdf["s"]
    df = spark.createDataFrame(pdf)
    ranged = with_range(df, "s", 16).groupBy("_range").count().toPandas()
    assert len(ranged) > 8 and ranged["count"].max() < 150
    got = numbered(df, ["s", "id"]).toPandas().sort_values("rn")
    assert got["id"].tolist() == pdf.sort_values(["s", "id"])["id"].tolist()


def test_ranks_and_correlations(spark):
    pdf = skewed(2)
    pdf["w"] = pdf["v"] * 0.5 + np.random.default_rng(3).normal(0, 20, len(pdf)).round(1)
    pdf.loc[::17, "w"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    full = pdf.dropna()
    rank = full["v"].rank().corr(full["w"].rank())
    assert st.spearman(df, "v", "w").first()[0] == pytest.approx(rank)
    assert st.pearson(df, "v", "w").first()[0] == pytest.approx(full["v"].corr(full["w"]))
    got = {(r.col_x, r.col_y): r.spearman for r in st.spearman_matrix(df, ["id", "v", "w"]).collect()}
    assert got["v", "w"] == pytest.approx(rank)
    assert got["id", "v"] == pytest.approx(pdf["id"].rank().corr(pdf["v"].rank()))
    down = st.descending_ranks(df, "v").toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(down, pdf["v"].rank(ascending=False))
    n = len(pdf)
    assert down.sum() == pytest.approx(n * (n + 1) / 2)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_on_line(spark, seed):
    rnd = np.random.default_rng(seed)
    left = np.round(rnd.normal(0, 3, 300), 1)
    right = np.round(rnd.normal(1, 3, 90), 1)
    pos = rnd.permutation(90)
    a = spark.createDataFrame(pd.DataFrame({"s": left}))
    b = spark.createDataFrame(pd.DataFrame({"s": right, "pos": pos, "name": [f"n{p}" for p in pos]}))
    got = {r.s: (r.distance, r.pos, r.name) for r in nearest_on_line(a, b, "s", ["name"]).collect()}
    assert got.keys() == set(left)
    for s, (d, p, name) in got.items():
        gaps = np.abs(right - s)
        assert d == pytest.approx(gaps.min())
        near = {q for q, g in zip(pos, gaps) if abs(g - gaps.min()) < 1e-9}
        assert p in near and name == f"n{p}"


def test_describe_histogram_hexbin(spark):
    pdf = skewed(4)
    df = spark.createDataFrame(pdf)
    got = tb.describe(df, ["v", "id"]).toPandas().set_index("column")
    want = pdf[["v", "id"]].describe().T
    for a, b in {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}.items():
        assert np.allclose(got[a].sort_index().astype(float), want[b].sort_index())
    bins = tb.histogram(df, "v", 30).toPandas().sort_values("bin")
    counts, edges = np.histogram(pdf["v"], 30)
    assert abs(bins["n"].to_numpy() - counts).sum() <= 2  # values on an edge may fall either way
    assert np.allclose(bins["low"], edges[:-1])
    constant = tb.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).toPandas()
    assert constant["n"].sum() == 2
    cells = tb.hexbin(df, "id", "v", 20)
    assert cells.agg(F.sum("n")).first()[0] == len(pdf)
