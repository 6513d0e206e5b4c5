import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import causal as ca
from tablewright.sources import readers

COV = ["x", "y", "z"]


def cohort(seed, n=240):
    rnd = np.random.default_rng(seed)
    hot = rnd.random(n) < 0.35  # a third of all rows share one covariate vector
    return pd.DataFrame(
        {
            "id": [f"k{i:03d}" for i in range(n)],
            "pos": rnd.permutation(n),
            "treat": (rnd.random(n) < 0.4).astype(int),
            "x": np.where(hot, 0.0, np.round(rnd.normal(0, 30, n), 1)),
            "y": np.where(hot, 0.0, np.round(rnd.normal(0, 10, n))),
            "z": np.where(hot, 1.0, rnd.integers(0, 3, n)),
            "out": np.round(rnd.normal(100, 20, n), 2),
        }
    )


def brute(pdf, cols, limit):
    treated, control = pdf[pdf.treat == 1].sort_values("pos"), pdf[pdf.treat == 0]
    out = {}
    for _, c in control.iterrows():
        d = np.sqrt(((treated[cols].to_numpy() - c[cols].to_numpy(dtype=float)) ** 2).sum(axis=1))
        if d.min() < limit:
            out[c.id] = treated.iloc[int(np.argmin(d))].id
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("cell_rows", [1000, 2])
def test_nearest_equals_brute_force(spark, seed, cell_rows):
    pdf = cohort(seed)
    df = spark.createDataFrame(pdf)
    got = {r.id: r.match_id for r in ca.match_nearest(df, "treat", COV, 12.0, cell_rows=cell_rows).collect()}
    assert got == brute(pdf, COV, 12.0)


def test_exact_is_nearest_at_zero(spark):
    pdf = cohort(5)
    df = spark.createDataFrame(pdf)
    got = {r.id: r.match_id for r in ca.match_exact(df, "treat", COV).collect()}
    assert got == brute(pdf, COV, 1e-9)
    none = ca.ate_of_matches(ca.match_exact(df.where("treat = 0"), "treat", COV), df, "treat", "out").first()
    assert none.matched == 0 and none.ate is None


@pytest.mark.parametrize("arm", [0, 1])
def test_score_matching(spark, arm):
    pdf = cohort(7)
    df = spark.createDataFrame(pdf)
    flip = pdf.assign(treat=1 - pdf.treat) if arm else pdf
    got = {r.id: r.distance for r in ca.match_score(df, "treat", "x", 2.0, arm=arm).collect()}
    want = brute(flip, ["x"], 2.0)
    assert got.keys() == want.keys()
    x = pdf.set_index("id")["x"]
    assert all(got[k] == pytest.approx(abs(x[k] - x[m])) for k, m in want.items())


def test_two_models_and_backdoor(spark):
    pdf = cohort(9)
    df = spark.createDataFrame(pdf)
    fit = lambda d: np.linalg.lstsq(np.c_[np.ones(len(d)), d[["x"]]], d["out"], rcond=None)[0]
    t, c = pdf[pdf.treat == 1], pdf[pdf.treat == 0]
    b1, b0 = fit(t), fit(c)
    gain = np.r_[t.out - (b0[0] + b0[1] * t.x), b1[0] + b1[1] * c.x - c.out].mean()
    assert ca.two_model_ate(df, "treat", "out", ["x"]).first().ate == pytest.approx(gain)
    assert ca.two_line_ate(df, "treat", "out", "x").first().ate == pytest.approx(gain)
    full = np.linalg.lstsq(np.c_[np.ones(len(pdf)), pdf[["treat", "x", "y"]]], pdf["out"], rcond=None)[0]
    assert ca.backdoor_linear(df, "treat", "out", ["x", "y"]).first().ate == pytest.approx(full[1])
    assert ca.backdoor_matching(df, "treat", "out", ["x", "y"]).first().ate is not None


def test_common_causes(spark):
    edges = [("age", "treat"), ("age", "pay"), ("married", "treat"), ("married", "pay"), ("treat", "pay"), ("luck", "pay")]
    got = ca.common_causes(spark.createDataFrame(edges, "src string, dst string"), "treat", "pay")
    assert {r.cause for r in got.collect()} == {"age", "married"}


@pytest.mark.skipif("JOB_TRAINING_CSV" not in os.environ, reason="needs the public job-training table")
def test_job_training_estimates(spark):
    """The well-known 614-row job-training table; set JOB_TRAINING_CSV to its path."""
    schema = "id string, treat int, age int, educ int, black int, hispan int, married int, nodegree int, re74 double, re75 double, re78 double"
    df = readers.csv_in_order(spark, os.environ["JOB_TRAINING_CSV"], schema).cache()
    cov = ["age", "educ", "black", "hispan", "married", "nodegree", "re74", "re75"]
    ate = lambda m: tuple(ca.ate_of_matches(m, df, "treat", "re78").first())
    assert ate(ca.match_exact(df, "treat", cov)) == pytest.approx((12, 2.797203, 1362.394), rel=1e-6)
    near = ca.match_nearest(df, "treat", cov, 1000, grid=["re74", "re75"])
    assert ate(near) == pytest.approx((318, 74.125874, 519.181341), rel=1e-6)
    scored = ca.propensity(df, "treat", [*cov, "re78"], max_iter=5000, tol=1e-12)
    assert ate(ca.match_score(scored, "treat", "score", 0.01)) == pytest.approx((383, 89.277389, -1363.7628), rel=1e-6)
    assert ca.two_model_ate(df, "treat", "re78", cov).first().ate == pytest.approx(1074.908541)
    causes = ["nodegree", "black", "hispan", "age", "educ", "married"]
    assert ca.backdoor_linear(df, "treat", "re78", causes).first().ate == pytest.approx(1163.922355)
