import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.sampling import hash_uniform, split_by_hash
from tablewright.operators import stats as st, table as tb


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_hash_uniform_is_the_plain_formula(spark):
    df = spark.createDataFrame([(3, 42)], "i int, p int")
    assert df.select(hash_uniform(7, "i", "p")).first()[0] == u(7, 3, 42)


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(500)
    parts = [{r.id: r.part for r in split_by_hash(df.repartition(n), [3, 1], "id").collect()} for n in (1, 8)]
    assert parts[0] == parts[1]
    assert 0.2 < sum(parts[0].values()) / 500 < 0.3


@pytest.mark.parametrize("partitions", [1, 8])
def test_bootstrap_equals_direct_resampling(spark, partitions):
    rnd = np.random.default_rng(0)
    v = np.where(rnd.random(101) < 0.3, 5.0, np.round(rnd.normal(0, 10, 101), 2))
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "id long, v double").repartition(partitions)
    order = sorted(range(101), key=lambda i: (v[i], i))
    ranked = [v[i] for i in order]
    got = {r.iter: r.estimate for r in st.bootstrap_quantile(df, "v", "id", resamples=40).collect()}
    want = {b: np.median([ranked[int(u(7, b, j) * 101)] for j in range(101)]) for b in range(1, 41)}
    assert got == pytest.approx(want)
    ci = st.bootstrap_interval(df, "v", "id", resamples=40).first()
    diffs = sorted(w - np.median(v) for w in want.values())
    assert ci.estimate == pytest.approx(np.median(v))
    assert (ci.low, ci.high) == (pytest.approx(np.median(v) - diffs[39]), pytest.approx(np.median(v) - diffs[1]))


def mixed(i, seed, key):
    """Draw i of a row, in plain integers."""
    def mix(x):
        x ^= x >> 16
        x = x * 0x85EBCA6B % 2**32
        x ^= x >> 13
        x = x * 0xC2B2AE35 % 2**32
        return x ^ x >> 16

    word = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    return mix((mix(int(word[:8], 16) ^ i * 0x9E3779B1 % 2**32) + int(word[8:16], 16)) % 2**32)


@pytest.mark.parametrize("slices, n", [(4, 60), (32, 60), (32, 7), (1, 300)])
def test_permutation_equals_direct_shuffling(spark, slices, n):
    rnd = np.random.default_rng(1)
    rows = [(i, "A" if i % 3 == 0 else "B", float(np.round(rnd.normal(i % 3, 2), 2))) for i in range(n)]
    more = [(1000, "C", 1.0), (1001, "A", None), (1002, None, 2.0)]
    df = spark.createDataFrame(rows + more, "id long, g string, v double")
    got = {r.iter: r.difference for r in st.permutation_differences(df, "g", "A", "B", "v", "id", 30, slices=slices).collect()}
    n_a = sum(g == "A" for _, g, _ in rows)
    total = sum(v for *_, v in rows)
    for b in range(1, 31):
        first = sorted(rows, key=lambda r: (mixed(b, 7, r[0]), r[0]))[:n_a]
        s = sum(v for *_, v in first)
        assert got[b] == pytest.approx((total - s) / (n - n_a) - s / n_a)
    test = st.permutation_test(df, "g", "A", "B", "v", "id", shuffles=30).first()
    assert test.p_value == pytest.approx(np.mean([d >= test.difference for d in got.values()]))


def test_permutation_without_a_second_group(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, "A", 2.0)], "id long, g string, v double")
    assert [tuple(r) for r in st.permutation_differences(df, "g", "A", "B", "v", "id", 2).orderBy("iter").collect()] == [(1, None), (2, None)]
    assert st.permutation_test(df, "g", "A", "B", "v", "id", shuffles=2).first().p_value is None


@pytest.mark.parametrize("n", [50, 2500])
def test_bootstrap_sums_equal_direct_resampling(spark, n):
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=n), rnd.normal(size=n)
    rows = [(i * 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(-1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(5)
    got = {r.iter: r for r in st.bootstrap_sums(df, {"sx": "x", "sxy": "x * y"}, "id", 12).collect()}
    for b in range(1, 13):
        idx = [mixed(b, 7, j) * n >> 32 for j in range(n)]
        assert (got[b].n, got[b].sx, got[b].sxy) == (n, pytest.approx(x[idx].sum()), pytest.approx((x * y)[idx].sum()))


def test_interval_of_a_correlation(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=200)
    y = x + rnd.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    ci = st.bootstrap_statistic_interval(df, st.MOMENTS, st.CORRELATION, "id", 200).first()
    drawn = [[mixed(b, 7, j) * 200 >> 32 for j in range(200)] for b in range(1, 201)]
    whole = np.corrcoef(x, y)[0, 1]
    diffs = sorted(np.corrcoef(x[i], y[i])[0, 1] - whole for i in drawn)
    assert (ci.estimate, ci.low, ci.high) == pytest.approx((whole, whole - diffs[195], whole - diffs[5]))


def test_chi_squared_with_an_empty_cell(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 7
    got = st.chi_squared(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = np.array([[10, 5], [7, 0]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert got.statistic == pytest.approx(((o - e) ** 2 / e).sum())
    assert (got.dof, got.critical) == (1, 3.841)
    many = spark.createDataFrame([(i % 12, i % 2) for i in range(1200)], "r int, c int")
    wide = st.chi_squared(many, "r", "c").first()
    assert (wide.dof, wide.statistic, wide.critical, wide.dependent) == (11, pytest.approx(1200), 19.675, True)
    even = st.chi_squared(spark.createDataFrame([(i % 12, i % 7) for i in range(84)], "r int, c int"), "r", "c").first()
    assert even.p_value == pytest.approx(1) and even.dof == 66 and not even.dependent
    flat = st.chi_squared(spark.createDataFrame([("a", "x"), ("a", "y")], "r string, c string"), "r", "c").first()
    assert flat.dof == 0 and flat.critical is None


def test_log_loss_on_hard_labels(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "y double, p double")
    assert df.agg(st.log_loss("y", "p")).first()[0] == pytest.approx(-np.log(1e-15) / 2, rel=1e-2)


def test_group_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 4.0), (3, "b", 9.0)], "id long, g string, v double")
    assert {r["column"]: r.missing_pct for r in tb.missing_share(df, ["v"]).collect()} == {"v": pytest.approx(100 / 3)}
    assert {r.id: r.h for r in tb.binarize_at_mean(df, "v", "h").collect()} == {1: None, 2: 0, 3: 1}
    assert {r.id: r.s for r in tb.add_sum(df, "s", "id", "v").collect()} == {1: None, 2: 6.0, 3: 12.0}
    assert tb.mean_difference(df, "g", "a", "b", "v").first().difference == 5.0
    assert tb.group_count(df, "g", "v", at_least=1).count() == 2
    wide = {r.g: (r.x, r.All) for r in tb.crosstab_wide(df.withColumn("c", F.lit("x")), "g", "c").collect()}
    assert wide == {"a": (2, 2), "b": (1, 1), "All": (3, 3)}
    assert [r.id for r in tb.all_but_last(tb.with_position(df, "id"), 1, "pos").orderBy("id").collect()] == [1, 2]
    scores = spark.createDataFrame([("label", 1.0), ("x", 0.4), ("y", -0.9)], "f string, s double")
    assert [r.f for r in tb.rank_slice(scores, "s", "f", "label", 1).collect()] == ["x"]
    assert [r.f for r in tb.rank_slice(scores, "s", "f", "label", 1, by_abs=True).collect()] == ["y"]


def test_spearman_matrix_with_missing_cells(spark):
    rnd = np.random.default_rng(2)
    x = np.round(rnd.normal(size=(80, 5)), 1)
    x[:, 1] += x[:, 0]
    x[:20, 2] = x[:20, 3] = np.nan
    x[70:, 4] = np.nan
    cells = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    df = spark.createDataFrame(cells, ", ".join(f"{c} double" for c in "abcde"))
    import pandas as pd

    want = pd.DataFrame(x, columns=list("abcde")).corr(method="spearman")
    got = {(r.col_x, r.col_y): r.spearman for r in st.spearman_matrix(df, list("abcde")).collect()}
    assert len(got) == 10 and all(v == pytest.approx(want.loc[k]) for k, v in got.items())


def test_permuted_is_a_bijection():
    from tablewright.functions import draws

    for n in (1, 2, 3, 17, 1000, 4097):
        to = draws.permuted(np.arange(n), n, 7)
        assert sorted(to.tolist()) == list(range(n))
    assert (draws.permuted(np.arange(1000), 1000, 7) != np.arange(1000)).mean() > 0.98
    assert (draws.permuted(np.arange(1000), 1000, 7) != draws.permuted(np.arange(1000), 1000, 8)).mean() > 0.98


def test_draws_of_sums_are_made_where_the_rows_are(spark, monkeypatch):
    monkeypatch.setattr(st, "PART", 700)
    n = 2500
    x = np.random.default_rng(4).normal(size=n)
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "id long, x double")
    drawn = st.bootstrap_sums(df, {"sx": "x"}, "id", 12)
    assert "CoGroup" not in drawn._jdf.queryExecution().toString()
    got = {r.iter: r.sx for r in drawn.collect()}
    assert got == {b: pytest.approx(x[[mixed(b, 7, j) * n >> 32 for j in range(n)]].sum()) for b in range(1, 13)}


@pytest.mark.parametrize("spread, prob", [(0.0, 0.5), (0.3, 0.9), (6.0, 0.25)])
def test_quantiles_outside_the_window_of_draws(spark, spread, prob):
    v = np.round(np.random.default_rng(6).normal(0, 10, 400), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    ranked = [v[i] for i in sorted(range(400), key=lambda i: (v[i], i))]
    got = {r.iter: r.estimate for r in st.bootstrap_quantile(df, "v", "id", prob, 20, spread=spread).collect()}
    want = {b: np.quantile([ranked[int(u(7, b, j) * 400)] for j in range(400)], prob) for b in range(1, 21)}
    assert got == pytest.approx(want)
    assert st.bootstrap_quantile(df.where("id < 0"), "v", "id", prob, 20, spread=spread).count() == 0
