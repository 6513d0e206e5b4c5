from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor

from tablewright.operators import explain as ex, models as ml

NAMES = ["a", "b", "c", "d", "e"]


def table(spark, n=300):
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(n, 5)), 2)
    y = x[:, 0] * 2 + x[:, 1] * x[:, 2] + (x[:, 3] > 0) - 0.5 * x[:, 4] + r.normal(0, 0.1, n)
    rows = [(i, *map(float, v), float(t), float(t > 0)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double, label double")
    return ml.assemble(df, NAMES), x


def score(tree, row, known):
    """Value of a tree when only some features are known, by recursion."""
    weight, feature, threshold, left, right, value, cover = tree

    def at(n):
        if feature[n] < 0:
            return value[n]
        if feature[n] in known:
            return at(left[n] if row[feature[n]] <= threshold[n] else right[n])
        return (cover[left[n]] * at(left[n]) + cover[right[n]] * at(right[n])) / cover[n]

    return weight * at(0)


def enumerated(trees, row):
    game = {}
    for k in range(6):
        for s in combinations(range(5), k):
            game[s] = sum(score(t, row, set(s)) for t in trees)
    out = []
    for i in range(5):
        total = 0.0
        for s in game:
            if i not in s:
                more = tuple(sorted((*s, i)))
                total += (game[more] - game[s]) * factorial(len(s)) * factorial(4 - len(s)) / factorial(5)
        out.append(total)
    return out, game[()]


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_equals_enumeration_of_all_subsets(spark, kind):
    df, x = table(spark)
    if kind == "boosted":
        model = ml.boosted_classifier(maxIter=8, maxDepth=5).fit(df)
    else:
        model = RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=7, seed=3).fit(df)
    trees = ex.tree_arrays(model)
    got = {}
    for r in ex.tree_shapley(trees, df, "id", NAMES).collect():
        got.setdefault(r.row, {})[r.feature] = (r.value, r.base)
    assert len(got) == 300
    for i in range(0, 300, 23):
        want, base = enumerated(trees, x[i])
        assert [got[i][n][0] for n in NAMES] == pytest.approx(want, abs=1e-9)
        assert got[i]["a"][1] == pytest.approx(base)
    raw = {r.id: r.s for r in model.transform(df).selectExpr("id", "rawPrediction" if kind == "boosted" else "prediction").toDF("id", "s").collect()}
    for i, one in got.items():
        whole = raw[i][1] if kind == "boosted" else raw[i]
        assert sum(v for v, _ in one.values()) + one["a"][1] == pytest.approx(whole, abs=1e-9)


def test_a_feature_that_a_path_asks_twice_and_missing_values(spark):
    tree = (1.0, np.array([0, -1, 0, -1, -1]), np.array([0.0, 0, 1.0, 0, 0]), np.array([1, -1, 3, -1, -1]),
            np.array([2, -1, 4, -1, -1]), np.array([0.0, 1.0, 0, 5.0, 9.0]), np.array([10.0, 4, 6, 3, 3]))
    values, base = ex._path_values(list(ex._leaves(tree)), np.array([[-1.0, 7.0], [0.5, 7.0], [np.inf, 7.0]]))
    assert base == pytest.approx(0.4 + 1.5 + 2.7)
    assert values[:, 0] == pytest.approx(np.array([1.0, 5.0, 9.0]) - base) and not values[:, 1].any()


def test_a_single_leaf_and_an_empty_table(spark):
    df, _ = table(spark, 5)
    stump = (2.0, np.array([-1]), np.array([0.0]), np.array([-1]), np.array([-1]), np.array([3.0]), np.array([5.0]))
    got = ex.tree_shapley([stump], df, "id", NAMES).collect()
    assert len(got) == 25 and all((r.value, r.base) == (0.0, 6.0) for r in got)
    assert ex.tree_shapley([stump], df.limit(0), "id", NAMES).collect() == []
