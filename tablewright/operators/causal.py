"""Average treatment effects by matching and by regression.

Tables hold ``id``, ``pos`` (row order, for ties), a 0/1 treatment, an outcome
and covariates.  Matches are ``(id, match_id, distance)``, one control each.
"""

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright.operators.models import assemble
from tablewright.plans.lineage import cut
from tablewright.plans.ordering import nearest_on_line
from tablewright.plans.skew import salted_join


def _arms(df, treatment):
    return df.where(F.col(treatment) == 1), df.where(F.col(treatment) == 0)


def match_exact(df, treatment, covariates, key="id", pos="pos"):
    """Controls with a treated row of equal covariates, the first by ``pos``."""
    treated, control = _arms(df, treatment)
    first = treated.groupBy(*covariates).agg(F.min_by(key, pos).alias("match_id"))
    return control.join(first, list(covariates)).select(
        key, "match_id", F.lit(0.0).alias("distance")
    )


def _cells(cols, reach):
    return {f"_g{i}": F.floor(F.col(c) / reach) for i, c in enumerate(cols)}


def _widest(points, covariates, count=2):
    """The covariates with the largest range; one row reaches the driver."""
    row = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in covariates]).first()
    return sorted(covariates, key=lambda c: -(row[c] or 0.0))[:count]


def _search_levels(points, grid, radius, shrink, cell_rows, most=10):
    """How often to shrink the radius until no cell holds too many points."""
    fullest = None
    for level in range(most):
        cells = points.groupBy(*_cells(grid, radius / shrink**level).values()).agg(F.count(F.lit(1)).alias("n"))
        now = cells.agg(F.max("n")).first()[0] or 0
        if now <= cell_rows or (level > 1 and now == fullest):
            return level + 1
        fullest = now
    return most


def match_nearest(
    df, treatment, covariates, radius, key="id", pos="pos", grid=None, levels=None, shrink=8.0, cell_rows=1000
):
    """Controls with their nearest treated row closer than ``radius``.

    Exact, without pairing everything.  Space is cut into cells as wide as the
    search radius along the ``grid`` columns; a control meets the treated rows
    of its own and the neighbouring cells.  The search starts with a small
    radius and widens by ``shrink`` up to the asked one, for controls not yet
    matched: a hit closer than the cell width cannot be beaten from farther
    cells.  The first radius is such that no cell holds more than
    ``cell_rows`` treated points (or is given by ``levels``), so dense regions
    are settled in small cells.  Equal covariate vectors are collapsed on both
    sides.  ``grid`` defaults to the two covariates with the largest range.
    Ties go to the smallest ``pos``.
    """
    covariates = list(covariates)
    treated, control = _arms(df, treatment)
    kinds = {c: F.col(c).cast("double").alias(c) for c in covariates}
    points = treated.select(*kinds.values(), key, pos).dropna(subset=covariates).groupBy(*covariates).agg(
        F.min(pos).alias("_pos"), F.min_by(key, pos).alias("match_id")
    )
    asked = control.select(*kinds.values()).dropna().distinct()
    points, open_ = cut(points), cut(asked)
    grid = list(grid or _widest(points, covariates))
    levels = levels or _search_levels(points, grid, radius, shrink, cell_rows)
    found = []
    for level in range(levels - 1, -1, -1):
        reach = radius / shrink**level
        cells = _cells(grid, reach)
        here = points.select(*[F.col(c).alias("t_" + c) for c in covariates], "_pos", "match_id", *[e.alias(n) for n, e in cells.items()])
        near = open_.select(*covariates, *[e.alias(n) for n, e in cells.items()])
        for n in cells:
            near = near.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
        gap = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col("t_" + c), 2) for c in covariates]))
        hits = (
            salted_join(near, here, list(cells))
            .withColumn("distance", gap)
            .where(F.col("distance") < reach)
            .groupBy(*covariates)
            .agg(F.min(F.struct("distance", "_pos", "match_id")).alias("_hit"))
            .select(*covariates, "_hit.distance", "_hit.match_id")
        )
        hits = cut(hits)
        found.append(hits)
        if level:
            open_ = cut(open_.join(hits, covariates, "left_anti"))
    best = reduce(lambda a, b: a.unionByName(b), found)
    full = control.select(key, *kinds.values())
    return full.join(best, covariates).select(key, "match_id", "distance")


def match_score(df, treatment, score, caliper=None, key="id", pos="pos", arm=0):
    """Rows of one arm with the nearest row of the other on a score.

    ``arm`` 0 matches controls to treated rows, 1 the other way round.
    """
    treated, control = _arms(df, treatment)
    left, right = (control, treated) if arm == 0 else (treated, control)
    right = right.select(score, F.col(pos).alias("pos"), F.col(key).alias("match_id")).dropna(subset=[score])
    near = nearest_on_line(left, right, score, ["match_id"])
    if caliper is not None:
        near = near.where(F.col("distance") < caliper)
    return left.join(near.drop("pos"), score).select(key, "match_id", "distance")


def matched_outcomes(matches, df, outcome, key="id"):
    """Matches with both outcomes, looked up by id."""
    y = df.select(F.col(key), F.col(outcome).cast("double").alias("y"))
    other = y.select(F.col(key).alias("match_id"), F.col("y").alias("y_match"))
    return matches.join(y, key).join(other, "match_id")


def ate_of_matches(matches, df, treatment, outcome, key="id"):
    """One row: matched controls, their share in percent, mean difference."""
    pairs = matched_outcomes(matches, df, outcome, key)
    controls = df.agg(F.count_if(F.col(treatment) == 0)).scalar()
    return pairs.agg(
        F.count(F.lit(1)).alias("matched"), F.avg(F.col("y_match") - F.col("y")).alias("ate")
    ).withColumn("_controls", controls).select(
        "matched", F.try_divide(100.0 * F.col("matched"), "_controls").alias("share_pct"), "ate"
    )


def propensity(df, treatment, predictors, out="score", c=1.0, max_iter=100, tol=1e-6):
    """Probability of treatment by logistic regression, penalty ``1 / (c n)``.

    The outcome should not be among the predictors.
    """
    ready = assemble(df, predictors, "_x").withColumn("_t", F.col(treatment).cast("double"))
    n = ready.count()
    model = LogisticRegression(
        featuresCol="_x", labelCol="_t", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    ).fit(ready)
    return model.transform(ready).withColumn(out, vector_to_array("probability")[1]).drop(
        "_x", "_t", "rawPrediction", "probability", "prediction"
    )


def two_model_ate(df, treatment, outcome, covariates):
    """Two linear models, each predicting the other arm: ``ate``."""
    ready = assemble(df, covariates, "_x").withColumn("_y", F.col(outcome).cast("double"))
    treated, control = _arms(ready, treatment)
    fit = lambda rows, out: LinearRegression(
        featuresCol="_x", labelCol="_y", predictionCol=out, solver="normal"
    ).fit(rows)
    on_treated, on_control = fit(treated, "_p1"), fit(control, "_p0")
    both = on_control.transform(on_treated.transform(ready))
    gain = F.when(F.col(treatment) == 1, F.col("_y") - F.col("_p0")).otherwise(F.col("_p1") - F.col("_y"))
    return both.agg(F.avg(gain).alias("ate"))


def two_line_ate(df, treatment, outcome, covariate):
    """As ``two_model_ate`` for one covariate, in one aggregate pass."""
    x, y, t = F.col(covariate).cast("double"), F.col(outcome).cast("double"), F.col(treatment)
    when = lambda arm, c: F.when(t == arm, c)
    parts = df.dropna(subset=[covariate, outcome]).agg(
        *[
            f.alias(f"{n}{arm}")
            for arm in (0, 1)
            for n, f in (
                ("s", F.regr_slope(when(arm, y), when(arm, x))),
                ("i", F.regr_intercept(when(arm, y), when(arm, x))),
                ("x", F.sum(when(arm, x))),
                ("y", F.sum(when(arm, y))),
                ("n", F.count(when(arm, y))),
            )
        ]
    )
    gain_treated = F.col("y1") - (F.col("s0") * F.col("x1") + F.col("i0") * F.col("n1"))
    gain_control = F.col("s1") * F.col("x0") + F.col("i1") * F.col("n0") - F.col("y0")
    return parts.select(((gain_treated + gain_control) / (F.col("n0") + F.col("n1"))).alias("ate"))


def backdoor_linear(df, treatment, outcome, causes):
    """Coefficient of the treatment in a linear model with the causes."""
    ready = df.withColumn("_t", F.col(treatment).cast("double"))
    ready = assemble(ready, ["_t", *causes], "_x").withColumn("_y", F.col(outcome).cast("double"))
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal").fit(ready)
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]),)], "ate double")


def backdoor_matching(df, treatment, outcome, causes, key="id", pos="pos", **fit):
    """Propensity matching of both arms, weighted by their sizes."""
    scored = cut(propensity(df, treatment, causes, "_score", **fit))
    effects = [
        matched_outcomes(match_score(scored, treatment, "_score", None, key, pos, arm), scored, outcome, key)
        .select((sign * (F.col("y_match") - F.col("y"))).alias("gain"))
        for arm, sign in ((0, 1), (1, -1))
    ]
    return effects[0].unionByName(effects[1]).agg(F.avg("gain").alias("ate"))


def common_causes(edges, treatment, outcome):
    """Parents of both treatment and outcome in an edge table ``(src, dst)``."""
    into = lambda node: edges.where(F.col("dst") == node).select("src").distinct()
    return into(treatment).join(into(outcome), "src").select(F.col("src").alias("cause"))
