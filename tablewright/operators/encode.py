"""Feature encoding, scaling and boxes."""

from pyspark.sql import functions as F
from tablewright.plans.ordering import numbered
from tablewright.plans.skew import null_safe


def one_hot(df, features, indices, pos, out=None):
    """One-hot of chosen positions of an array of strings.

    Levels are ordered by first appearance; the new dimensions come first, in
    the order of ``indices``, the other positions after them.  The levels make
    up the width of every output row: use ``one_hot_sparse`` where they are many.
    """
    f = F.col(features)
    cells = F.array(*[F.struct(F.lit(n).alias("o"), F.get(f, F.lit(i)).alias("v")) for n, i in enumerate(indices)])
    levels = (
        df.select(pos, F.inline(cells)).groupBy("o", "v").agg(F.min(pos).alias("p"))
    )
    small = levels.agg(F.array_sort(F.collect_list(F.struct("o", "p", "v"))))
    positions = F.array(*[F.lit(i) for i in indices])
    coded = F.transform(
        "_levels",
        lambda d: F.when(d["v"].eqNullSafe(F.get(f, F.get(positions, d["o"]))), 1.0).otherwise(0.0),
    )
    rest = F.transform(
        F.filter(f, lambda x, i: ~F.array_contains(positions, i)), lambda x: x.cast("double")
    )
    return df.withColumn("_levels", small.scalar()).withColumn(out or features, F.concat(coded, rest)).drop("_levels")


def one_hot_sparse(df, features, indices, key, pos, out=None):
    """As ``one_hot`` for any number of levels: ``struct(indices, values)`` of the cells that are not 0.

    The levels stay a table; they are numbered in their order without a global
    window and joined to the cells.  ``key`` tells the rows apart.  Each row
    also has ``width``, the length of the dense form.
    """
    f = F.col(features)
    cells = F.array(*[F.struct(F.lit(n).alias("o"), F.get(f, F.lit(i)).alias("v")) for n, i in enumerate(indices)])
    own = df.select(key, pos, F.inline(cells))
    levels = own.groupBy("o", "v").agg(F.min(pos).alias("p"))
    coded = numbered(levels, ["p", "o"], "n", by=["o"]).select("o", "v", "n")
    sizes = levels.groupBy("o").agg(F.count(F.lit(1)).alias("levels"))  # a row for each position
    before = sizes.join(sizes.select(F.col("o").alias("b"), F.col("levels").alias("l")), F.col("b") < F.col("o"), "left")
    before = before.groupBy("o").agg(F.coalesce(F.sum("l"), F.lit(0)).alias("before"))
    placed = null_safe(own.select(key, "o", "v"), coded, ["o", "v"]).join(before, "o")
    hot = placed.groupBy(key).agg(F.sort_array(F.collect_list((F.col("before") + F.col("n") - 1).cast("int"))).alias("_hot"))
    positions = F.array(*[F.lit(i) for i in indices])
    rest = F.transform(F.filter(f, lambda x, i: ~F.array_contains(positions, i)), lambda x: x.cast("double"))
    total = sizes.agg(F.sum("levels").cast("int")).scalar()
    wide = null_safe(df, hot, [key]).withColumn("_levels", total).withColumn("_rest", rest)
    kept = F.filter(F.sequence(F.lit(1), F.size("_rest")), lambda i: ~F.coalesce(F.get("_rest", i - 1) == 0, F.lit(False)))
    kept = F.when(F.size("_rest") > 0, kept).otherwise(F.array().cast("array<int>"))
    value = F.struct(
        F.concat("_hot", F.transform(kept, lambda i: i - 1 + F.col("_levels"))).alias("indices"),
        F.concat(F.transform("_hot", lambda _: F.lit(1.0)), F.transform(kept, lambda i: F.get("_rest", i - 1))).alias("values"),
    )
    wide = wide.withColumn("width", F.col("_levels") + F.size("_rest"))
    return wide.withColumn(out or features, value).drop("_hot", "_rest", "_levels")


def standardize(df, features, indices, out=None):
    """(x - mean) / sample std of chosen positions; constants become 0.

    Missing values become 0 at every position.
    """
    f = F.col(features)
    picked = [F.get(f, F.lit(i)) for i in indices]
    moments = df.agg(
        F.map_from_arrays(
            F.array(*[F.lit(i) for i in indices]),
            F.array(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")) for c in picked]),
        )
    )
    m = F.col("_moments")

    def scaled(x, i):
        own = F.try_element_at(m, i)
        z = F.coalesce(F.try_divide(x - own["m"], own["s"]), F.lit(0.0))
        return F.when(own.isNull(), F.coalesce(x, F.lit(0.0))).otherwise(z)

    return df.withColumn("_moments", moments.scalar()).withColumn(
        out or features, F.transform(f, scaled)
    ).drop("_moments")


def standardize_cells(df, features, out=None):
    """All cells of an array column by one mean and population std; missing cells stay missing and do not count."""
    f = F.transform(F.col(features), lambda x: x.cast("double"))
    there = F.filter(f, lambda x: x.isNotNull())
    fold = lambda fn: F.aggregate(there, F.lit(0.0), lambda acc, x: acc + fn(x))
    n = F.sum(F.when(F.col(features).isNotNull(), F.size(there)))
    mean = df.agg(F.sum(fold(lambda x: x)) / n).scalar()
    with_mean = df.withColumn("_m", mean)
    spread = with_mean.agg(
        F.sqrt(F.sum(fold(lambda x: F.pow(x - F.col("_m"), 2))) / n)
    ).scalar()
    return (
        with_mean.withColumn("_s", spread)
        .withColumn(out or features, F.transform(f, lambda x: F.try_divide(x - F.col("_m"), F.col("_s"))))
        .drop("_m", "_s")
    )


def min_max_bounds(df, cols):
    """Fitted bounds, one row: ``<col>_min``, ``<col>_max``."""
    return df.agg(
        *[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "min"), (F.max, "max"))]
    )


def min_max_scale(df, bounds, cols):
    """Scale by fitted bounds; a constant column becomes 0 where it was fitted."""
    names = [f"{c}_{n}" for c in cols for n in ("min", "max")]
    packed = df.withColumn("_b", bounds.select(F.struct(*names)).scalar())
    b = F.col("_b")
    scaled = {
        c: (F.col(c) - b[f"{c}_min"])
        / F.when(b[f"{c}_max"] > b[f"{c}_min"], b[f"{c}_max"] - b[f"{c}_min"]).otherwise(1.0)
        for c in cols
    }
    return packed.withColumns(scaled).drop("_b")


def scale_boxes(df, image_size, cols=("x", "y", "w", "h")):
    return df.withColumns({c: F.col(c) / F.lit(float(image_size)) for c in cols})


def unscale_boxes(df, image_size, cols=("x", "y", "w", "h")):
    return df.withColumns({c: F.col(c) * F.lit(float(image_size)) for c in cols})


def to_size(df, score, low, high, power=0.5, out="size"):
    """Map a score to ``[low, high]``: ``low + (high-low) * share^power``."""
    b = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    share = F.coalesce(
        F.try_divide(F.col(score) - F.col("_b")["lo"], F.col("_b")["hi"] - F.col("_b")["lo"]), F.lit(0.0)
    )
    return df.withColumn("_b", b).withColumn(out, low + (high - low) * F.pow(share, power)).drop("_b")


def iou(a, b):
    """Intersection over union of two boxes given as (x, y, w, h) columns."""
    x1, y1, w1, h1 = [F.col(c) for c in a]
    x2, y2, w2, h2 = [F.col(c) for c in b]
    wide = F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2)
    high = F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2)
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    return F.coalesce(F.try_divide(shared, w1 * h1 + w2 * h2 - shared), F.lit(0.0))


def box_overlap(pred, true, key, cols=("x", "y", "w", "h"), out="iou"):
    """IoU of predicted and true boxes joined on the box id."""
    t = true.select(key, *[F.col(c).alias("t_" + c) for c in cols])
    return pred.join(t, key).withColumn(out, iou(cols, ["t_" + c for c in cols]))


def mean_iou(overlaps, col="iou"):
    return overlaps.agg(F.avg(col).alias("mean_iou"))
