"""Projections, filters, aggregates, order and sets on one table."""

from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tablewright.plans.ordering import exact_quantiles, numbered


def numeric_columns(df):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


# -- projections and filters ------------------------------------------------


def add_sum(df, out, a, b, scale=1):
    """``(a + b) / scale``; NULL if either side is NULL."""
    total = F.col(a) + F.col(b)
    return df.withColumn(out, total if scale == 1 else total / F.lit(float(scale)))


def years_around(df, date, year, span=0):
    """Rows whose date lies in ``[year - span, year + span]``.

    Written as a range on the bare column, so it is pushed to the scan.
    """
    low, high = f"{year - span}-01-01", f"{year + span + 1}-01-01"
    kind = dict(df.dtypes)[date]
    return df.where((F.col(date) >= F.lit(low).cast(kind)) & (F.col(date) < F.lit(high).cast(kind)))


def in_range(df, col, low, high):
    return df.where(F.col(col).between(low, high))


def with_prefix(df, col, prefix, *more):
    """Rows whose column starts with ``prefix`` and that meet ``more``."""
    cond = F.startswith(F.col(col), F.lit(prefix))
    for m in more:
        cond &= m
    return df.where(cond)


def at_least(df, score, threshold):
    """Rows with ``score >= threshold``; missing scores drop."""
    return df.where(F.col(score) >= threshold)


def complete_rows(df, cols):
    return df.dropna(subset=list(cols))


def fill_missing(df, value=0):
    return df.fillna(value)


def missing_share(df, cols=None):
    """Percent of missing values of each column: ``(column, missing_pct)``."""
    cols = cols or df.columns
    one = df.agg(
        *[F.try_divide(100.0 * F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias(c) for c in cols]
    )
    return one.unpivot([], list(cols), "column", "missing_pct")


def sentinel_to_null(df, col, sentinel):
    return df.withColumn(col, F.nullif(F.col(col), F.lit(sentinel)))


def binarize_at_mean(df, col, out):
    """1 at or above the mean of the column, 0 below, missing kept."""
    mean = df.agg(F.avg(col)).scalar()
    return df.withColumn(out, (F.col(col) >= mean).cast("int"))


def zero_below(df, col, threshold, out=None, keep_equal=True):
    kept = F.col(col) >= threshold if keep_equal else F.col(col) > threshold
    return df.withColumn(out or col, F.when(kept, F.col(col)).otherwise(F.lit(0).cast(dict(df.dtypes)[col])))


def abs_error(df, predicted, actual, out="error", label=None, label_cols=()):
    """Absolute error and, if asked, a label joined from columns."""
    df = df.withColumn(out, F.abs(F.col(predicted) - F.col(actual)))
    if label:
        df = df.withColumn(label, F.concat_ws(" ", *[F.col(c).cast("string") for c in label_cols]))
    return df


def prediction_as_target(df, target, predicted="prediction"):
    return df.withColumn(target, F.col(predicted)).drop(predicted)


# -- aggregates -------------------------------------------------------------


def group_count(df, by, col, out="n", at_least=None):
    """Non-missing ``col`` per group; ``at_least`` keeps the larger groups."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.groupBy(*by).agg(F.count(col).alias(out))
    return counts if at_least is None else counts.where(F.col(out) >= at_least)


def group_max(df, by, cols):
    """Each column's own maximum per group."""
    return df.groupBy(by).agg(*[F.max(c).alias(c) for c in cols])


def mean_difference(df, group, first, second, value):
    """Mean of ``value`` in the second group minus the first."""
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return df.agg(
        mean(first).alias("mean_first"),
        mean(second).alias("mean_second"),
        (mean(second) - mean(first)).alias("difference"),
    )


def group_quartiles(df, by, value):
    return exact_quantiles(df, value, [0.25, 0.5, 0.75], [by])


def median(df, value, by=()):
    return exact_quantiles(df, value, [0.5], by, names=["median"])


def describe(df, cols=None):
    """Count, mean, std, min, quartiles and max of numeric columns."""
    cols = cols or numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basic.join(exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"]), "column", "left")


def column_bounds(df, cols):
    """``(column, low, high)``."""
    one = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.min(F.col(c).cast("double")).alias("low"),
                    F.max(F.col(c).cast("double")).alias("high"),
                )
                for c in cols
            ]
        ).alias("b")
    )
    return one.select(F.inline("b"))


def value_counts(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def row_count(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


def share_equal(df, predicted, actual, out="accuracy"):
    """Share of rows whose two columns agree."""
    return df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias(out))


def crosstab(df, rows, cols):
    """Counts of every pair of values and their margins, long form.

    A NULL value marks the margin; NULLs of the data are left out.
    """
    return (
        df.dropna(subset=[rows, cols]).cube(rows, cols).agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab_wide(df, rows, cols, levels=None):
    """Crosstab with one column per value and an ``All`` row and column.

    A row value ``All`` of the data keeps a row of its own beside the margin.
    """
    base = df.dropna(subset=[rows, cols]).select(F.col(rows).cast("string"), F.col(cols).cast("string"))
    wide = base.groupBy(rows).pivot(cols, levels).agg(F.count(F.lit(1))).fillna(0)
    names = [c for c in wide.columns if c != rows]
    margin = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in names]).select(F.lit("All").alias(rows), "*")
    both = wide.withColumn("_margin", F.lit(1)).unionByName(margin.withColumn("_margin", F.lit(2)))
    # also of values that are not among the levels
    every = base.rollup(rows).agg(F.count(F.lit(1)).alias("All"), (F.grouping(rows) + 1).cast("int").alias("_margin"))
    every = every.select(F.coalesce(rows, F.lit("All")).alias(rows), "_margin", "All")
    return both.join(every, [rows, "_margin"]).drop("_margin")


def histogram(df, value, bins=10):
    """Equal-width bins over the range of a column; the last one is closed.

    Every bin is listed; ``log_n`` is log10 of the count, NULL for an empty
    bin.  A column of one value gets a range of one around it.
    """
    x = F.col(value).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).select(
        F.struct(
            F.when(F.col("lo") < F.col("hi"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
            F.when(F.col("lo") < F.col("hi"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
        )
    )
    e = F.col("_e")
    width = (e["hi"] - e["lo"]) / bins
    counts = (
        df.where(x.isNotNull())
        .withColumn("_e", ends.scalar())
        .groupBy(F.least(F.floor((x - e["lo"]) / width), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("_e", ends.scalar())
    n = F.coalesce("n", F.lit(0))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (e["lo"] + F.col("bin") * width).alias("low"),
        (e["lo"] + (F.col("bin") + 1) * width).alias("high"),
        n.alias("n"),
        F.when(n > 0, F.log10(n)).alias("log_n"),
    )


def hexbin(df, x, y, gridsize=20, min_count=1):
    """Counts in a hexagonal grid: ``(lattice, ix, iy, cx, cy, n)``.

    Two rectangular lattices, one shifted by half a cell; a point goes to the
    nearer centre, with y weighing three times.
    """
    nx, ny = gridsize, int(gridsize / 3**0.5)
    pad = 1e-9
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    ends = df.dropna(subset=[x, y]).agg(
        F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"), F.max(py).alias("y1")
    )
    span_x, span_y = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    grid = ends.select(
        F.struct(
            (F.col("x0") - pad * span_x).alias("x0"),
            (span_x * (1 + 2 * pad) / nx).alias("sx"),
            (F.col("y0") - pad * span_y).alias("y0"),
            (span_y * (1 + 2 * pad) / ny).alias("sy"),
        )
    )
    g = F.col("_g")
    placed = df.dropna(subset=[x, y]).withColumn("_g", grid.scalar()).select(
        "_g",
        ((px - g["x0"]) / g["sx"]).alias("_x"),
        ((py - g["y0"]) / g["sy"]).alias("_y"),
    )
    ax, ay, bx, by = F.rint("_x"), F.rint("_y"), F.floor("_x"), F.floor("_y")
    d1 = F.pow(F.col("_x") - ax, 2) + 3 * F.pow(F.col("_y") - ay, 2)
    d2 = F.pow(F.col("_x") - bx - 0.5, 2) + 3 * F.pow(F.col("_y") - by - 0.5, 2)
    first = d1 < d2
    cells = placed.select(
        "_g",
        F.when(first, 0).otherwise(1).alias("lattice"),
        F.when(first, ax.cast("bigint")).otherwise(bx).alias("ix"),
        F.when(first, ay.cast("bigint")).otherwise(by).alias("iy"),
    )
    half = F.col("lattice") * 0.5
    return (
        cells.groupBy("lattice", "ix", "iy")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
        .withColumn("_g", grid.scalar())
        .select(
            "lattice",
            "ix",
            "iy",
            ((F.col("ix") + half) * g["sx"] + g["x0"]).alias("cx"),
            ((F.col("iy") + half) * g["sy"] + g["y0"]).alias("cy"),
            "n",
        )
    )


def distinct_in_order(df, col, pos):
    """Distinct values with ``index`` 0, 1, ... by first appearance."""
    firsts = df.groupBy(col).agg(F.min(pos).alias("first"))
    return numbered(firsts, "first", "index").withColumn("index", F.col("index") - 1)


def keep_first(df, keys, pos):
    """The row with the smallest ``pos`` of each key.

    An aggregate, not a window: a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(*keys, "_r.*")


# -- order and sets ---------------------------------------------------------


def with_position(df, key, out="pos"):
    """0-based row number in the order of ``key``, without a global window."""
    return numbered(df, key, out).withColumn(out, F.col(out) - 1)


def top(df, k, by, *ties):
    return df.orderBy(F.desc(by), *ties).limit(k)


def all_but_last(df, k, pos):
    """Rows but for the last ``k``; ``pos`` is a 0-based row number."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return df.where(F.col(pos) < n - k)


def argmin_row(df, score, *ties):
    return df.where(F.col(score).isNotNull()).orderBy(score, *ties).limit(1)


def rank_slice(df, score, skip_col=None, skip=None, k=10, by_abs=False, ties=()):
    """Top ``k`` rows by signed (or absolute) score, one value left out."""
    if skip_col is not None:
        df = df.where(F.col(skip_col) != skip)
    key = F.abs(F.col(score)) if by_abs else F.col(score)
    return df.where(F.col(score).isNotNull()).orderBy(F.desc(key), *ties).limit(k)


def argmax_label(df, scores, labels, out="label", softmax=False):
    """Class name of the highest score of an array column.

    ``labels`` is a frame ``(index, name)``.  ``confidence`` is the score
    itself, or its share after softmax.
    """
    s = F.col(scores)
    best = F.array_max(s)
    total = F.aggregate(F.transform(s, lambda v: F.exp(v - best)), F.lit(0.0), lambda a, v: a + v)
    found = df.withColumn("index", (F.array_position(s, best) - 1).cast("int")).withColumn(
        "confidence", 1 / total if softmax else best
    )
    named = labels.select(F.col("index").cast("int").alias("index"), F.col("name").alias(out))
    return found.join(named, "index", "left")


def stacked(first, *more):
    for m in more:
        first = first.unionByName(m)
    return first


def difference(df, taken, keys):
    return df.join(taken.select(*keys).distinct(), list(keys), "left_anti")
