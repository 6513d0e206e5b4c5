"""Global order on many tasks: ranks, running totals, exact quantiles.

A window without partition columns runs in one task.  Here rows are cut into
value ranges first (splits from ``percentile_approx``); windows run inside a
range, and the totals of the ranges, at most ``ranges`` rows, carry over.
"""

from pyspark.sql import Column, Window as W, functions as F

from tablewright.plans.lineage import cut
from tablewright.plans.skew import null_safe


def range_count(spark, at_least=16, at_most=1 << 15):
    """Power of two, a few ranges per shuffle partition of the session."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = at_least
    while n < min(wanted, at_most):
        n *= 2
    return n


def _order_code(df, value):
    """A number that sorts as ``value`` does (ties allowed).

    For strings, the bytes after the prefix that all of them share.
    """
    kind = dict(df.dtypes)[value]
    if kind == "string":
        ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        e = F.col("_ends")
        same = F.filter(
            F.sequence(F.lit(0), F.length(e["lo"])), lambda i: F.left(e["lo"], i) == F.left(e["hi"], i)
        )
        rest = F.substr(F.col(value), F.array_max(same) + 1)
        head = F.rpad(F.substring(F.hex(F.encode(rest, "utf-8")), 1, 14), 14, "0")
        return df.withColumn("_ends", ends).withColumn("_code", F.conv(head, 16, 10).cast("double")).drop("_ends")
    if kind.startswith("timestamp"):
        code = F.unix_micros(F.col(value).cast("timestamp"))
    elif kind == "date":
        code = F.unix_date(value)
    else:
        code = F.col(value)
    return df.withColumn("_code", code.cast("double"))


def with_range(df, value, ranges=None, out="_range", sample=None):
    """Add the number of the value range each row falls in.

    Rows with equal ``value`` share a range, and ranges are ordered as the
    values are.  NULLs fall in range 0.  The splits come from ``sample``, a
    frame with the same values, or from ``df`` itself.
    """
    ranges = ranges or range_count(df.sparkSession)
    coded = _order_code(df, value)
    splits = (coded if sample is None else _order_code(sample, value)).agg(
        F.percentile_approx(
            "_code",
            F.array(*[F.lit(i / ranges) for i in range(1, ranges)]),
            F.lit(max(10_000, 10 * ranges)),
        )
    )
    steps = []
    step = ranges // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    found = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, s: F.when(F.element_at("_splits", at + s) < F.col("_code"), at + s).otherwise(at),
    )
    return (
        coded.withColumn("_splits", splits.scalar())
        .withColumn(out, F.coalesce(found, F.lit(0)))
        .drop("_code", "_splits")
    )


def _carry(ranged, weight, by, rng):
    """Total weight in earlier ranges, one row per (by, range)."""
    totals = ranged.groupBy(*by, rng).agg(F.sum(weight).alias("_total"))
    before = W.partitionBy(*by).orderBy(rng).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *by, rng, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )


def running_total(df, order, weight, out, by=(), rng=None, ranges=None):
    """Inclusive running sum of ``weight`` in the order of ``order`` columns.

    The first order column must be spread out: pre-aggregate equal values.
    ``rng`` names a column with the range number if the caller has one.
    """
    by = list(by)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    own = rng is None
    if own:
        rng = "_range"
        # naming the weight keeps its aggregate in the plan of the splits, so
        # the shuffle behind ``df`` is done once and reused
        df = with_range(df, order[0], ranges, rng, df.where(F.col(weight) >= 0))
    inside = W.partitionBy(*by, rng).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    carried = null_safe(df, _carry(df, weight, by, rng), [*by, rng])
    total = carried.withColumn(out, F.sum(weight).over(inside) + F.col("_before")).drop("_before")
    return total.drop(rng) if own else total


def numbered(df, order, out="rn", by=(), rng=None, ranges=None):
    """1-based row number in the order of ``order``, without a global window."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(one, order, "_one", out, by, rng, ranges).drop("_one")


def average_ranks(counts, value, weight, out, descending=False, by=()):
    """Rank of each distinct value, ties averaged.

    ``counts`` has one row per (by, value) with its multiplicity ``weight``.
    """
    by = list(by)
    ranked = running_total(counts, value, weight, "_cum", by)
    low = F.col("_cum") - (F.col(weight) - 1) / F.lit(2.0)
    if not descending:
        return ranked.withColumn(out, low).drop("_cum")
    if by:
        size = counts.groupBy(*by).agg(F.sum(weight).alias("_size"))
        ranked = null_safe(ranked, size, by)
    else:
        ranked = ranked.withColumn("_size", counts.agg(F.sum(weight)).scalar())
    return ranked.withColumn(out, F.col("_size") + 1 - low).drop("_cum", "_size")


def exact_quantiles(df, value, probs, by=(), weight=None, names=None):
    """Exact, linearly interpolated quantiles per group; one column each.

    NULL values are left out.  Equal values are counted before the shuffle,
    so neither a hot group nor a hot value meets in one task.
    """
    by = list(by)
    names = names or ["q%g" % (100 * p) for p in probs]
    counted = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(counted.alias("_c"))
    )
    cum = running_total(counts, "_v", "_c", "_cum", by)
    size = counts.agg(F.sum("_c").alias("_n")) if not by else counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    cum = null_safe(cum, size, by) if by else cum.withColumn("_n", size.scalar())

    def at(position):
        holds = (F.col("_cum") - F.col("_c") <= position) & (position < F.col("_cum"))
        return F.max(F.when(holds, F.col("_v")))

    picks, outs = [], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(h)).alias(f"_lo{i}"),
            at(F.ceil(h)).alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
        ]
        outs.append(
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(names[i])
        )
    return cum.groupBy(*by).agg(*picks).select(*by, *outs)


def nearest_on_line(left, right, score, payload):
    """For each distinct left score, the closest right row.

    ``left`` has a column ``score``; ``right`` has ``score``, ``pos`` and the
    ``payload`` columns.  Ties in distance go to the smallest ``pos``.  Both
    sides are reduced to distinct scores, sorted by range, and the nearest
    right row below and above is carried along, across ranges as well.
    Returns ``score, distance, pos, payload...``, one row per left score.
    """
    near = ["pos", *payload]
    best = right.groupBy(score).agg(
        F.min_by(F.struct(*near), "pos").alias("_hit")
    ).select(score, F.struct(F.col(score).alias("_s"), "_hit.*").alias("_hit"))
    asked = left.select(score).where(F.col(score).isNotNull()).distinct().withColumn("_ask", F.lit(True))
    line = best.where(F.col(score).isNotNull()).join(asked, score, "full")
    line = with_range(cut(line), score)
    ends = line.groupBy("_range").agg(
        F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col(score))).alias("_top"),
        F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col(score))).alias("_bottom"),
    )
    ordered = W.orderBy("_range")  # at most one row per range
    ends = ends.select(
        "_range",
        F.last("_top", True).over(ordered.rowsBetween(W.unboundedPreceding, -1)).alias("_from_below"),
        F.first("_bottom", True).over(ordered.rowsBetween(1, W.unboundedFollowing)).alias("_from_above"),
    )
    line = line.join(ends, "_range")
    # two running frames, one per direction: a frame that reaches to the end
    # would be scanned anew for every row
    up = W.partitionBy("_range").orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_range").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    below = F.coalesce(F.last("_hit", True).over(up), F.col("_from_below"))
    above = F.coalesce(F.last("_hit", True).over(down), F.col("_from_above"))
    line = line.withColumn("_below", below).withColumn("_above", above).where("_ask")

    def option(side):
        fields = [F.col(f"{side}.{c}").alias(c) for c in near]
        gap = F.abs(F.col(f"{side}._s") - F.col(score)).alias("distance")
        return F.when(F.col(side).isNotNull(), F.struct(gap, *fields))

    return (
        line.select(score, F.least(option("_below"), option("_above")).alias("_near"))
        .where(F.col("_near").isNotNull())
        .select(score, "_near.*")
    )
