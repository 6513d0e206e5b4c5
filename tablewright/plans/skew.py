"""Equi-joins whose keys may be hot."""

from pyspark.sql import functions as F

HOT_ROWS = 20_000


def null_safe(left, right, keys, how="inner"):
    """Join on ``keys`` with NULL equal to NULL; keys come from the left."""
    if not keys:
        raise ValueError("at least one key is needed")
    renamed = right.select(
        *[F.col(k).alias("_r_" + k) for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col("_r_" + k))
        cond = here if cond is None else cond & here
    return left.join(renamed, cond, how).drop(*["_r_" + k for k in keys])


def salted_join(left, right, keys, condition=None, hot_rows=HOT_ROWS):
    """Inner equi-join of two tables where both may have many rows per key.

    Keys with more than ``hot_rows`` right rows get a salt: every right row
    falls in one slice, every left row of the key is copied to all slices.
    The result is that of the plain join; only the work per task shrinks.
    """
    hot = (
        right.groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(hot_rows)).cast("int").alias("_slices"))
        .where(F.col("_slices") > 1)
    )
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    spread = right.join(hot, keys, "left").withColumn(
        "_slice",
        F.when(F.col("_slices").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(*[c for c in right.columns]), slices).cast("int")
        ),
    ).drop("_slices")
    copied = left.join(hot, keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    ).drop("_slices")
    joined = copied.join(spread, [*keys, "_slice"]).drop("_slice")
    return joined.where(condition) if condition is not None else joined
