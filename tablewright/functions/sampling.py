"""Randomness from a hash, so results do not depend on the layout."""

from pyspark.sql import functions as F


def hash_uniform(seed, *parts):
    """Uniform in [0, 1) from the text ``seed:part:part...``."""
    parts = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def hash_normal(seed, *parts):
    """Standard normal from two uniforms (Box-Muller)."""
    u = hash_uniform(f"{seed}a", *parts)
    v = hash_uniform(f"{seed}b", *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def split_by_hash(df, weights, key, seed=7, out="part"):
    """Number each row with its part: 0, 1, ... by cumulated weight."""
    total = float(sum(weights))
    u = hash_uniform(seed, F.lit(0), F.col(key))
    at, part = 0.0, None
    for i, w in enumerate(weights[:-1]):
        at += w / total
        part = F.when(u < at, i) if part is None else part.when(u < at, i)
    last = len(weights) - 1
    return df.withColumn(out, part.otherwise(last) if part is not None else F.lit(0))


def train_test(df, test_share, key, seed=7):
    """Two frames, the second with about ``test_share`` of the rows."""
    parts = split_by_hash(df, [1 - test_share, test_share], key, seed, "_part")
    return parts.where("_part = 0").drop("_part"), parts.where("_part = 1").drop("_part")
