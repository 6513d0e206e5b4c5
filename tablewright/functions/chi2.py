"""Tail of the chi-squared distribution, for the few rows that a test returns."""

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def upper_tail(x, dof):
    """Probability of a value above ``x`` (regularised upper incomplete gamma of half integers)."""
    if x <= 0:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        logs, rest = [j * math.log(h) - math.lgamma(j + 1) - h for j in range(dof // 2)], 0.0
    else:
        logs, rest = [(j - 0.5) * math.log(h) - math.lgamma(j + 0.5) - h for j in range(1, (dof + 1) // 2)], math.erfc(math.sqrt(h))
    return min(1.0, rest + math.fsum(map(math.exp, logs)))


def critical_value(alpha, dof):
    low, high = 0.0, 10.0
    while upper_tail(high, dof) > alpha:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_tail(mid, dof) > alpha else (low, mid)
    return high


@F.pandas_udf(DoubleType())
def p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([upper_tail(a, int(d)) if d > 0 else None for a, d in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def critical(alpha: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([round(critical_value(a, int(d)), 3) if d > 0 else None for a, d in zip(alpha, dof)], dtype="float64")
