"""Registry of queries: a function of the tables, and its SQL if it has one."""

import os

from pyspark.sql import functions as F

from tablewright.functions import draws
from tablewright.plans.session import SETTINGS

QUERIES = {}
ORACLES = {}


class Tables:
    """``tables.orders`` is the orders table of a folder."""

    def __init__(self, spark, folder):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name):
        return self.spark.read.parquet(os.path.join(self._folder, name + ".parquet"))


def query(sql=None, name=None):
    def register(fn):
        key = name or fn.__name__

        def run(spark, folder):
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
            return fn(Tables(spark, folder))

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def r(col, digits=6):
    """Rounded double; also turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: r(f"`{c}`", digits) for c in cols})


def tok(c):
    """DuckDB: word tokens of a text."""
    return f"list_filter(string_split_regex(lower({c}), '[^\\pL\\pN_]+'), lambda x: x <> '')"


def u(seed, *parts):
    """DuckDB: the uniform hash of ``functions.sampling``."""
    text = " || ':' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296.0)"


def mixed(source):
    """DuckDB: ``source`` (columns i, x1, x2) with the draw ``m`` of ``functions.draws``."""
    mix = [
        "xor(m, m >> 16)", f"(m * {draws.FIRST}) & 4294967295", "xor(m, m >> 13)", f"(m * {draws.SECOND}) & 4294967295",
        "xor(m, m >> 16)",
    ]
    q = f"SELECT *, xor(x1, (i::UBIGINT * {draws.STEP}) & 4294967295) AS m FROM ({source})"
    for step in [*mix, "(m + x2) & 4294967295", *mix]:
        q = f"SELECT * REPLACE ({step} AS m) FROM ({q})"
    return q


def words(seed, key):
    """DuckDB: the two words of a key."""
    half = lambda at: f"('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), {at}, 8))::UBIGINT"
    return f"{half(1)} AS x1, {half(9)} AS x2"
