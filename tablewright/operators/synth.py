"""Features for a table from the tables below it.

A ``Relation`` says which child rows belong to a parent row.  ``synthesize``
works bottom up: each level is one ``groupBy`` on the parent key, its result
joined to the parent.  Names follow ``AGG(child.column)`` and
``AGG(child.AGG(grandchild.column))``.
"""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tablewright.operators.stats import spearman_with_label
from tablewright.operators.table import rank_slice
from tablewright.plans.lineage import cut
from tablewright.plans.ordering import exact_quantiles

NUMERIC = ("SUM", "MEAN", "MIN", "MAX", "STD", "SKEW")
CATEGORY = ("NUM_UNIQUE", "MODE")
DATE_PARTS = ("DAY", "MONTH", "YEAR", "WEEKDAY")


@dataclass
class Table:
    """A frame with its key and the roles of its columns."""

    name: str
    frame: object
    key: str
    numeric: list = field(default_factory=list)
    category: list = field(default_factory=list)
    boolean: list = field(default_factory=list)
    time: list = field(default_factory=list)


@dataclass
class Relation:
    """Rows of ``child`` whose ``column`` is the key of ``parent``."""

    parent: str
    child: str
    column: str


def q(name):
    return F.col(f"`{name}`")


def bias_corrected_skew(col):
    n = F.count(col)
    return F.when(n > 2, F.try_divide(F.skewness(col) * F.sqrt(n * (n - 1)), n - 2))


def date_part(part, col):
    make = {
        "DAY": F.dayofmonth,
        "MONTH": F.month,
        "YEAR": F.year,
        "WEEKDAY": F.weekday,
        "MINUTE": F.minute,
    }
    return make[part](col)


def _numeric_agg(name, col):
    make = {
        "SUM": lambda c: F.coalesce(F.sum(c), F.lit(0)),
        "MEAN": F.avg,
        "MIN": F.min,
        "MAX": F.max,
        "STD": F.stddev_samp,
        "SKEW": bias_corrected_skew,
    }
    return make[name](col)


def add_date_parts(table, parts=DATE_PARTS):
    """Date parts of the time columns, as category columns."""
    names = {f"{p}({c})": date_part(p, F.col(c)) for c in table.time for p in parts}
    return Table(
        table.name, table.frame.withColumns(names) if names else table.frame, table.key, list(table.numeric),
        [*table.category, *names], list(table.boolean), list(table.time),
    )


def category_aggregates(frame, by, name, cols):
    """Distinct count and mode (smallest on ties) of each column per group.

    Cells are counted by (group, column, value) first, so a hot group is
    spread over its values and never sits in one task's memory.
    """
    cells = frame.select(by, F.posexplode(F.array(*[q(c).cast("string") for c in cols])).alias("_i", "_v"))
    typed = {c: t for c, t in frame.dtypes}
    counts = cells.where("_v IS NOT NULL").groupBy(by, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    aggs = []
    for i, c in enumerate(cols):
        own = F.when(F.col("_i") == i, F.col("_v").cast(typed[c]))
        aggs.append(F.count(own).alias(f"NUM_UNIQUE({name}.{c})"))
        best = F.min(F.when(F.col("_i") == i, F.struct(-F.col("_n"), F.col("_v").cast(typed[c]).alias("v"))))
        aggs.append(best["v"].alias(f"MODE({name}.{c})"))
    return counts.groupBy(by).agg(*aggs)


def aggregates(table, by, numeric=NUMERIC, median=False):
    """All aggregates of a child table per value of ``by``."""
    f, name = table.frame.where(F.col(by).isNotNull()), table.name
    aggs = [F.count(F.lit(1)).alias(f"COUNT({name})")]
    aggs += [_numeric_agg(a, q(c)).alias(f"{a}({name}.{c})") for c in table.numeric for a in numeric]
    aggs += [
        F.avg(q(c).cast("boolean").cast("double")).alias(f"PERCENT_TRUE({name}.{c})") for c in table.boolean
    ]
    out = f.groupBy(by).agg(*aggs)
    if table.category:
        out = out.join(category_aggregates(f, by, name, table.category), by, "left")
    if median:
        for c in table.numeric:
            mid = exact_quantiles(
                f.withColumnRenamed(c, "_m"), "_m", [0.5], [by], names=[f"MEDIAN({name}.{c})"]
            )
            out = out.join(mid, by, "left")
    return out


def synthesize(tables, relations, target, depth=2, parts=DATE_PARTS, numeric=NUMERIC, median=False):
    """Feature table of ``target``: its key and one column per feature.

    Counts and sums of a row without children are 0, other aggregates NULL.
    Tables below the children, down to ``depth`` levels, contribute through
    their parents (stacked aggregates) and directly.
    """
    known = {t.name: add_date_parts(t, parts) for t in tables}
    base = known[target]
    plain = base.frame.select(base.key, *[q(c) for c in [*base.numeric, *base.category, *base.boolean]])
    frame, _ = _with_features(plain, base, known, relations, depth, numeric, median)
    return frame


def _with_features(frame, base, known, relations, depth, numeric, median):
    """``frame`` with the features of the tables below ``base``, and their names."""
    names = []
    for table, column in _below(base.name, known, relations, depth, numeric, median):
        made = aggregates(table, column, numeric, median).withColumnRenamed(column, base.key)
        own = [c for c in made.columns if c != base.key]
        frame = _zero_counts(frame.join(made, base.key, "left"), own)
        names += own
    return frame, names


def _below(name, known, relations, depth, numeric, median):
    """Tables up to ``depth`` levels below, each with its own features and the column that leads up to ``name``."""
    found = []
    for rel in [r for r in relations if r.parent == name] if depth > 0 else []:
        child = known[rel.child]
        frame, names = _with_features(child.frame, child, known, relations, depth - 1, numeric, median)
        kinds = dict(frame.dtypes)
        modes = [c for c in names if c.startswith("MODE(")]
        numbers = [c for c in names if c not in modes and kinds[c] != "string"]
        found.append((
            Table(child.name, frame, child.key, [*child.numeric, *numbers], [*child.category, *modes], child.boolean, child.time),
            rel.column,
        ))
        for table, column in _below(rel.child, known, relations, depth - 1, numeric, median):
            owner = child.frame.select(F.col(child.key).alias(column), rel.column)
            extra = [c for c in table.frame.columns if c not in (column, rel.column)]
            lifted = table.frame.select(column, *[q(c) for c in extra]).join(owner, column)
            found.append((
                Table(table.name, lifted, table.key, table.numeric, table.category, table.boolean, table.time), rel.column
            ))
    return found


def _zero_counts(df, names):
    zero = [c for c in names if c.startswith(("COUNT(", "SUM(", "NUM_UNIQUE("))]
    return df.withColumns({c: F.coalesce(q(c), F.lit(0)) for c in zero}) if zero else df


def encode_top(df, col, k=10, drop=True):
    """``col = value`` 0/1 columns of the ``k`` most frequent values.

    Missing values set ``col is unknown``.  ``k`` rows reach the driver.
    """
    tops = (
        df.where(q(col).isNotNull()).groupBy(q(col).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "v").limit(k)
    )
    made = {
        f"{col} = {r['v']}": F.coalesce((q(col).cast("string") == F.lit(r["v"])).cast("int"), F.lit(0))
        for r in tops.collect()
    }
    made[f"{col} is unknown"] = q(col).isNull().cast("int")
    out = df.withColumns(made)
    return out.drop(q(col)) if drop else out


def select_features(df, cols, label, k=10, by_abs=False):
    """The ``k`` features with the highest Spearman correlation to a label; those equal to twelve digits by name."""
    # written first: what made the features is not kept on disk, nor made again, while they are ranked
    plain = cut(df.select(*[q(c).cast("double").alias(f"f{i}") for i, c in enumerate(cols)], q(label).cast("double").alias("_label")))
    scored = spearman_with_label(plain, [f"f{i}" for i in range(len(cols))], "_label")
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("feature", 2, 9).cast("int") + 1)
    scored = scored.withColumn("feature", names)
    scored = scored.withColumn("spearman", F.round("spearman", 12))
    return rank_slice(scored, "spearman", k=k, by_abs=by_abs, ties=["feature"])
