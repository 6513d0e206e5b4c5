"""Statistics, graphs, causal estimates, synthesized features."""

import re

from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators import causal as ca, graph as gr, simjoin as sj, stats as st, synth as sy, table as tb
from tablewright.plans.lineage import cut
from tablewright.plans.ordering import exact_quantiles
from workload.registry import mixed, query, r, rounded, tok, u, words
from workload.texts import doc_tokens, sets_sql

# -- statistics -------------------------------------------------------------


@query(
    """SELECT round(avg(value) FILTER (event_type = 'view'), 6) AS mean_first, round(avg(value) FILTER (event_type = 'click'), 6) AS mean_second,
    round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) AS difference FROM events"""
)
def mean_difference(t):
    return rounded(
        tb.mean_difference(t.events, "event_type", "view", "click", "value"), "mean_first", "mean_second", "difference"
    )


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(t):
    return rounded(st.pearson(t.lineitem, "l_quantity", "l_extendedprice"), "pearson")


def rank(c, part=""):
    over = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({over}ORDER BY {c}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{c}) - 1) / 2.0)"


@query(
    f"""SELECT round(corr(x, y), 6) AS spearman FROM (SELECT {rank('l_quantity')} AS x, {rank('l_extendedprice')} AS y FROM lineitem)"""
)
def spearman(t):
    return rounded(st.spearman(t.lineitem, "l_quantity", "l_extendedprice"), "spearman")


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS col_x, '{b}' AS col_y, round(corr(\"r_{a}\", \"r_{b}\"), 6) AS spearman FROM k"
    for i, a in enumerate(LINE_COLS)
    for b in LINE_COLS[i + 1:]
)


@query(f"WITH k AS (SELECT {', '.join(f'{rank(c)} AS r_{c}' for c in LINE_COLS)} FROM lineitem) {MATRIX}")
def spearman_matrix(t):
    return rounded(st.spearman_matrix(t.lineitem, LINE_COLS), "spearman")


@query(
    """SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority DESC) + (count(*) OVER (PARTITION BY o_orderpriority) - 1) / 2.0 AS rank
    FROM orders"""
)
def descending_ranks(t):
    ranked = st.descending_ranks(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    return ranked.select("o_orderkey", "rank")


@query(
    f"""WITH g AS (SELECT year(o_orderdate)::DOUBLE AS k, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50,
      quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY 1),
    l AS (SELECT * FROM g UNPIVOT (v FOR quartile IN (q25, q50, q75))),
    k AS (SELECT *, {rank('k', 'quartile')} AS rk, {rank('v', 'quartile')} AS rv FROM l)
    SELECT quartile, round(corr(k, v), 6) AS pearson, round(corr(rk, rv), 6) AS spearman FROM k GROUP BY 1"""
)
def quartile_correlation(t):
    df = t.orders.withColumn("y", F.year("o_orderdate"))
    return rounded(st.quartile_correlation(df, "y", "o_totalprice"), "pearson", "spearman")


BOOT = f"""v AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer),
  d AS (SELECT b, floor({u(7, 'b', 'rn')} * n)::BIGINT AS idx FROM v, range(1, 1001) g(b)),
  e AS (SELECT b, quantile_cont(v.v, 0.5) AS estimate FROM d JOIN v ON idx = rn GROUP BY b),
  m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer)"""


@query(f"WITH {BOOT} SELECT b AS iter, round(estimate, 6) AS estimate FROM e")
def bootstrap_medians(t):
    return rounded(st.bootstrap_quantile(t.customer, "c_acctbal", "c_custkey"), "estimate")


@query(
    f"""WITH {BOOT}, o AS (SELECT estimate - m AS d, row_number() OVER (ORDER BY estimate - m, b) - 1 AS spot FROM e, m)
    SELECT round(max(m), 6) AS estimate, round(max(m) - max(d) FILTER (spot = 975), 6) AS low,
    round(max(m) - max(d) FILTER (spot = 25), 6) AS high FROM o, m"""
)
def bootstrap_interval(t):
    return rounded(st.bootstrap_interval(t.customer, "c_acctbal", "c_custkey"), "estimate", "low", "high")


PERMUTED = f"""WITH e AS (SELECT event_id AS k, value AS v, event_type = 'view' AS a, {words(7, 'event_id')} FROM events
    WHERE event_type IN ('view', 'click') AND value IS NOT NULL),
    z AS (SELECT count_if(a) AS na, count(*) AS n, sum(v) AS s, avg(v) FILTER (NOT a) - avg(v) FILTER (a) AS base FROM e),
    d AS (SELECT i, v, row_number() OVER (PARTITION BY i ORDER BY m, k) AS rn FROM ({mixed("SELECT e.*, i FROM e, range(1, 10001) g(i)")})),
    p AS (SELECT i, (s - sa) / (n - na) - sa / na AS difference, base FROM z, (
      SELECT i, sum(v) FILTER (rn <= na) AS sa FROM d, (SELECT na FROM z) GROUP BY i))"""


@query(
    f"""{PERMUTED} SELECT round(max(base), 6) AS difference, round(avg((difference >= base)::INT), 6) AS p_value,
    avg((difference >= base)::INT) < 0.01 AS significant FROM p"""
)
def permutation_test(t):
    """All 10,000 shuffles."""
    done = st.permutation_test(t.events, "event_type", "view", "click", "value", "event_id")
    return rounded(done, "difference", "p_value")


@query(f"{PERMUTED} SELECT i::INT AS iter, round(difference, 6) AS difference FROM p")
def permutation_differences(t):
    return rounded(st.permutation_differences(t.events, "event_type", "view", "click", "value", "event_id"), "difference")


DRAWN = f"""WITH e AS (SELECT *, count(*) OVER () AS n, {words(7, 'rn')} FROM (
      SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)),
    d AS (SELECT i, (m * n >> 32)::BIGINT AS rn FROM ({mixed("SELECT x1, x2, n, i FROM e, range(1, 1001) g(i)")})),
    c AS (SELECT i, corr(x, y) AS estimate FROM d JOIN e USING (rn) GROUP BY i), w AS (SELECT corr(x, y) AS m FROM e)"""


@query(
    f"""{DRAWN}, o AS (SELECT estimate - m AS d, row_number() OVER (ORDER BY estimate - m, i) - 1 AS spot FROM c, w)
    SELECT round(max(m), 6) AS estimate, round(max(m) - max(d) FILTER (spot = 975), 6) AS low,
    round(max(m) - max(d) FILTER (spot = 25), 6) AS high FROM o, w"""
)
def bootstrap_correlation(t):
    """Interval of a correlation, 1,000 resamples."""
    df = t.orders.select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    done = st.bootstrap_statistic_interval(df, st.MOMENTS, st.CORRELATION, "o_orderkey")
    return rounded(done, "estimate", "low", "high")


@query(f"{DRAWN} SELECT i::INT AS iter, round(sum(x) / count(*), 2) AS mean FROM d JOIN e USING (rn) GROUP BY i")
def bootstrap_means(t):
    drawn = st.bootstrap_sums(t.orders, {"sx": "o_totalprice"}, "o_orderkey")
    return rounded(drawn.select("iter", (F.col("sx") / F.col("n")).alias("mean")), "mean", digits=2)


@query(
    """WITH o AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS o FROM lineitem GROUP BY 1, 2),
    e AS (SELECT f, s, coalesce(o, 0) AS o, sum(coalesce(o, 0)) OVER (PARTITION BY f) * sum(coalesce(o, 0)) OVER (PARTITION BY s)
      / sum(coalesce(o, 0)) OVER ()::DOUBLE AS e FROM (SELECT DISTINCT f FROM o) CROSS JOIN (SELECT DISTINCT s FROM o) LEFT JOIN o USING (f, s))
    SELECT round(sum(pow(e - o, 2) / e), 6) AS statistic, (count(DISTINCT f) - 1) * (count(DISTINCT s) - 1) AS dof,
    round(exp(-sum(pow(e - o, 2) / e) / 2), 9) AS p_value, 5.991::DOUBLE AS critical, sum(pow(e - o, 2) / e) > 5.991 AS dependent FROM e"""
)
def chi_squared(t):
    test = st.chi_squared(t.lineitem, "l_returnflag", "l_linestatus")
    return rounded(rounded(test, "statistic"), "p_value", digits=9)


@query(
    """WITH o AS (SELECT c_mktsegment AS f, c_nationkey AS s, count(*) AS o FROM customer GROUP BY 1, 2),
    e AS (SELECT f, s, coalesce(o, 0) AS o, sum(coalesce(o, 0)) OVER (PARTITION BY f) * sum(coalesce(o, 0)) OVER (PARTITION BY s)
      / sum(coalesce(o, 0)) OVER ()::DOUBLE AS e FROM (SELECT DISTINCT f FROM o) CROSS JOIN (SELECT DISTINCT s FROM o) LEFT JOIN o USING (f, s)),
    x AS (SELECT sum(pow(e - o, 2) / e) AS x, (count(DISTINCT f) - 1) * (count(DISTINCT s) - 1) AS dof FROM e),
    p AS (SELECT x, dof, list_sum(list_transform(range(dof // 2), lambda j: exp(j * ln(x / 2) - lgamma(j + 1) - x / 2))) AS p FROM x)
    SELECT round(x, 6) AS statistic, dof, round(p, 9) AS p_value, p < 0.05 AS dependent FROM p"""
)
def chi_squared_wide(t):
    """As many degrees of freedom as segments and nations give (96 here, an even number)."""
    test = st.chi_squared(t.customer, "c_mktsegment", "c_nationkey").drop("critical")
    return rounded(rounded(test, "statistic"), "p_value", digits=9)


@query(
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p, avg(l_extendedprice) OVER () AS m FROM lineitem)
    SELECT round(1 - sum(pow(y - p, 2)) / sum(pow(y - m, 2)), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse FROM p"""
)
def regression_scores(t):
    df = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return rounded(rounded(st.regression_scores(df, "l_extendedprice", "p"), "r2"), "rmse", digits=4)


@query(
    """SELECT round(avg(-(quality * ln(greatest(least(toxic, 1 - 1e-15), 1e-15)) + (1 - quality) * ln(1 - greatest(least(toxic, 1 - 1e-15), 1e-15)))), 6) AS hard,
    round(avg(-(quality * ln(0.25 + toxic / 2.0) + (1 - quality) * ln(0.75 - toxic / 2.0))), 6) AS soft,
    round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels"""
)
def label_scores(t):
    df = t.labels.withColumn("p", 0.25 + F.col("toxic") / 2.0)
    hard = df.agg(r(st.log_loss("quality", "toxic")).alias("hard"), r(st.log_loss("quality", "p")).alias("soft"))
    return hard.withColumn("accuracy", rounded(tb.share_equal(t.labels, "quality", "toxic"), "accuracy").scalar())


# -- graphs -----------------------------------------------------------------

TRADED = """q AS (SELECT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM q),
  verts AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier),
  arcs AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""


def traded(t):
    """Customers and suppliers, linked by an order line."""
    q = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = q.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    ids = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(
        t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    )
    return ids, gr.graph_from_edges(pairs)


@query(
    f"""WITH {TRADED}, d AS (SELECT src AS id, count(*) AS n FROM arcs GROUP BY 1)
    SELECT id, CASE WHEN coalesce(n, 0) > 30 THEN n ELSE 0 END AS degree FROM verts LEFT JOIN d USING (id)"""
)
def graph_degree(t):
    return gr.degree(*traded(t), above=30)


@query(
    """WITH a AS (SELECT DISTINCT 'c' || o_custkey AS c, 's' || l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT 'c' || c_custkey AS id, count(a.s) AS degree FROM customer LEFT JOIN a ON a.c = 'c' || c_custkey GROUP BY c_custkey
    UNION ALL SELECT s AS id, count(*) AS degree FROM a GROUP BY s"""
)
def adjacency_degree(t):
    """Customers with the list of suppliers of each of their orders; one without orders stays alone."""
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("s"), "l_suppkey")).alias("near"))
    lists = t.orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "near")
    lists = t.customer.join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    table = lists.select(F.concat(F.lit("c"), "c_custkey").alias("id"), "near")
    return gr.degree(*gr.graph_from_adjacency(table, "id", "near"))


PAGERANK = f"""WITH RECURSIVE {TRADED}, o AS (SELECT src, count(*) AS n FROM arcs GROUP BY 1), c AS (SELECT count(*) AS n FROM verts),
  r(step, id, rank, before) AS (SELECT 0, id, 1.0::DOUBLE / c.n, NULL::DOUBLE FROM verts, c
    UNION ALL SELECT w.step + 1, w.id, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lone / c.n),
      CASE WHEN w.step % 4 = 0 THEN w.rank ELSE w.before END
    FROM r w CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lone FROM r WHERE id NOT IN (SELECT src FROM o)) l
    LEFT JOIN (SELECT dst, sum(rank / o.n) AS got FROM arcs JOIN o USING (src) JOIN r ON id = src GROUP BY 1) g ON g.dst = w.id
    WHERE w.step % 4 <> 0 OR coalesce((SELECT sum(abs(rank - before)) FROM r), 1) >= 1e-6)
  SELECT id, round(rank, 9) AS rank FROM r WHERE step = (SELECT max(step) FROM r)"""


@query(PAGERANK)
def pagerank(t):
    """To convergence, looked at every four rounds."""
    return rounded(gr.pagerank(*traded(t)), "rank", digits=9)


@query(
    f"""WITH RECURSIVE s AS ({sets_sql('documents', 'doc_id', 'text')}), e AS (SELECT rep, len(l) AS n, unnest(l) AS token FROM s),
    p AS (SELECT a.rep AS src, b.rep AS dst FROM e a JOIN e b ON a.token = b.token AND a.rep < b.rep GROUP BY 1, 2
      HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
    arcs AS (SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p),
    reach(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT dst, low FROM reach JOIN arcs ON src = id)
    SELECT id, min(low) AS component FROM reach GROUP BY 1"""
)
def graph_components(t):
    near = sj.similar_sets(doc_tokens(t), "doc_id", "tokens", 0.5).where("rep1 <> rep2")
    edges = gr.graph_from_edges(near, "rep1", "rep2")
    return gr.components(t.documents.select(F.col("doc_id").alias("id")), edges)


@query()
def largest_component(t):
    v, e = gr.largest_component(*traded(t))
    return v.agg(F.count(F.lit(1)).alias("vertices")).withColumn("edges", e.agg(F.count(F.lit(1))).scalar())


@query()
def influencers(t):
    """Without the hundredth with the highest ranks; ranks below the median become 0."""
    v, e = traded(t)
    e = cut(e)
    ranks = cut(gr.pagerank(v, e))
    ends = exact_quantiles(ranks, "rank", [0.99, 0.5], names=["drop", "keep"]).first()
    return gr.influencers(v, e, drop_from=ends["drop"], keep_from=ends["keep"], first=ranks)


TRADE = """w AS (SELECT least(c_nationkey, s_nationkey) AS src, greatest(c_nationkey, s_nationkey) AS dst, sum(l_extendedprice) AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
  edges AS (SELECT src, dst FROM w WHERE v >= (SELECT 1.6 * avg(v) FROM w)),
  arcs AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
  walk(source, id, dist, sigma) AS (SELECT n_nationkey, n_nationkey, 0, 1.0::DOUBLE FROM nation)"""


def hops(levels):
    """Unrolled breadth-first levels: w0, w1, ... and their union ``paths``."""
    steps = ["w0 AS (SELECT n_nationkey AS source, n_nationkey AS id, 0 AS dist, 1.0::DOUBLE AS sigma FROM nation)", "p0 AS (SELECT * FROM w0)"]
    for i in range(1, levels + 1):
        steps.append(
            f"""w{i} AS (SELECT source, dst AS id, {i} AS dist, sum(sigma) AS sigma FROM w{i - 1} JOIN arcs ON src = w{i - 1}.id
            WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} p WHERE p.source = w{i - 1}.source AND p.id = dst) GROUP BY 1, 2)"""
        )
        steps.append(f"p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT * FROM w{i})")
    return TRADE.split(",\n  walk")[0] + ", " + ", ".join(steps) + f", paths AS (SELECT * FROM p{levels})"


PATHS = hops(9)


def trade(t):
    """Nations, linked where their trade is well above the average."""
    lines = (
        t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
        .where("c_nationkey <> s_nationkey")
    )
    w = lines.groupBy(
        F.least("c_nationkey", "s_nationkey").alias("src"), F.greatest("c_nationkey", "s_nationkey").alias("dst")
    ).agg(F.sum("l_extendedprice").alias("v"))
    w = cut(w)
    edges = w.where(F.col("v") >= w.agg(1.6 * F.avg("v")).scalar()).select("src", "dst")
    return t.nation.select(F.col("n_nationkey").alias("id")), edges


@query(f"WITH {PATHS} SELECT dist, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM paths WHERE dist > 0 GROUP BY 1")
def distance_histogram(t):
    return rounded(gr.distance_histogram(gr.shortest_paths(*trade(t))), "log_n")


@query(f"WITH {PATHS} SELECT max(dist) AS diameter FROM paths")
def diameter(t):
    return gr.diameter(gr.shortest_paths(*trade(t)))


@query(
    f"WITH {PATHS} SELECT source AS id, round(count_if(dist > 0)::DOUBLE / nullif(sum(dist), 0), 6) AS closeness FROM paths GROUP BY 1"
)
def closeness(t):
    return rounded(gr.closeness(gr.shortest_paths(*trade(t))), "closeness")


@query(
    f"""WITH {PATHS}, b AS (SELECT a.id, sum(a.sigma * b.sigma / c.sigma) AS s FROM paths a JOIN paths b ON a.id = b.source
      JOIN paths c ON c.source = a.source AND c.id = b.id AND c.dist = a.dist + b.dist
      WHERE a.source < b.id AND a.dist > 0 AND b.dist > 0 GROUP BY 1)
    SELECT n_nationkey AS id, round(coalesce(s, 0) * 2 / (24 * 23), 6) AS betweenness FROM nation LEFT JOIN b ON b.id = n_nationkey"""
)
def betweenness(t):
    return rounded(gr.betweenness(*trade(t))[0], "betweenness")


@query(
    f"""WITH {PATHS}, b AS (SELECT e.src, e.dst, sum(a.sigma * b.sigma / c.sigma) AS s FROM arcs e JOIN paths a ON a.id = e.src
      JOIN paths b ON b.source = e.dst JOIN paths c ON c.source = a.source AND c.id = b.id AND c.dist = a.dist + b.dist + 1 GROUP BY 1, 2)
    SELECT src, dst, round(s / (25 * 24) * 2, 6) AS betweenness FROM b WHERE src < dst"""
)
def edge_betweenness(t):
    return rounded(gr.betweenness(*trade(t))[1], "betweenness")


# -- features over related tables -------------------------------------------

RELATIONS = [sy.Relation("customer", "orders", "o_custkey"), sy.Relation("orders", "lineitem", "l_orderkey")]


def entities(t):
    return [
        sy.Table("customer", t.customer.select("c_custkey"), "c_custkey"),
        sy.Table(
            "orders", t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderkey",
            numeric=["o_totalprice"], category=["o_orderpriority"], time=["o_orderdate"],
        ),
        sy.Table(
            "lineitem",
            t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag", (F.col("l_discount") > 0.05).alias("discounted")),
            "l_orderkey", numeric=["l_quantity"], category=["l_returnflag"], boolean=["discounted"],
        ),
    ]


def plain(name):
    return re.sub(r"\W+", "_", name).strip("_").lower()


def digits(name):
    """Skews of small counts are often exact binary fractions: round later."""
    return 9 if "SKEW" in name else 4 if name.startswith("STD(") else 7


def aggregate_sql(child, numeric, category, boolean=()):
    """The aggregates of ``synth.aggregates`` as (name, DuckDB expression)."""
    out = [(f"COUNT({child})", "count(*)")]
    for c, e in numeric:
        out += [
            (f"SUM({child}.{c})", f"coalesce(sum({e}), 0)"),
            (f"MEAN({child}.{c})", f"avg({e})"),
            (f"MIN({child}.{c})", f"min({e})"),
            (f"MAX({child}.{c})", f"max({e})"),
            (f"STD({child}.{c})", f"stddev_samp({e})"),
            (f"SKEW({child}.{c})", f"CASE WHEN max({e}) > min({e}) THEN skewness({e}) END"),
        ]
    out += [(f"PERCENT_TRUE({child}.{c})", f"avg(({e})::INT)") for c, e in boolean]
    for c, e in category:
        out += [(f"NUM_UNIQUE({child}.{c})", f"count(DISTINCT {e})"), (f"MODE({child}.{c})", f"MODE:{e}")]
    return out


def synthesized_sql():
    """DuckDB text for the same features, built level by level."""
    dates = [(f"{n}(o_orderdate)", f) for n, f in [
        ("DAY", "day(o_orderdate)"), ("MONTH", "month(o_orderdate)"), ("YEAR", "year(o_orderdate)"),
        ("WEEKDAY", "isodow(o_orderdate) - 1"),
    ]]
    line = aggregate_sql("lineitem", [("l_quantity", "l_quantity")], [("l_returnflag", "l_returnflag")], [("discounted", "l_discount > 0.05")])

    def mode(key, expr, source):
        return (
            f"(SELECT {key}, arg_min(v, (-n, v)) AS m FROM (SELECT {key}, {expr} AS v, count(*) AS n FROM {source} "
            f"WHERE {expr} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
        )

    def level(name, key, source, aggs):
        cols = ", ".join(f'{e} AS "{n}"' for n, e in aggs if not e.startswith("MODE:"))
        joins, modes = "", ""
        for i, (n, e) in enumerate(a for a in aggs if a[1].startswith("MODE:")):
            joins += f" LEFT JOIN {mode(key, e[5:], source)} m{i} USING ({key})"
            modes += f', m{i}.m AS "{n}"'
        return f"{name} AS (SELECT b.*{modes} FROM (SELECT {key}, {cols} FROM {source} GROUP BY 1) b{joins})"

    zero = ("COUNT(", "SUM(", "NUM_UNIQUE(")
    filled = ", ".join(f'coalesce("{n}", 0) AS "{n}"' if n.startswith(zero) else f'"{n}"' for n, _ in line)
    stack_num = [("o_totalprice", "o_totalprice")] + [(n, f'"{n}"') for n, _ in line if not n.startswith("MODE")]
    stack_cat = [("o_orderpriority", "o_orderpriority"), *dates] + [(n, f'"{n}"') for n, _ in line if n.startswith("MODE")]
    order = aggregate_sql("orders", stack_num, stack_cat)
    text = [
        level("g", "l_orderkey", "lineitem", line),
        f"so AS (SELECT orders.*, {filled} FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)",
        level("o1", "o_custkey", "so", order),
        "lo AS (SELECT lineitem.*, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
        level("d1", "o_custkey", "lo", line),
    ]
    every = order + line
    final = []
    for n, _ in every:
        e = f'coalesce("{n}", 0)' if n.startswith(zero) else f'"{n}"'
        final.append(f'{e} AS "{plain(n)}"' if n.startswith("MODE") else f'round(({e})::DOUBLE, {digits(n)}) + 0.0 AS "{plain(n)}"')
    return (
        f"WITH {', '.join(text)} SELECT c_custkey, {', '.join(final)} FROM customer LEFT JOIN o1 ON o1.o_custkey = c_custkey "
        "LEFT JOIN d1 ON d1.o_custkey = c_custkey"
    )


def synthesized(t):
    made = sy.synthesize(entities(t), RELATIONS, "customer")
    return made.select(
        *[F.col(f"`{c}`").alias(plain(c)) if c.startswith("MODE") or c == "c_custkey" else r(f"`{c}`", digits(c)).alias(plain(c)) for c in made.columns]
    )


@query(synthesized_sql())
def dfs_features(t):
    return synthesized(t)


def order_features(t):
    f = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"),
        F.stddev_samp("o_totalprice").alias("std"), F.max(F.unix_date(F.col("o_orderdate").cast("date"))).alias("latest"),
    )
    base = t.customer.select("c_custkey", F.col("c_acctbal").alias("label"))
    return base.join(f, "c_custkey", "left").withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


FEATURES = [plain(n) for n in re.findall(r'AS "(\w+)"', synthesized_sql().rsplit("SELECT c_custkey, ", 1)[1]) if not n.startswith("mode")]


@query(
    f"""WITH s AS ({synthesized_sql()}), b AS (SELECT c_acctbal AS label, s.* FROM s JOIN customer USING (c_custkey)),
    l AS (SELECT label, name AS feature, v FROM (SELECT label, {', '.join(f'"{c}"::DOUBLE AS "{c}"' for c in FEATURES)} FROM b)
      UNPIVOT (v FOR name IN ({', '.join(f'"{c}"' for c in FEATURES)}))),
    k AS (SELECT feature, {rank('v', 'feature')} AS x, {rank('label', 'feature')} AS y FROM l),
    m AS (SELECT feature, corr(x, y) AS c FROM k GROUP BY 1 HAVING min(x) < max(x))
    SELECT feature, round(c, 6) AS spearman FROM m ORDER BY round(c, 12) DESC, 1 LIMIT 10"""
)
def dfs_select(t):
    """Ten of all synthesized features, against the account balance."""
    table = synthesized(t).join(t.customer.select("c_custkey", F.col("c_acctbal").alias("label")), "c_custkey")
    return rounded(sy.select_features(table, FEATURES, "label"), "spearman")


@query(
    """SELECT c_custkey, (c_mktsegment = 'MACHINERY')::INT AS machinery, (c_mktsegment = 'FURNITURE')::INT AS furniture,
    (c_mktsegment = 'AUTOMOBILE')::INT AS automobile, (c_mktsegment = 'BUILDING')::INT AS building,
    (c_mktsegment = 'HOUSEHOLD')::INT AS household, 0 AS unknown FROM customer"""
)
def encode_top(t):
    made = sy.encode_top(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", 5)
    return made.select(
        "c_custkey", F.col("`c_mktsegment is unknown`").alias("unknown"),
        *[F.col(f"`c_mktsegment = {v.upper()}`").alias(v) for v in ("machinery", "furniture", "automobile", "building", "household")],
    )


# -- causal -----------------------------------------------------------------

COHORT = """k AS (SELECT c_custkey AS id, (c_mktsegment = 'BUILDING')::INT AS treat, c_nationkey AS nation, c_acctbal AS balance,
    count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spend
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  tr AS (SELECT * FROM k WHERE treat = 1), co AS (SELECT * FROM k WHERE treat = 0)"""


def cohort(t):
    spend = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spend")
    )
    base = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pos"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treat"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
    )
    return cut(
        base.join(spend, "id", "left")
        .withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
        .withColumn("spend", F.round(F.coalesce("spend", F.lit(0.0)), 2))
    )


def ate_sql(matches):
    return (
        f"WITH {COHORT}, m AS ({matches}) SELECT count(*) AS matched, round(100.0 * count(*) / (SELECT count(*) FROM co), 6) AS share_pct, "
        "round(avg(y.spend - x.spend), 4) AS ate FROM m JOIN k x ON x.id = m.id JOIN k y ON y.id = m.match_id"
    )


def ate(matches, df):
    return rounded(rounded(ca.ate_of_matches(matches, df, "treat", "spend"), "share_pct"), "ate", digits=4)


EXACT = "SELECT co.id, min(tr.id) AS match_id FROM co JOIN tr USING (nation, n_orders) GROUP BY 1"
NEAREST = """SELECT id, match_id FROM (SELECT co.id, tr.id AS match_id, sqrt(pow(co.balance - tr.balance, 2) + pow(co.n_orders - tr.n_orders, 2)) AS d,
  row_number() OVER (PARTITION BY co.id ORDER BY sqrt(pow(co.balance - tr.balance, 2) + pow(co.n_orders - tr.n_orders, 2)), tr.id) AS rn
  FROM co, tr) WHERE rn = 1 AND d < 20"""
SCORED = """SELECT id, match_id FROM (SELECT co.id, tr.id AS match_id, abs(co.balance - tr.balance) AS d,
  row_number() OVER (PARTITION BY co.id ORDER BY abs(co.balance - tr.balance), tr.id) AS rn FROM co, tr) WHERE rn = 1 AND d < 5"""


@query(ate_sql(EXACT))
def match_exact(t):
    df = cohort(t)
    return ate(ca.match_exact(df, "treat", ["nation", "n_orders"]), df)


@query(ate_sql(NEAREST))
def match_nearest(t):
    df = cohort(t)
    return ate(ca.match_nearest(df, "treat", ["balance", "n_orders"], 20), df)


@query(f"WITH {COHORT}, m AS ({SCORED}) SELECT * FROM m")
def match_score(t):
    return ca.match_score(cohort(t), "treat", "balance", 5.0).select("id", "match_id")


@query(ate_sql(SCORED))
def match_score_ate(t):
    df = cohort(t)
    return ate(ca.match_score(df, "treat", "balance", 5.0), df)


TWO = f"""WITH {COHORT}, f1 AS (SELECT regr_slope(spend, balance) AS s, regr_intercept(spend, balance) AS i FROM tr),
  f0 AS (SELECT regr_slope(spend, balance) AS s, regr_intercept(spend, balance) AS i FROM co)
  SELECT round(avg(CASE WHEN treat = 1 THEN spend - (f0.s * balance + f0.i) ELSE f1.s * balance + f1.i - spend END), 4) AS ate FROM k, f0, f1"""


@query(TWO)
def two_line_ate(t):
    return rounded(ca.two_line_ate(cohort(t), "treat", "spend", "balance"), "ate", digits=4)


@query(TWO)
def two_model_ate(t):
    return rounded(ca.two_model_ate(cohort(t), "treat", "spend", ["balance"]), "ate", digits=4)


@query(
    f"""WITH {COHORT}, f AS (SELECT regr_slope(treat, balance) AS s, regr_intercept(treat, balance) AS i FROM k)
    SELECT round(regr_slope(spend, treat - (s * balance + i)), 4) AS ate FROM k, f"""
)
def backdoor_linear(t):
    return rounded(ca.backdoor_linear(cohort(t), "treat", "spend", ["balance"]), "ate", digits=4)


@query()
def propensity_ate(t):
    df = cohort(t)
    scored = cut(ca.propensity(df, "treat", ["nation", "balance", "n_orders"]))
    return ca.ate_of_matches(ca.match_score(scored, "treat", "score", 0.01), df, "treat", "spend")


@query()
def backdoor_matching(t):
    return ca.backdoor_matching(cohort(t), "treat", "spend", ["nation", "balance", "n_orders"])


@query(
    """WITH e AS (SELECT DISTINCT 'nation' || n_nationkey AS src, 'region' || n_regionkey AS dst FROM nation
      UNION SELECT DISTINCT 'nation' || c_nationkey, c_mktsegment FROM customer)
    SELECT a.src AS cause FROM e a JOIN e b USING (src) WHERE a.dst = 'region1' AND b.dst = 'BUILDING'"""
)
def common_causes(t):
    nation = lambda c: F.concat(F.lit("nation"), c).alias("src")
    edges = t.nation.select(nation("n_nationkey"), F.concat(F.lit("region"), "n_regionkey").alias("dst")).unionByName(
        t.customer.select(nation("c_nationkey"), F.col("c_mktsegment").alias("dst"))
    )
    return ca.common_causes(edges, "region1", "BUILDING")
