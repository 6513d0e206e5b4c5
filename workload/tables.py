"""Projections, aggregates, order, sets, sources."""

import os
import uuid

from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.functions.sampling import split_by_hash
from tablewright.operators import encode as ec, graph as gr, models as ml, table as tb
from tablewright.plans.lineage import steps_folder
from tablewright.sources import readers, writers
from workload.registry import query, r, rounded, u


def scratch(t, name):
    return os.path.join(steps_folder(t.spark), f"{name}-{uuid.uuid4().hex}")


# -- sources and sinks ------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def csv_round_trip(t):
    path = scratch(t, "csv")
    writers.csv(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return readers.csv(
        t.spark, path, "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"
    )


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_directory(t):
    path = scratch(t, "csvdir")
    writers.csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), path, header=False)
    return readers.csv_directory(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier")
def csv_in_order(t):
    path = scratch(t, "csvpos")
    writers.csv(t.supplier.select("s_suppkey", "s_acctbal").orderBy("s_suppkey"), path)
    return readers.csv_in_order(t.spark, path, "s_suppkey bigint, s_acctbal double")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def tsv_gz_round_trip(t):
    path = scratch(t, "tsv")
    writers.csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path, sep="\t", compression="gzip")
    return readers.tsv_gz(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query(
    """SELECT DISTINCT least(p.l_partkey, p.l_suppkey) AS src, greatest(p.l_partkey, p.l_suppkey) AS dst
    FROM lineitem p WHERE p.l_partkey <> p.l_suppkey"""
)
def edge_list_graph(t):
    """Parts and suppliers as vertices of one number range, from a text with spaces between them."""
    path = scratch(t, "edges")
    writers.csv(t.lineitem.select("l_partkey", "l_suppkey"), path, header=False, sep=" ")
    return gr.graph_from_edges(readers.edge_list(t.spark, path))


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_lines_round_trip(t):
    path = scratch(t, "json")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return readers.json_lines(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query(
    """SELECT event_id, event_type AS kind, user_id, value FROM events"""
)
def list_literal_cells(t):
    cells = F.concat(F.lit("['"), "event_type", F.lit("', "), "user_id", F.lit(", "), "value", F.lit("]"))
    listed = t.events.select("event_id", tx.list_literal(cells).alias("f"))
    return listed.select(
        "event_id", F.col("f")[0].alias("kind"), F.col("f")[1].cast("bigint").alias("user_id"),
        F.col("f")[2].cast("double").alias("value"),
    )


@query(
    "SELECT count(*) AS vertices, sum(n_regionkey)::BIGINT AS regions, round(sum(n_nationkey * 0.5::DOUBLE), 6) AS halves FROM nation"
)
def graphml_scan(t):
    path = scratch(t, "graphml")
    row = F.concat(
        F.lit('<node id="n'), "n_nationkey", F.lit('"><data key="r">'), "n_regionkey",
        F.lit('</data><data key="h">0x'), F.lower(F.hex("n_nationkey")), F.lit("p-1</data></node>"),
    )
    nodes = F.array_join(F.array_sort(F.collect_list(row)), "\n")
    t.nation.agg(F.concat(F.lit("<graphml>\n"), nodes, F.lit("\n</graphml>")).alias("value")).write.text(path)
    v, _ = readers.graphml(t.spark, path)
    return v.agg(
        F.count(F.lit(1)).alias("vertices"),
        F.sum(F.col("data")["r"].cast("int")).alias("regions"),
        r(F.sum(readers.hex_float(F.col("data")["h"]))).alias("halves"),
    )


# -- projections and filters ------------------------------------------------


@query(
    """SELECT p_partkey, round((p_size + p_retailprice) / 1e6, 8) AS price,
    CASE WHEN p_retailprice >= (SELECT avg(p_retailprice) FROM part) THEN 1 ELSE 0 END AS high,
    CASE WHEN p_size >= 25 THEN p_size ELSE 0 END AS p_size, nullif(p_name, 'red bolt') AS p_name
    FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size BETWEEN 5 AND 45"""
)
def part_projection(t):
    df = tb.binarize_at_mean(t.part, "p_retailprice", "high")
    df = tb.with_prefix(df, "p_brand", "Brand#1", F.col("p_size").between(5, 45))
    df = tb.add_sum(df, "price", "p_size", "p_retailprice", 1e6)
    df = tb.sentinel_to_null(tb.zero_below(df, "p_size", 25), "p_name", "red bolt")
    return df.select("p_partkey", r("price", 8).alias("price"), "high", "p_size", "p_name")


@query(
    """SELECT l_suppkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_tax) AS l_tax
    FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1998 GROUP BY l_suppkey"""
)
def entity_year_max(t):
    return tb.group_max(tb.years_around(t.lineitem, "l_shipdate", 1997, 1), "l_suppkey", ["l_quantity", "l_extendedprice", "l_tax"])


LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


@query(
    f"""WITH j AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM {LABELLED})
    UNPIVOT (SELECT round(100.0 * count_if(lang IS NULL) / count(*), 6) AS lang,
      round(100.0 * count_if(n_chars IS NULL) / count(*), 6) AS n_chars,
      round(100.0 * count_if(quality IS NULL) / count(*), 6) AS quality,
      round(100.0 * count_if(toxic IS NULL) / count(*), 6) AS toxic FROM j)
    ON lang, n_chars, quality, toxic INTO NAME "column" VALUE missing_pct"""
)
def missing_share(t):
    return rounded(tb.missing_share(labelled(t), ["lang", "n_chars", "quality", "toxic"]), "missing_pct")


@query(
    f"""SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM {LABELLED}"""
)
def fill_missing(t):
    return tb.fill_missing(labelled(t).select("doc_id", "quality", "toxic"))


@query(f"SELECT d.doc_id, l.quality FROM {LABELLED} WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def complete_rows(t):
    return tb.complete_rows(labelled(t), ["quality", "toxic"]).select("doc_id", "quality")


@query(
    """SELECT l_suppkey, round(max(abs(l_quantity * 1500 - l_extendedprice)), 4) AS row_error,
    round(abs(max(l_quantity * 1500) - max(l_extendedprice)), 4) AS max_error FROM lineitem GROUP BY 1"""
)
def station_errors(t):
    df = t.lineitem.withColumn("guess", F.col("l_quantity") * 1500)
    rows = ml.station_errors(df, "l_suppkey", "l_extendedprice", "guess").withColumnRenamed("error", "row_error")
    tops = ml.station_errors(df, "l_suppkey", "l_extendedprice", "guess", True).withColumnRenamed("error", "max_error")
    return rounded(rows.join(tops, "l_suppkey"), "row_error", "max_error", digits=4)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_quantity * 1500 - l_extendedprice), 4) AS error,
    l_returnflag || ' ' || l_linestatus AS label FROM lineitem"""
)
def abs_error_label(t):
    df = t.lineitem.withColumn("guess", F.col("l_quantity") * 1500)
    df = tb.abs_error(df, "guess", "l_extendedprice", "error", "label", ["l_returnflag", "l_linestatus"])
    return rounded(df, "error", digits=4).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error", "label")


# -- aggregates -------------------------------------------------------------

YEARS = "SELECT year(o_orderdate) AS y, count(o_orderkey) AS n FROM orders GROUP BY 1"


def by_year(t):
    return t.orders.withColumn("y", F.year("o_orderdate"))


@query(YEARS)
def year_counts(t):
    return tb.group_count(by_year(t), "y", "o_orderkey")


@query(f"SELECT * FROM ({YEARS}) ORDER BY n DESC, y LIMIT 3")
def top_years(t):
    return tb.top(tb.group_count(by_year(t), "y", "o_orderkey"), 3, "n", "y")


@query(
    "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY 1 HAVING count(o_orderkey) >= 12"
)
def busy_customers(t):
    return tb.group_count(t.orders, "o_custkey", "o_orderkey", at_least=12)


@query(
    """WITH d AS (SELECT o_orderdate::DATE AS d, count(*)::DOUBLE AS x FROM orders GROUP BY 1),
    e AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
    b AS (SELECT least(floor((x - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM d, e GROUP BY 1)
    SELECT i AS bin, round(lo + i * ((hi - lo) / 30), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 30), 6) AS high,
    coalesce(n, 0) AS n, CASE WHEN n > 0 THEN round(log10(n), 6) END AS log_n
    FROM range(30) g(i) CROSS JOIN e LEFT JOIN b ON b.bin = i"""
)
def count_histogram(t):
    days = tb.group_count(t.orders.withColumn("d", F.col("o_orderdate").cast("date")), "d", "o_orderkey", "x")
    return rounded(tb.histogram(days, "x", 30), "low", "high", "log_n")


@query(
    """WITH l AS (UNPIVOT (SELECT c_custkey::DOUBLE AS c_custkey, c_nationkey::DOUBLE AS c_nationkey, c_acctbal FROM customer)
      ON c_custkey, c_nationkey, c_acctbal INTO NAME "column" VALUE v)
    SELECT "column", count(v) AS "count", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
    max(v) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
    round(quantile_cont(v, 0.75), 6) AS q75 FROM l GROUP BY 1"""
)
def table_summary(t):
    return rounded(tb.describe(t.customer), "mean", "std", "q25", "q50", "q75")


@query(f"SELECT d.lang, l.quality, count(*) AS n FROM {LABELLED} GROUP BY 1, 2")
def value_counts(t):
    return tb.value_counts(labelled(t), "lang", "quality")


@query(
    """SELECT 'p_size' AS "column", min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high FROM part
    UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part"""
)
def column_bounds(t):
    return tb.column_bounds(t.part, ["p_size", "p_retailprice"])


@query(
    """SELECT count(*) AS n, (count(*) * (count(*) - 1) / 2)::BIGINT AS pairs FROM customer"""
)
def row_and_pair_count(t):
    from tablewright.operators.entity import pair_count

    return tb.row_count(t.customer).withColumn("pairs", pair_count(t.customer).scalar())


@query(
    """SELECT year(o_orderdate) AS y, round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
    round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75
    FROM orders GROUP BY 1"""
)
def group_quartiles(t):
    return rounded(tb.group_quartiles(by_year(t), "y", "o_totalprice"), "q25", "q50", "q75")


@query(
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1"""
)
def group_median(t):
    return rounded(tb.median(t.lineitem, "l_extendedprice", ["l_returnflag"]), "median")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def crosstab_margins(t):
    return tb.crosstab(t.lineitem, "l_returnflag", "l_linestatus")


@query(
    """SELECT coalesce(l_returnflag, 'All') AS l_returnflag, count_if(l_linestatus = 'F') AS "F",
    count_if(l_linestatus = 'O') AS "O", count(*) AS "All" FROM lineitem GROUP BY ROLLUP (l_returnflag)"""
)
def crosstab_wide(t):
    return tb.crosstab_wide(t.lineitem, "l_returnflag", "l_linestatus")


@query(
    """WITH e AS (SELECT min(p_size)::DOUBLE - 1e-9 * (max(p_size) - min(p_size)) AS x0,
      (max(p_size) - min(p_size))::DOUBLE * (1 + 2e-9) / 20 AS sx,
      min(p_retailprice) - 1e-9 * (max(p_retailprice) - min(p_retailprice)) AS y0,
      (max(p_retailprice) - min(p_retailprice)) * (1 + 2e-9) / 11 AS sy FROM part),
    p AS (SELECT (p_size - x0) / sx AS x, (p_retailprice - y0) / sy AS y, e.* FROM part, e),
    c AS (SELECT *, round_even(x, 0) AS ax, round_even(y, 0) AS ay, floor(x) AS bx, floor(y) AS by_ FROM p),
    d AS (SELECT *, pow(x - ax, 2) + 3 * pow(y - ay, 2) < pow(x - bx - 0.5, 2) + 3 * pow(y - by_ - 0.5, 2) AS one FROM c),
    k AS (SELECT CASE WHEN one THEN 0 ELSE 1 END AS lattice, (CASE WHEN one THEN ax ELSE bx END)::BIGINT AS ix,
      (CASE WHEN one THEN ay ELSE by_ END)::BIGINT AS iy, sx, sy, x0, y0 FROM d)
    SELECT lattice, ix, iy, round((ix + lattice * 0.5) * sx + x0, 6) AS cx, round((iy + lattice * 0.5) * sy + y0, 6) AS cy,
    count(*) AS n FROM k GROUP BY ALL"""
)
def hexbin(t):
    return rounded(tb.hexbin(t.part, "p_size", "p_retailprice"), "cx", "cy")


@query(
    """SELECT event_type, row_number() OVER (ORDER BY f) - 1 AS index, f AS first
    FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1)"""
)
def distinct_in_order(t):
    return tb.distinct_in_order(t.events, "event_type", "event_id")


@query(
    """SELECT user_id, event_type, event_id, value FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1"""
)
def keep_first(t):
    df = t.events.select("user_id", "event_type", "event_id", "value")
    return tb.keep_first(df, ["user_id", "event_type"], "event_id")


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders
    QUALIFY row_number() OVER (ORDER BY o_orderkey) - 1 < (SELECT count(*) FROM orders) - 5"""
)
def all_but_last(t):
    placed = tb.with_position(t.orders.select("o_orderkey"), "o_orderkey")
    return tb.all_but_last(placed, 5, "pos")


@query(
    """(SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL
    (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 5)"""
)
def top_and_bottom(t):
    from tablewright.operators.entity import top_and_bottom as both_ends

    return both_ends(t.customer.select("c_custkey", "c_acctbal"), 5, ("c_acctbal", True), "c_custkey")


@query("SELECT c_custkey, abs(c_acctbal - 5000) AS gap FROM customer ORDER BY 2, 1 LIMIT 1")
def argmin_row(t):
    df = t.customer.select("c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("gap"))
    return tb.argmin_row(df, "gap", "c_custkey")


@query(
    """SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS index, n_name AS label FROM embeddings
    LEFT JOIN nation ON n_nationkey = list_position(embedding, list_max(embedding)) - 1"""
)
def argmax_label(t):
    names = t.nation.select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))
    return tb.argmax_label(t.embeddings.select("vec_id", "embedding"), "embedding", names).select("vec_id", "index", "label")


@query(
    """SELECT c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier"""
)
def stacked_rows(t):
    return tb.stacked(
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")),
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def row_difference(t):
    taken = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tb.difference(t.customer.select("c_custkey"), taken, ["c_custkey"])


@query(
    f"""SELECT CASE WHEN u < 0.75 THEN 0 ELSE 1 END AS part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last
    FROM (SELECT o_orderkey, {u(7, 0, 'o_orderkey')} AS u FROM orders) GROUP BY 1"""
)
def hashed_split(t):
    return split_by_hash(t.orders, [0.75, 0.25], "o_orderkey").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )


@query(f"SELECT p_partkey, round({u(7, 0, 'p_partkey')}, 9) AS probe FROM part")
def random_probe(t):
    return rounded(ml.add_probe(t.part.select("p_partkey"), "p_partkey"), "probe", digits=9)


# -- encoding ---------------------------------------------------------------


@query(
    """WITH d AS (SELECT 0 AS o, event_type AS v, min(event_id) AS p FROM events GROUP BY 2
      UNION ALL SELECT 1, (user_id % 7)::VARCHAR, min(event_id) FROM events GROUP BY 2),
    l AS (SELECT list(struct_pack(o := o, v := v) ORDER BY o, p) AS levels FROM d)
    SELECT event_id, array_to_string(list_transform(levels, lambda s: CASE WHEN s.v =
      (CASE WHEN s.o = 0 THEN event_type ELSE (user_id % 7)::VARCHAR END) THEN '1' ELSE '0' END), '')
      || ' ' || (round(value * 100))::BIGINT AS coded FROM events, l"""
)
def one_hot(t):
    f = F.array("event_type", (F.col("user_id") % 7).cast("string"), F.col("value").cast("string"))
    coded = ec.one_hot(t.events.select("event_id", f.alias("f")), "f", [0, 1], "event_id")
    n = F.size("f") - 1
    bits = F.array_join(F.transform(F.slice("f", F.lit(1), n), lambda v: v.cast("int").cast("string")), "")
    return coded.select(
        "event_id", F.concat_ws(" ", bits, F.round(F.element_at("f", -1) * 100).cast("bigint").cast("string")).alias("coded")
    )


@query(
    """WITH m AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
      stddev_samp(l_extendedprice) AS sp FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - mq) / sq, 6) AS quantity,
    l_discount AS discount, round((l_extendedprice - mp) / sp, 6) AS price, 0.0::DOUBLE AS constant FROM lineitem, m"""
)
def standardize(t):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    f = F.array("l_quantity", "l_discount", "l_extendedprice", F.lit(4.0))
    z = ec.standardize(t.lineitem.select(*ids, f.alias("f")), "f", [0, 2, 3])
    return z.select(
        *ids, r(F.col("f")[0]).alias("quantity"), F.col("f")[1].alias("discount"), r(F.col("f")[2]).alias("price"),
        F.col("f")[3].alias("constant"),
    )


@query(
    f"""WITH b AS (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1
      FROM part WHERE {u(7, 0, 'p_partkey')} < 0.8)
    SELECT p_partkey, round((p_size - s0) / (s1 - s0)::DOUBLE, 6) AS p_size,
    round((p_retailprice - r0) / (r1 - r0), 6) AS p_retailprice FROM part, b"""
)
def min_max_fitted(t):
    from tablewright.functions.sampling import train_test

    cols = ["p_size", "p_retailprice"]
    train, _ = train_test(t.part, 0.2, "p_partkey")
    return rounded(ec.min_max_scale(t.part.select("p_partkey", *cols), ec.min_max_bounds(train, cols), cols), *cols)


@query(
    """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM c)
    SELECT vec_id, round(max((x - m) / s) FILTER (i = 1), 6) AS first, round(max((x - m) / s), 6) AS largest,
    round(sum((x - m) / s), 5) AS total FROM c, m GROUP BY 1"""
)
def standardize_cells(t):
    z = ec.standardize_cells(t.embeddings.select("vec_id", "embedding"), "embedding", "z")
    return z.select(
        "vec_id", r(F.col("z")[0]).alias("first"), r(F.array_max("z")).alias("largest"),
        r(F.aggregate("z", F.lit(0.0), lambda a, v: a + v), 5).alias("total"),
    )


BOXES = """SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 11)::DOUBLE AS y, 8.0 + p_partkey % 5 AS w, 6.0 + p_size % 7 AS h,
  p_size + (p_partkey % 3)::DOUBLE AS tx, (p_partkey % 13)::DOUBLE AS ty, 7.0 + p_partkey % 4 AS tw, 9.0 AS th FROM part"""


@query(
    f"""WITH b AS ({BOXES}), s AS (SELECT *, greatest(least(x + w, tx + tw) - greatest(x, tx), 0.0)
      * greatest(least(y + h, ty + th) - greatest(y, ty), 0.0) AS i FROM b)
    SELECT p_partkey, round(i / (w * h + tw * th - i), 6) AS iou FROM s"""
)
def box_iou(t):
    return rounded(boxes(t).select("p_partkey", "iou"), "iou")


def boxes(t):
    k = F.col("p_partkey")
    num = lambda c: c.cast("double")
    size = F.col("p_size")
    pred = t.part.select(k, num(size).alias("x"), num(k % 11).alias("y"), num(8 + k % 5).alias("w"), num(6 + size % 7).alias("h"))
    true = t.part.select(k, num(size + k % 3).alias("x"), num(k % 13).alias("y"), num(7 + k % 4).alias("w"), F.lit(9.0).alias("h"))
    scaled = ec.unscale_boxes(ec.scale_boxes(pred, 8), 8)
    return ec.box_overlap(scaled, true, "p_partkey")


@query(
    f"""WITH b AS ({BOXES}), s AS (SELECT *, greatest(least(x + w, tx + tw) - greatest(x, tx), 0.0)
      * greatest(least(y + h, ty + th) - greatest(y, ty), 0.0) AS i FROM b)
    SELECT round(avg(i / (w * h + tw * th - i)), 6) AS mean_iou FROM s"""
)
def mean_iou(t):
    return rounded(ec.mean_iou(boxes(t)), "mean_iou")


@query(
    """WITH e AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)
    SELECT s_suppkey, round(2 + 13 * pow((s_acctbal - lo) / (hi - lo), 0.5), 6) AS size FROM supplier, e"""
)
def score_to_size(t):
    return rounded(ec.to_size(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 2, 15), "size").select("s_suppkey", "size")


@query(
    """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), e AS (SELECT max(n) AS hi, min(n) AS lo FROM n)
    SELECT vec_id, e2.label, round((hi - n)::DOUBLE / (hi - lo), 6) AS score FROM embeddings e2 JOIN n ON n.label = e2.label, e
    WHERE (hi - n)::DOUBLE / (hi - lo) >= 0.5"""
)
def rare_group_score(t):
    from tablewright.operators.anomaly import rare_group_score as score

    return rounded(score(t.embeddings.select("vec_id", "label"), "label", 0.5), "score").select("vec_id", "label", "score")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS size FROM events")
def group_sizes(t):
    from tablewright.operators.anomaly import group_sizes as sizes

    return sizes(t.events.select("event_id", "user_id"), "user_id")
