"""Sources, pages, encoding, anomalies, boxes."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomaly as an, encode as ec, pages as pg, table as tb
from tablewright.sources import readers, writers

# Five connections, two categorical positions and one number.
TOY = [(0, ["http", "udt", "4"]), (1, ["http", "udf", "5"]), (2, ["http", "tcp", "5"]), (3, ["ftp", "icmp", "1"]), (4, ["http", "tcp", "4"])]
CODED = {0: [1, 0, 1, 0, 0, 0], 1: [1, 0, 0, 1, 0, 0], 2: [1, 0, 0, 0, 1, 0], 3: [0, 1, 0, 0, 0, 1], 4: [1, 0, 0, 0, 1, 0]}
SCALED = {0: 0.12171612389003701, 1: 0.7302967433402214, 2: 0.7302967433402214, 3: -1.704025734460517, 4: 0.12171612389003701}


@pytest.mark.parametrize("partitions", [1, 5])
def test_anomaly_toy(spark, partitions):
    df = spark.createDataFrame(TOY, "id int, f array<string>").repartition(partitions)
    coded = ec.one_hot(df, "f", [0, 1], "id")
    rows = {r.id: r.f for r in coded.collect()}
    assert {k: [int(x) for x in v[:6]] for k, v in rows.items()} == CODED
    assert all(sum(v[:6]) == 2 for v in rows.values())
    scaled = ec.standardize(coded, "f", [6])
    assert {r.id: r.f[6] for r in scaled.collect()} == pytest.approx(SCALED, abs=1e-12)
    assert [(r.id, r.score) for r in an.detect(scaled, "f", 2, 0.9).collect()] == [(3, 1.0)]
    assert [r.id for r in an.anomaly_pipeline(df, "f", "id", (0, 1), [6], 2, 0.9).collect()] == [3]
    assert [r.id for r in an.detect_coded(df, "f", "id", [0, 1], 2, 2, 0.9).collect()] == [3]


def test_equal_groups_score_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, g string")
    assert an.rare_group_score(df, "g").where("score IS NOT NULL").count() == 0
    assert an.rare_group_score(df, "g", 0.0).count() == 0


def test_sparse_one_hot_equals_the_dense_form(spark):
    df = spark.createDataFrame([*TOY, (9, [None, "tcp", "0"]), (10, ["http", None, None])], "id int, f array<string>")
    dense = {r.id: r.f for r in ec.one_hot(df, "f", [0, 1], "id").collect()}
    for r in ec.one_hot_sparse(df, "f", [0, 1], "id", "id").collect():
        full = [0.0] * r.width
        for i, v in zip(r.f.indices, r.f["values"]):
            full[i] = v
        assert full == dense[r.id], r


def test_many_levels(spark):
    df = spark.range(150_000).selectExpr("id", "array(cast(id AS string), 'x', '2') AS f")
    got = ec.one_hot_sparse(df, "f", [0, 1], "id", "id").where("id IN (0, 149999)").collect()
    assert {(r.id, tuple(r.f.indices), tuple(r.f["values"]), r.width) for r in got} == {
        (0, (0, 150_000, 150_001), (1.0, 1.0, 2.0), 150_002), (149_999, (149_999, 150_000, 150_001), (1.0, 1.0, 2.0), 150_002)
    }


def test_missing_cells_do_not_count(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, [2.0, 4.0, 6.0]), (3, None)], "id int, f array<double>")
    out = {r.id: r.f for r in ec.standardize_cells(df, "f").collect()}
    v = np.array([1.0, 3.0, 2.0, 4.0, 6.0])
    assert out[1][1] is None and out[3] is None
    assert np.allclose([out[1][0], out[1][2], *out[2]], (v - v.mean()) / v.std())


def test_levels_not_asked_for_count_in_the_total(spark):
    df = spark.createDataFrame([("a", "F"), ("a", "P"), ("b", "P")], "r string, c string")
    got = {r.r: (r.F, r.All) for r in tb.crosstab_wide(df, "r", "c", ["F"]).collect()}
    assert got == {"a": (1, 2), "b": (0, 1), "All": (1, 3)}


def test_rows_of_different_width_are_refused(spark):
    df = spark.createDataFrame([(1, ["a", "1"]), (2, ["b", "1", "2"])], "id int, f array<string>")
    with pytest.raises(ValueError, match="positions"):
        an.detect_coded(df, "f", "id", [0], 1, 2, 0.9)


def test_scaling_rules(spark):
    df = spark.createDataFrame([(1, [1.0, 4.0]), (2, [3.0, None])], "id int, f array<double>")
    out = {r.id: r.f for r in ec.standardize(df, "f", [0]).collect()}
    assert out[1][1] == 4.0 and out[2][1] == 0.0
    cells = ec.standardize_cells(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "id int, f array<double>"), "f")
    flat = np.array([x for r in cells.orderBy("id").collect() for x in r.f])
    v = np.array([1.0, 2.0, 3.0, 6.0])
    assert np.allclose(flat, (v - v.mean()) / v.std())
    fixed = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    scaled = ec.min_max_scale(fixed, ec.min_max_bounds(fixed, ["a", "b"]), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in scaled) == [(0.0, 0.0), (0.0, 1.0)]


@pytest.mark.parametrize(
    "box, want", [((0, 0, 2, 2), 1.0), ((1, 0, 2, 2), 1 / 3), ((5, 5, 1, 1), 0.0), ((0, 0, 1, 1), 0.25)]
)
def test_iou(spark, box, want):
    pred = spark.createDataFrame([(1, *map(float, box))], "id int, x double, y double, w double, h double")
    true = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0)], "id int, x double, y double, w double, h double")
    over = ec.box_overlap(pred, true, "id")
    assert over.first().iou == pytest.approx(want)
    assert ec.mean_iou(over).first()[0] == pytest.approx(want)


def test_argmax_and_first_rows(spark):
    df = spark.createDataFrame([(1, [0.1, 2.0, 0.3])], "id int, s array<double>")
    names = spark.createDataFrame([(0, "cat"), (1, "dog")], "index int, name string")
    row = tb.argmax_label(df, "s", names, softmax=True).first()
    assert row.label == "dog" and row.confidence == pytest.approx(np.exp(2) / np.exp([0.1, 2.0, 0.3]).sum())
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")], "k string, pos int, v string")
    assert {r.k: r.v for r in tb.keep_first(rows, ["k"], "pos").collect()} == {"a": "early", "b": "only"}


SECTION = """<html><div class="textimage section"><h4>JANE o'neil
associate professor</h4><div><p>Area: data bases; graphs</p></div>
<a href="/people/jane.html">Profile &amp; Contact
 Information</a><a class="x" href="/no">Home page</a><a name="n">Home page</a><a href="http://home.example.org">Home  Page</a></div>
<div class="textimage section"><h4>Bo Li,lecturer</h4><a href="http://www.example.org/bo">profile &amp; contact information</a></div>
<div class="other"><a href="/zzz">Home Page</a></div></html>"""


@pytest.mark.parametrize("cut", [pg.sections, pg.nested_sections])
def test_page_records(spark, cut):
    pages = spark.createDataFrame([(1, SECTION), (2, "<html></html>")], "page_id long, html string")
    got = {r.section_no: r for r in pg.page_records(cut(pages), "http://www.example.org").collect()}
    one, two = got[1], got[2]
    assert (one.name, one["rank"], one.areas) == ("Jane O'Neil", "Associate Professor", "Data Bases, Graphs")
    assert (one.profile, one.homepage) == ("http://www.example.org/people/jane.html", "http://home.example.org")
    assert (two.name, two["rank"], two.areas) == ("Bo Li", "Lecturer", None)
    assert two.profile == "http://www.example.org/bo"
    # only the nested form knows that the section ended before the last link
    assert two.homepage == (None if cut is pg.nested_sections else "/zzz")


def test_earliest_year(spark):
    block = '<div class="text parbase section">{}</div>'
    pages = [
        (1, block.format("<h2>education</h2><ul><li>PhD, A, 2001</li><li>BSc, B, <b>1995</b></li><li>x, 198</li></ul>")),
        (2, block.format("<h2> Education </h2><p>PhD, A, 1990.\nMSc, B, 1985</p>")),
        (3, block.format("<h2>Teaching</h2><ul><li>1900</li></ul>")),
        (4, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert {r.page_id: r.year for r in pg.earliest_year(df).collect()} == {1: 1995, 2: 1985, 3: None, 4: None}


def test_text_sources(spark, tmp_path):
    (tmp_path / "pairs.json").write_text(json.dumps([["1", "2"], ["a", "b"]]))
    assert [tuple(r) for r in readers.pair_list(spark, str(tmp_path / "pairs.json")).collect()] == [(0, "1", "2"), (1, "a", "b")]
    (tmp_path / "edges.txt").write_text("0 1\n1 2\n")
    assert readers.edge_list(spark, str(tmp_path / "edges.txt")).count() == 2
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("id\tv\n1\t2.5\n2\t\n")
    assert {tuple(r) for r in readers.tsv_gz(spark, str(tmp_path / "t.tsv.gz"), "id int, v double").collect()} == {(1, 2.5), (2, None)}
    (tmp_path / "q.csv").write_text('id,t\n2,"a, ""b"""\n1,plain\n')
    rows = readers.csv_in_order(spark, str(tmp_path / "q.csv"), "id int, t string").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(2, 'a, "b"', 0), (1, "plain", 1)]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text("id\n1\n2\n")
    (tmp_path / "many" / "b.csv").write_text("id\n" + "".join(f"{i}\n" for i in range(3, 40)))
    many = readers.csv_in_order(spark, str(tmp_path / "many"), "id int").collect()
    assert sorted((r.pos, r.id) for r in many) == [(i, i + 1) for i in range(39)]
    (tmp_path / "log.json").write_text('{"search_ui": "A", "search_count": 3, "is_instructor": true, "z": 1}\n')
    log = readers.json_lines(spark, str(tmp_path / "log.json"), "search_ui string, search_count bigint, is_instructor boolean")
    assert tuple(log.first()) == ("A", 3, True)
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "jane.html").write_text("<p>1\n2</p>")
    assert tuple(readers.saved_pages(spark, str(tmp_path / "pages")).first()) == ("jane.html", "<p>1\n2</p>")
    writers.csv(spark.createDataFrame([(1, 'x "y"')], "id int, t string"), str(tmp_path / "out"))
    assert readers.csv(spark, str(tmp_path / "out"), "id int, t string").first().t == 'x "y"'


def test_graphml(spark, tmp_path):
    (tmp_path / "g.xml").write_text(
        '<graphml><graph><node id="n0">\n<data key="k0">Bob</data>\n<data key="k1">0x1.8p+1, -0x1p-1</data></node>'
        '<node id="n1"><data key="k0">Al</data></node><edge id="e0" source="n0" target="n1"><data key="k2">0x1p+2</data></edge></graph></graphml>'
    )
    v, e = readers.graphml(spark, str(tmp_path / "g.xml"))
    bob = v.where("id = 'n0'").select(F.col("data")["k0"], readers.hex_floats(F.col("data")["k1"])).first()
    assert tuple(bob) == ("Bob", [3.0, -0.5])
    assert tuple(e.select("src", "dst", readers.hex_float(F.col("data")["k2"])).first()) == ("n0", "n1", 4.0)


def test_links_in_any_quotes_and_references(spark):
    page = "<a href='/x'>Caf&eacute; &#233;&#xE9;</a><a class='nav' href=\"/y\">n</a><a href=/z>&amp;lt; &nbsp;&bogus; &</a><a class=\"\" href=\"/q?a=1&amp;b=2\">q</a>"
    got = pg.links(spark.createDataFrame([(1, page)], "page_id int, html string"), ["page_id"]).orderBy("link_no").collect()
    assert [(r.text, r.href) for r in got] == [("Café éé", "/x"), ("&lt;  &bogus; &", "/z"), ("q", "/q?a=1&b=2")]
    marked = "<div class='textimage section'><p>one</p></div><div class=\"textimage section\"><p>two</p></div>"
    parts = pg.sections(spark.createDataFrame([(1, marked)], "page_id int, html string"))
    assert parts.count() == 2


def test_crosstab_of_a_value_named_as_the_margin(spark):
    df = spark.createDataFrame([("All", "x"), ("All", "y"), ("b", "x"), (None, "x")], "r string, c string")
    got = sorted((r.r, r.x, r.y, r.All) for r in tb.crosstab_wide(df, "r", "c").collect())
    assert got == [("All", 1, 1, 2), ("All", 2, 1, 3), ("b", 1, 0, 1)]


def test_all_named_references(spark):
    df = spark.createDataFrame([("&hearts; &lt;b&gt; &amp;amp; a&nbsp;b &notareference; &NotEqualTilde; &afr;",)], "html string")
    got = df.select(pg.decoded(F.col("html"))).first()[0]
    assert got == "♥ <b> &amp; a b &notareference; ≂̸ \U0001d51e"
