import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import graph as gr
from tablewright.plans import lineage

# A small friendship graph, one entry listed twice.
FRIENDS = [
    ("Mary", ["Peter", "Albert", "DavidF", "Peter"]), ("Judy", ["Bob", "Alan"]), ("Peter", ["Mary", "DavidF", "Jon"]),
    ("DavidF", ["Albert", "Joseph", "Peter", "Mary"]), ("Jon", ["Peter", "Joseph", "DavidE"]),
    ("DavidE", ["Jon", "Joseph", "Albert"]), ("Joseph", ["DavidE", "Jon", "DavidF"]), ("Bob", ["Judy", "Alan"]),
    ("Alan", ["Bob", "Mary", "Judy"]), ("Albert", ["DavidF", "Mary", "DavidE"]),
]
BETWEEN = {
    "Mary": 0.5139, "Alan": 0.3889, "DavidF": 0.1528, "Albert": 0.1250, "Peter": 0.1250, "DavidE": 0.0417,
    "Jon": 0.0417, "Joseph": 0.0278, "Bob": 0.0, "Judy": 0.0,
}
CLOSE = {"Mary": 0.6429, "DavidF": 0.5625, "Albert": 0.5294, "Alan": 0.5, "Bob": 0.36, "Judy": 0.36}


@pytest.fixture(scope="module")
def friends(spark):
    table = spark.createDataFrame(FRIENDS, "person string, knows array<string>")
    return gr.graph_from_adjacency(table, "person", "knows")


def test_friends(friends):
    v, e = friends
    assert (v.count(), e.count()) == (10, 15)
    paths = gr.shortest_paths(v, e)
    assert gr.diameter(paths).first()[0] == 4
    assert {r.dist: r.n for r in gr.distance_histogram(paths).collect()} == {1: 30, 2: 30, 3: 18, 4: 12}
    close = {r.id: round(r.closeness, 4) for r in gr.closeness(paths).collect()}
    assert {k: close[k] for k in CLOSE} == CLOSE
    by_vertex, by_edge = gr.betweenness(v, e)
    assert {r.id: round(r.betweenness, 4) for r in by_vertex.collect()} == BETWEEN
    # every shortest path has `dist` edges: edge scores add up to the distances
    total = by_edge.agg(F.sum("betweenness")).first()[0] * 10 * 9 / 2
    assert total == pytest.approx(paths.agg(F.sum("dist")).first()[0] / 2)
    assert {r.id: r.degree for r in gr.degree(v, e, above=3).collect()}["Mary"] == 4
    assert gr.pagerank(v, e).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_pivots_are_scaled(friends):
    v, e = friends
    all_of_them = gr.pivots(v, 10)
    exact = {r.id: r.betweenness for r in gr.betweenness(v, e, all_of_them)[0].collect()}
    assert {k: round(x, 4) for k, x in exact.items()} == BETWEEN


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rnd = random.Random(4)
    n = 60
    edges = {
        "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(35)],
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(n - 1, i) for i in range(n - 1)],
    }[kind]
    v = spark.range(n)
    e = gr.graph_from_edges(spark.createDataFrame(edges, "src long, dst long"))
    got = {r.id: r.component for r in gr.components(v, e).collect()}
    assert got == roots(n, [(a, b) for a, b in edges if a != b])
    big, inner = gr.largest_component(v, e)
    sizes = [list(got.values()).count(c) for c in set(got.values())]
    assert big.count() == max(sizes)


def test_pagerank_with_a_lone_vertex(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    got = {r.id: r.rank for r in gr.pagerank(v, e).collect()}
    rank = {k: 0.25 for k in "abcd"}
    near = {"a": "bc", "b": "a", "c": "a", "d": ""}
    for _ in range(200):
        rank = {
            k: 0.15 / 4 + 0.85 * (sum(rank[m] / len(near[m]) for m in near if k in near[m]) + rank["d"] / 4) for k in rank
        }
    assert got == pytest.approx(rank, abs=1e-5)


def test_influencers_and_subgraph(spark):
    # a hub, a ring around it, and a separate pair
    edges = [("hub", f"r{i}") for i in range(8)] + [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)] + [("x", "y")]
    e = gr.graph_from_edges(spark.createDataFrame(edges, "src string, dst string"))
    v = gr.vertices_of(e)
    got = {r.id: r.rank for r in gr.influencers(v, e, drop_from=0.15, keep_from=0.01).collect()}
    assert got.keys() == {f"r{i}" for i in range(8)}
    assert sum(got.values()) == pytest.approx(1, abs=1e-4)
    full = {r.id for r in gr.influencers(v, e, keep_from=0.01, rerank="full").collect()}
    assert full == {"hub", *[f"r{i}" for i in range(8)]}


def test_a_long_path_is_followed_to_its_end(spark):
    v = spark.range(10).selectExpr("id")
    e = spark.range(9).selectExpr("id AS src", "id + 1 AS dst")
    assert gr.diameter(gr.shortest_paths(v, e)).first()[0] == 9
    part = gr.shortest_paths(v, e, max_depth=3)
    assert gr.diameter(part).first()[0] == 3 and {r.complete for r in part.select("complete").distinct().collect()} == {False}
    assert gr.shortest_paths(v, e, max_depth=9).select("complete").first()[0]


def test_pagerank_in_blocks_moves_arcs_once(spark, monkeypatch):
    """Many blocks, a hub, an id in two rows, one without arcs, a NULL id: as by direct rounds; no round shuffles arcs."""
    rnd = np.random.default_rng(3)
    pairs = sorted({(0, i) for i in range(1, 40)} | {tuple(sorted(p)) for p in rnd.integers(0, 40, (60, 2)).tolist() if p[0] != p[1]})
    ids = [*range(40), 5, 40, 40, None]
    v, e = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "src long, dst long")
    plans, write = [], gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    got = gr.pagerank(v, e, max_iter=8, fixed=True, task_arcs=20, cut_every=4).collect()
    link = np.zeros((42, 42))
    for a, b in pairs:
        link[a, b] = link[b, a] = 1
    out, m = link.sum(0), np.array([ids.count(i) for i in [*range(41), None]])
    rank = np.full(42, 1 / 44)
    for _ in range(8):
        lone = (rank * m)[out == 0].sum()
        rank = 0.15 / 44 + 0.85 * (link @ np.divide(rank * m, out, out=np.zeros(42), where=out > 0) + lone / 44)
    want = {i: rank[41 if i is None else i] for i in ids}
    assert len(got) == 44 and all(r.rank == pytest.approx(want[r.id], rel=1e-9) for r in got)
    rounds = [p for p in plans if "got" in p]
    assert rounds and all("InMemoryRelation" in p for p in rounds)


def test_rounds_leave_no_steps(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lineage, "steps_folder", lambda _: str(tmp_path))
    ring = spark.createDataFrame([(i, (i * 7 + 1) % 40) for i in range(40)], "src long, dst long")
    edges = gr.graph_from_edges(ring)
    ranks = gr.pagerank(gr.vertices_of(edges), edges, epsilon=1e-9)
    assert len(list(tmp_path.glob("step-*"))) == 2  # one for every four rounds, before
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    gr.components(gr.vertices_of(edges), edges).count()
    assert len(list(tmp_path.glob("step-*"))) == 3


def test_shuffled_files_go_with_the_run_that_made_them(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
