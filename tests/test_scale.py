"""How the work is dealt: what a small table shows of a large one."""

from pyspark.ml.clustering import KMeans

from tablewright.operators import anomaly as an, forest as fo, graph as gr, synth as sy
from workload import numbers


def coded(spark, n):
    rows = [(i, ["a" if i % 50 else "b", str(i % 3), str(float(i % 7))]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, f array<string>").coalesce(1)


def test_rows_of_one_partition_are_dealt_to_many_tasks(spark, monkeypatch):
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.storageLevel.useMemory)) or fit(self, df))
    few = an.detect_coded(coded(spark, 300), "f", "id", [0, 1], 2, 2, 0.5)
    assert {p for p, _ in seen} == {1}
    assert few.count() and set(few.select("id").toPandas()["id"]) < set(range(300))
    seen.clear()
    monkeypatch.setattr(an, "TASK_ROWS", 100)
    an.detect_coded(coded(spark, 300), "f", "id", [0, 1], 2, 2, 0.5)
    assert len(seen) == 10 and min(p for p, _ in seen) >= 3
    assert not any(kept for _, kept in seen)  # a persisted frame would be turned into vectors anew on each pass


def test_upper_nodes_are_cut_without_copies_of_rows(spark, monkeypatch):
    written, cut = [], fo.cut

    def noted(df):
        done = cut(df)
        written.append(done.count())
        return done

    monkeypatch.setattr(fo, "cut", noted)
    rows = [(i, float(i % 30), float(i * 7 % 13), float(i % 30 + i * 7 % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    found = fo.forests(df, "id", {"both": ["a", "b"], "one": ["a"]}, "y", trees=4, node_rows=100)
    assert max(written) == 400  # not rows x trees x variants
    assert found.where("feature IS NULL").count() == 400 * 4 * 2
    assert fo.scores(found, df, "id", "y", ["both"]).first().r2 > 0.97


def test_a_graph_is_ranked_once_and_its_rest_once(spark, monkeypatch):
    edges = [("hub", f"r{i}") for i in range(8)] + [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)]
    e = gr.graph_from_edges(spark.createDataFrame(edges, "src string, dst string"))
    monkeypatch.setattr(numbers, "traded", lambda t: (gr.vertices_of(e), e))
    calls, rank = [], gr.pagerank
    monkeypatch.setattr(gr, "pagerank", lambda *a, **b: calls.append(1) or rank(*a, max_iter=4))
    got = {r.id: r.rank for r in numbers.influencers(None).collect()}
    assert got.keys() == {f"r{i}" for i in range(8)} and len(calls) == 2


def test_features_are_made_once_before_they_are_ranked(spark, monkeypatch):
    kept, cut = [], sy.cut
    monkeypatch.setattr(sy, "cut", lambda df: kept.append(df.columns) or cut(df))
    df = spark.createDataFrame([(i, float(i), float(-i), float(i % 3), float(i)) for i in range(30)], "id long, a double, b double, c double, y double")
    best = sy.select_features(df, ["a", "b", "c"], "y", k=1).first()
    assert (best.feature, best.spearman) == ("a", 1.0) and kept == [["f0", "f1", "f2", "_label"]]
