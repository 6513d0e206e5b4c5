"""Undirected graphs as tables: vertices ``(id, ...)``, edges ``(src, dst)``.

Edges are stored once, ``src < dst``.  Iterations are joins and aggregates;
each round is written with ``cut``, so lineage stays short and a lost executor
costs one round at most.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W, functions as F

from tablewright.functions.sampling import hash_uniform
from tablewright.plans.lineage import cut, drop


def graph_from_edges(pairs, a="src", b="dst"):
    """Undirected edges, parallel edges and loops removed."""
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
        .distinct()
    )


def graph_from_adjacency(table, key, neighbours):
    """Vertices and edges from ``key, array of neighbours`` rows."""
    pairs = table.select(F.col(key).alias("src"), F.explode(neighbours).alias("dst"))
    alone = table.select(F.col(key).alias("id"))
    edges = graph_from_edges(pairs)
    return vertices_of(edges).unionByName(alone).distinct(), edges


def vertices_of(edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def both_ways(edges):
    """Each edge in both directions, one scan."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
                F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
            )
        )
    )


def degree(vertices, edges, above=None):
    """``(id, degree)``; with ``above``, degrees not over it become 0."""
    counts = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree")
    )
    full = vertices.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree")
    )
    if above is None:
        return full
    return full.withColumn("degree", F.when(F.col("degree") > above, F.col("degree")).otherwise(0))


def subgraph(vertices, edges, condition):
    """Vertices that meet a condition and the edges between them."""
    kept = vertices.where(condition)
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return kept, inner.select("src", "dst")


def pagerank(
    vertices, edges, damping=0.85, epsilon=1e-6, max_iter=None, cut_every=4, fixed=False, task_arcs=4_000_000,
    task_ids=1_000_000,
):
    """``(id, rank)``, summing to 1; the mass of lone vertices is shared out.

    Goes on until the ranks move by less than ``epsilon`` in total, looked at
    every ``cut_every`` rounds; with ``max_iter`` at most so many rounds, with
    ``fixed`` exactly.

    Linked vertices are dealt to groups, and numbered in them.  The arcs from one
    group to another, some ``task_arcs``, are one block, moved once and kept where
    they are; a vertex has no more arcs in a block than a group has vertices, so
    hubs are spread.  In a round a group's shares go to the blocks that start
    there and a block's sums go back to the group where it ends, one packed row
    each.
    """
    edges = cut(edges.select("src", "dst"))
    out = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("out"))
    people = cut(vertices.groupBy("id").agg(F.count(F.lit(1)).alias("m")).join(out, "id", "left"))
    is_lone, m = F.col("out").isNull(), F.col("m")
    n, lonely, lone_pairs, linked, ends = people.agg(
        F.sum(m), F.sum(F.when(is_lone, m)), F.sum(F.when(is_lone & F.col("id").isNotNull(), m * m)), F.count("out"), F.sum("out")
    ).first()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    lonely, lone_pairs = lonely or 0, lone_pairs or 0
    lone = 1 / n  # rank of each lone vertex: they receive nothing, so all have the same
    if not linked:
        return vertices.select("id", F.lit(lone).alias("rank"))
    groups = max(2, math.ceil(math.sqrt(ends / task_arcs)), math.ceil(linked / task_ids))
    place = F.row_number().over(W.partitionBy("g").orderBy("id")) - 1
    verts = people.where(~is_lone).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    verts = cut(verts.select("id", "m", "out", "g", place.alias("l")))
    drop(people)
    blocks = _arc_blocks(verts, edges, groups, task_arcs).persist()
    try:
        state = before = cut(_packed(verts, lone))
        step, lone_before = 0, lone
        while max_iter is None or step < max_iter:
            step += 1
            base = (1 - damping) / n + damping * lone * lonely / n
            state = _round(state, blocks, groups, base, damping)
            lone = base
            if step % cut_every == 0 and step != max_iter:
                state = cut(state)
                moved = None if fixed else _moved(before, state)
                drop(before)
                if moved is not None and moved + lone_pairs * abs(lone - lone_before) < epsilon:
                    break
                before, lone_before = state, lone
        ranks = cut(_unpacked(state))
        drop(before, state)
    finally:
        blocks.unpersist()
    drop(edges)
    ranks = verts.join(ranks, ["g", "l"]).select("id", "rank")
    return vertices.select("id").join(ranks, "id", "left").select("id", F.coalesce("rank", F.lit(lone)).alias("rank"))


def _arc_blocks(verts, edges, groups, task_arcs):
    """Arcs both ways as ``(block, code)`` rows: arrays of numbers ``source << 32 | end`` inside the two groups."""
    at = lambda end: verts.select(F.col("id").alias(end), F.struct("g", "l").alias("_" + end))
    ends = edges.join(at("src"), "src").join(at("dst"), "dst").select("_src", "_dst")
    arc = lambda a, b: F.struct(
        (F.col(a)["g"] * groups + F.col(b)["g"]).alias("block"),
        F.shiftleft(F.col(a)["l"].cast("long"), 32).bitwiseOR(F.col(b)["l"].cast("long")).alias("code"),
    )
    arcs = ends.select(F.inline(F.array(arc("_src", "_dst"), arc("_dst", "_src"))))
    piece = F.pmod(F.xxhash64("code"), F.lit(max(1, task_arcs // 100_000)))
    packed = arcs.repartition(4 * groups * groups, "block").groupBy("block", piece.alias("piece")).agg(F.collect_list("code").alias("code"))
    return packed.select("block", "code").sortWithinPartitions("block")


STATE = "g int, w binary, pairs binary, rank binary"


def _packed(verts, rank):
    """One row per group: the numbers of its vertices, by place, as bytes of doubles."""

    def pack(key, table):
        table = table.sort_by("l")
        w, pairs = (table.column(c).to_numpy().astype(float).tobytes() for c in ("w", "pairs"))
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "w": [w], "pairs": [pairs], "rank": [np.full(len(table), rank).tobytes()]})

    m = F.col("m")
    rows = verts.select("g", "l", (m / F.col("out")).alias("w"), (m * m).alias("pairs"))
    return rows.groupBy("g").applyInArrow(pack, STATE)


def _unpacked(state):
    """``(g, l, rank)`` of packed ranks."""

    def run(batches):
        for batch in batches:
            for g, rank in zip(batch.column("g").to_pylist(), batch.column("rank").to_pylist()):
                rank = np.frombuffer(rank)
                for at in range(0, len(rank), 100_000):
                    part = rank[at : at + 100_000]
                    place = np.arange(at, at + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), g, np.int32)), pa.array(place), pa.array(part)], ["g", "l", "rank"])

    return state.mapInArrow(run, "g int, l int, rank double")


def _moved(before, state):
    """By how much the ranks have moved in all; an id in several rows counts once for each pair of them."""

    def run(batches):
        for batch in batches:
            for old, new, pairs in zip(*(batch.column(c).to_pylist() for c in ("old", "rank", "pairs"))):
                far = np.abs(np.frombuffer(new) - np.frombuffer(old)) @ np.frombuffer(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([far])], ["far"])

    both = state.join(before.select("g", F.col("rank").alias("old")), "g")
    return both.select("old", "rank", "pairs").mapInArrow(run, "far double").agg(F.sum("far")).first()[0]


def _round(state, blocks, groups, base, damping):
    """``state`` with the ranks of the next round.

    A group's shares go, packed, to all its blocks, and a block's sums back to
    the group where it ends; in the block from the group to itself the group's
    own numbers go along, so that the state is read once in a round.
    """

    def send(batches):
        for batch in batches:
            for g, w, pairs, rank in zip(*(batch.column(c).to_pylist() for c in ("g", "w", "pairs", "rank"))):
                share = (np.frombuffer(rank) * np.frombuffer(w)).tobytes()
                for to in range(groups):
                    own = [w, pairs] if to == g else [None, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g * groups + to], pa.int32()), *[pa.array([x], pa.binary()) for x in (share, *own)]], ["block", "share", "w", "pairs"]
                    )

    def add(key, arcs, shares):
        start, end = divmod(key[0].as_py(), groups)
        share = np.frombuffer(shares.column("share")[0].as_py())
        code = np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy() for c in arcs.column("code").chunks]])
        total = np.bincount(code & 0xFFFFFFFF, share[code >> 32]).astype(float)  # of no arcs they are integers
        return pa.table({
            "g": pa.array([end], pa.int32()), "start": pa.array([start], pa.int32()), "got": [total.tobytes()],
            "w": shares.column("w"), "pairs": shares.column("pairs"),
        })

    def rank(key, table):
        parts = table.sort_by("start").to_pylist()
        own = next((p for p in parts if p["w"] is not None), None)
        if own is None:  # no vertex was dealt to the group
            return pa.table({"g": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("w", "pairs", "rank")}})
        total = np.zeros(len(own["w"]) // 8)
        for p in parts:
            got = np.frombuffer(p["got"])
            total[: len(got)] += got
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "w": [own["w"]], "pairs": [own["pairs"]], "rank": [(base + damping * total).tobytes()]})

    sent = state.mapInArrow(send, "block int, share binary, w binary, pairs binary")
    parts = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(add, "g int, start int, got binary, w binary, pairs binary")
    return parts.groupBy("g").applyInArrow(rank, STATE)


def components(vertices, edges):
    """``(id, component)``: the smallest id of the component.

    Alternating large-star and small-star rounds: each rewires arcs towards
    smaller ids, halving distances, until nothing changes.  A star's centre
    costs an aggregate (minimum per vertex) and a join, never one group.
    """
    arcs = cut(edges.select(F.col("src").alias("low"), F.col("dst").alias("high")))
    state = None
    while True:
        last = arcs
        arcs = cut(_star(_star(arcs, large=True), large=False))
        drop(last)
        seen = arcs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return vertices.select("id").join(
        arcs.select(F.col("high").alias("id"), F.col("low").alias("component")), "id", "left"
    ).select("id", F.coalesce("component", "id").alias("component"))


def _star(arcs, large):
    """One star round on arcs ``(low, high)`` with ``low < high``."""
    if large:
        # every neighbour above the centre is tied to the centre's minimum
        around = arcs.select(
            F.inline(
                F.array(
                    F.struct(F.col("low").alias("mid"), F.col("high").alias("near")),
                    F.struct(F.col("high").alias("mid"), F.col("low").alias("near")),
                )
            )
        )
        least = around.groupBy("mid").agg(F.least(F.min("near"), F.col("mid")).alias("top"))
        tied = around.where(F.col("near") > F.col("mid")).join(least, "mid")
        return tied.select(F.col("top").alias("low"), F.col("near").alias("high")).distinct()
    # every neighbour below the centre, and the centre, is tied to the minimum
    around = arcs.select(F.col("high").alias("mid"), F.col("low").alias("near"))
    least = around.groupBy("mid").agg(F.min("near").alias("top"))
    tied = around.join(least, "mid").where(F.col("near") != F.col("top")).select(
        F.col("top").alias("low"), F.col("near").alias("high")
    )
    own = least.select(F.col("top").alias("low"), F.col("mid").alias("high"))
    return tied.unionByName(own).distinct()


def largest_component(vertices, edges):
    """Vertices and edges of the component with the most vertices."""
    labels = cut(components(vertices, edges))
    best = (
        labels.groupBy("component")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "component")
        .limit(1)
        .select("component")
    )
    ids = labels.join(best, "component", "left_semi").select("id")
    kept = vertices.join(ids, "id", "left_semi")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept, inner


def pivots(vertices, count=None, seed=7):
    """Start vertices: all, or the ``count`` with the smallest hash."""
    ids = vertices.select(F.col("id").alias("source"))
    if count is None:
        return ids
    return ids.orderBy(hash_uniform(seed, F.lit(0), "source"), "source").limit(count)


def shortest_paths(vertices, edges, sources=None, max_depth=None):
    """``(source, id, dist, sigma)``: hops and number of shortest paths.

    Breadth first from all sources at once, level by level: a join with the
    arcs, counts summed per (source, vertex), vertices seen before left out.  All levels are
    followed; with ``max_depth`` deeper ones are left out, and a column
    ``complete`` says whether there are none.
    """
    arcs = cut(both_ways(edges))
    start = pivots(vertices) if sources is None else sources
    levels = [
        cut(start.select("source", F.col("source").alias("id"), F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    ]
    depth, complete = 0, False
    while True:
        depth += 1
        reached = (
            levels[-1]
            .join(arcs, F.col("id") == F.col("src"))
            .groupBy("source", F.col("dst").alias("id"))
            .agg(F.sum("sigma").alias("sigma"))
        )
        # arcs go both ways: a neighbour is at most one level back
        for old in levels[-2:]:
            reached = reached.join(old.select("source", "id"), ["source", "id"], "left_anti")
        level = cut(reached.select("source", "id", F.lit(depth).alias("dist"), "sigma"))
        if level.isEmpty():
            complete = True
            break
        if max_depth is not None and depth > max_depth:
            break
        levels.append(level)
    paths = levels[0]
    for level in levels[1:]:
        paths = paths.unionByName(level)
    return paths if max_depth is None else paths.withColumn("complete", F.lit(complete))


def distance_histogram(paths):
    """Ordered pairs per distance, with log10 of the count."""
    return (
        paths.where("dist > 0").groupBy("dist").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10("n"))
    )


def diameter(paths):
    return paths.agg(F.max("dist").alias("diameter"))


def closeness(paths):
    """Reached vertices over the sum of their distances; NULL when alone."""
    return paths.groupBy(F.col("source").alias("id")).agg(
        F.try_divide(F.count_if(F.col("dist") > 0), F.sum("dist")).alias("closeness")
    )


def betweenness(vertices, edges, sources=None, normalized=True):
    """Vertex ``(id, betweenness)`` and edge ``(src, dst, betweenness)`` scores.

    Path counts from ``shortest_paths``, then dependencies summed back from
    the farthest level.  With ``sources`` (see ``pivots``) the sums are scaled
    up by the share of vertices used.
    """
    n, used = vertices.count(), (sources or vertices).count()
    paths = cut(shortest_paths(vertices, edges, sources))
    depth = paths.agg(F.max("dist")).first()[0] or 0
    arcs = cut(both_ways(edges))
    below = paths.where(F.col("dist") == depth).withColumn("delta", F.lit(0.0))
    vertex_parts, edge_parts = [below], []
    for level in range(depth, 0, -1):
        # the far end of each step hands its share back to the near end
        steps = (
            below.select("source", F.col("id").alias("far"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            .join(arcs, F.col("far") == F.col("src"))
            .select("source", "far", F.col("dst").alias("id"), "share")
        )
        near = paths.where(F.col("dist") == level - 1)
        flow = cut(
            near.join(steps, ["source", "id"]).select(
                "source", "id", "far", (F.col("sigma") * F.col("share")).alias("flow")
            )
        )
        edge_parts.append(flow.select("id", "far", "flow"))
        back = flow.groupBy("source", "id").agg(F.sum("flow").alias("delta"))
        below = cut(
            near.join(back, ["source", "id"], "left").select(
                "source", "id", "dist", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")
            )
        )
        vertex_parts.append(below)
    both = 0.5 * n / used if used else 0.0
    vertex_scale = both * (2.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0)
    edge_scale = both * (2.0 / (n * (n - 1)) if normalized and n > 1 else 1.0)
    scored = _union(vertex_parts).where("dist > 0").groupBy("id").agg(F.sum("delta").alias("s"))
    by_vertex = vertices.select("id").join(scored, "id", "left").select(
        "id", (F.coalesce("s", F.lit(0.0)) * vertex_scale).alias("betweenness")
    )
    if not edge_parts:
        return by_vertex, edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    flows = (
        _union(edge_parts)
        .groupBy(F.least("id", "far").alias("src"), F.greatest("id", "far").alias("dst"))
        .agg(F.sum("flow").alias("s"))
    )
    by_edge = edges.select("src", "dst").join(flows, ["src", "dst"], "left").select(
        "src", "dst", (F.coalesce("s", F.lit(0.0)) * edge_scale).alias("betweenness")
    )
    return by_vertex, by_edge


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def influencers(vertices, edges, drop_from=0.002, keep_from=0.00055, rerank="reduced", first=None, **rank_params):
    """Ranked vertices without the hubs.

    Vertices ranked ``drop_from`` or higher leave; of the rest the largest
    component is ranked again and ranks under ``keep_from`` become 0.
    ``rerank="full"`` takes component and second ranks from the full graph.
    ``first``: ranks ``(id, rank)`` of the full graph, if the caller has them.
    """
    if first is None:
        edges = cut(edges)
        first = cut(pagerank(vertices, edges, **rank_params))
    if rerank == "full":
        v, e = largest_component(vertices, edges)
        again = first.join(v.select("id"), "id", "left_semi")
    else:
        v, e = subgraph(first, edges, F.col("rank") < drop_from)
        v, e = largest_component(v.select("id"), e)
        v, e = cut(v), cut(e)
        again = pagerank(v, e, **rank_params)
    return again.select("id", F.when(F.col("rank") < keep_from, 0.0).otherwise(F.col("rank")).alias("rank"))
