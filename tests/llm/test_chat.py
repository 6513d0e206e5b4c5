import random

import duckdb
from cases import ODD
from pyspark.sql import functions as F

from tablewright.llm import chat
from tablewright.llm.queries import ORACLES, QUERIES
from workload.check import compare


def test_escape_reverses_and_hides_control_strings(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["<", "|", "\\", "[", "/", "INST]", "s>", "<SYS>>", "</SYS>>", "a", "\n", "é"]) for _ in range(r.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, *[t for t in ODD if t is not None]]], "t string")
    df = df.select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r"))
    df = df.select("*", chat.unescape(F.col("e")).alias("back"), chat.unescape(F.col("r")).alias("back_r"))
    for row in df.collect():
        assert row.back == row.t and row.back_r == row.t
        assert not any(c in row.e for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_threads_read_back(spark):
    rows = []
    for k, text in enumerate(ODD):
        rows += [(k, 0, "system\n", "s", 1), (k, 1, "user", text, 1), (k, 2, "assistant", text, 1), (k, 3, None, "u", 1), (k, 3, "assistant", "again", 1)]
    rows += [(99, t, "assistant" if t % 2 else "user", "t%d" % t, 1) for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int").repartition(7)
    done = chat.format_trees(chat.threads(df), "conv_id", "node", "parent", "role", "text", "score", best=1)
    got = {r.tree: r for r in chat.read_back(done).collect()}
    assert len(got) == len(ODD) + 1
    for k in got:
        own = sorted((t, r is not None, r or "", x is not None, x or "") for c, t, r, x, _ in rows if c == k)
        assert got[k].turns == ["%s\n%s\n" % (r, x) for _, _, r, _, x in own]
        assert got[k].masked == "".join(x for _, _, r, _, x in own if r == "assistant")
        assert got[k].formatted.count("<|im_start|>") == len(own)


def test_reply_tree_paths(spark):
    r = random.Random(5)
    rows, parents = [], {}
    for tree in range(6):
        for node in range(40):
            parent = None if node == 0 else r.randrange(max(0, node - 3), node)
            score = None if node % 7 == 0 else r.random()
            parents[tree, node] = parent, score
            rows.append((tree, node, parent, "user", "n%d" % node, score))
    rows += [(7, 1, 2, "user", "x", 1.0), (7, 2, 1, "user", "y", 1.0), (8, 5, 4, "user", "orphan", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = chat.reply_paths(df, "tree", "node", "parent", "score")
    got = {}
    for p in paths.collect():
        got.setdefault((p.tree, p.leaf), {})[p.depth] = p.node
    want = {(8, 5): [5]}
    for tree in range(6):
        inner = {parents[tree, n][0] for n in range(40)}
        for leaf in set(range(40)) - inner:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parents[tree, at][0]
            want[tree, leaf] = path[::-1]
    assert {k: [v[d] for d in range(len(v))] for k, v in got.items()} == want
    best = chat.format_trees(df, "tree", "node", "parent", "role", "text", "score", best=1).collect()
    assert len(best) == 7
    for b in best:
        if b.tree < 6:
            mean = lambda leaf: sum(parents[b.tree, n][1] or 0 for n in want[b.tree, leaf]) / len(want[b.tree, leaf])  # noqa: B023,E731
            leaves = [leaf for t, leaf in want if t == b.tree]
            assert b.leaf == min(leaves, key=lambda leaf: (-round(mean(leaf), 12), leaf))  # noqa: B023
            assert b.formatted == "".join("<|im_start|>user\nn%d<|im_end|>\n" % n for n in want[b.tree, b.leaf])
    every = chat.format_trees(df, "tree", "node", "parent", "role", "text", "score", best=None)
    assert every.count() == len(want)


def test_conversation_without_an_id(spark, tmp_path):
    """Rows whose conv_id is NULL are one conversation, as in the SQL."""
    rows = [(c, t, "assistant" if t % 2 else "user", "c%s t%d" % (c, t)) for c in (None, 1, 2) for t in range(5)]
    rows += [(None, 5, None, "no role"), (None, 6, "assistant", None), (None, 6, "assistant", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    done = QUERIES["op3_chat_formatting"](spark, str(tmp_path))
    got = [tuple(r) for r in done.collect()]
    assert sorted(((r[0], r[1]) for r in got), key=str) == [(-1, 2), (1, 5), (2, 5), (None, 8)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    res = con.execute(ORACLES["op3_chat_formatting"])
    assert compare(done.columns, got, [c[0] for c in res.description], res.fetchall()) == ""


def test_paths_of_a_tree_without_an_id(spark):
    rows = [(c, n, p, "user", "n%d" % n, 1.0) for c in (None, 1) for n, p in ((0, None), (1, 0), (2, 1), (3, 1))]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = chat.reply_paths(df, "tree", "node", "parent", "score")
    assert paths.count() == 12 and paths.where("tree IS NULL").count() == 6
    assert chat.best_paths(paths).where("tree IS NULL").count() == 6
    every = chat.format_trees(df, "tree", "node", "parent", "role", "text", "score", best=None)
    assert sorted(((r.tree, r.leaf) for r in every.collect()), key=str) == [(1, 2), (1, 3), (None, 2), (None, 3)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_trees(chat.threads(df), "conv_id", "node", "parent", "role", "text", "score").count() == 0


def test_long_roles_and_texts_are_read_back(spark):
    role = "r\\\n<|x" * 100_000
    rows = [(1, 0, "x" * 5000, "a", 1), (2, 0, role, "b\\" * 300_000, 1), (2, 1, "assistant", "c", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    done = chat.format_trees(chat.threads(df), "conv_id", "node", "parent", "role", "text", "score", best=1)
    got = {r.tree: r for r in chat.read_back(done).collect()}
    assert got[1].turns == ["x" * 5000 + "\na\n"]
    assert got[2].turns == [role + "\n" + "b\\" * 300_000 + "\n", "assistant\nc\n"] and got[2].masked == "c"
