"""The stages on the smallest tables, each against what a plain program keeps; the queries against their SQL."""

import base64
import hashlib
import os

import duckdb
import public_tokenizers
import pytest
from cases import ODD, documents
from test_decontaminate import best_window
from test_ngram_join import expected as groups

import corpus_pipeline
from tablewright.llm import queries
from workload.check import compare

FOLDER = os.environ.get("SMALL_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        kept[name] = docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rows = {name: {r.doc_id: r for r in d.collect()} for name, d in kept.items()}
    bare = lambda t: "".join((t or "").split())
    one = rows["toxic_texts"]
    best = {}
    for i, r in one.items():
        best.setdefault(bare(r.text), []).append((-len(r.text or ""), i))
    assert set(rows["exact_copies"]) == {min(g)[1] for g in best.values()}
    two = [(i, r.text) for i, r in rows["exact_copies"].items()]
    assert set(rows["near_copies"]) == {i for i, _, c in groups(two, 5, 80) if i == c}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i, r in rows["near_copies"].items() if not any(best_window(r.text, x, 5) >= 0.8 for x in items)}
    assert set(rows["benchmark_passages"]) == clean == set(rows["token_ids"])
    assert all(r.same for r in rows["token_ids"].values())


def test_last_stage_writes_the_ids(spark):
    texts = [*ODD, "more than one text, with numbers 12345"]
    rows = corpus_pipeline.token_ids(spark, documents(spark, texts), FOLDER).collect()
    assert len(rows) == len(texts)
    ranks = {}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    for r in rows:
        back = b"".join(ranks[i] for i in r.ids)
        assert back == (texts[r.doc_id] or "").encode() and r.n_tokens == len(r.ids) and r.same
        assert hashlib.sha256(back).hexdigest() == r.decoded_sha256


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    res = con.execute(queries.ORACLES[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in res.description], res.fetchall()) == ""


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() == 0
