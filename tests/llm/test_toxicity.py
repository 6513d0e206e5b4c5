import random
import zlib

import numpy as np
import pytest
from cases import ODD, documents, prose

from tablewright.llm import toxicity

INSULTS = ["idiot", "moron", "scumbag", "worthless"]


def plain_kernel(s, t):
    """Normalised kernel by counting subsequences one by one."""

    def vector(u):
        out = {}
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, min(len(u), i + toxicity.SPAN)):
                    key = u[i] + u[j] + u[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = vector(s), vector(t)
    dot = sum(a[k] * b.get(k, 0) for k in a)
    norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return dot / norm**0.5 if norm else 0.0


def test_kernel_equals_plain_counting():
    units = ["idiot", "idiiot", "ixdiot", "id", "", "banana", "aaaaaa", "größer", "stupid", "a" * 24]
    got = toxicity.kernel(units, units)
    want = np.array([[plain_kernel(s, t) for t in units] for s in units])
    assert np.abs(got - want).max() < 1e-3


@pytest.fixture(scope="module")
def tables(spark):
    r, texts, labels = random.Random(5), [], []
    for k in range(900):
        words = prose(k, r.choice([5, 40, 150])).split(" ")
        toxic = k % 6 == 0
        if toxic:
            for _ in range(r.choice([1, 3])):
                words[r.randrange(len(words))] = r.choice(INSULTS)
        texts.append(" ".join(words))
        labels.append((k, int(toxic)))
    labels += [(5, None), (None, 1), (7, 0)]
    docs = documents(spark, texts).repartition(5)
    return texts, docs, spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(tables[1], tables[2])


def test_held_out_accuracy(tables, model):
    rows = toxicity.score_texts(tables[1], model).collect()
    assert len(rows) == 900
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in out) >= 0.98 * len(out)


def test_gaps_and_inserted_characters(spark, model):
    bad = ["you id-iot", "such a mo_ron here", "w.o.r.t.h.l.e.s.s", "an i d i o t said", "IDIOT", "worthlless", "the scuumbag"]
    good = ["you there", "w12 w30", None, "", " \n", "a b c"]
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(documents(spark, bad + good), model).collect()}
    assert [got[k] for k in range(len(bad))] == [1] * len(bad)
    assert [got[k] for k in range(len(bad), len(got))] == [0] * len(good)


def test_odd_texts_and_repeated_rows(spark, model):
    docs = documents(spark, ODD * 2, [None if k == 2 else k // 2 for k in range(2 * len(ODD))])
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == 2 * len(ODD) and all(r.score is not None for r in got)


def test_labels_of_the_held_out_fold_are_not_used(spark, tables, model):
    flipped = tables[2].selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(doc_id AS string)), 5) = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    other = toxicity.train(tables[1], flipped)
    assert np.array_equal(other.cells, model.cells) and other.offset == model.offset


def test_stage_keeps_clean_rows(spark, tables, model):
    kept = toxicity.without_toxic(tables[1], model)
    assert kept.columns == tables[1].columns
    gone = {r.doc_id for r in toxicity.score_texts(tables[1], model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == set(range(900)) - gone and gone


def test_empty_tables(spark, tables):
    model = toxicity.train(tables[1], tables[2].limit(0))
    got = toxicity.score_texts(tables[1], model).collect()
    assert len({r.score for r in got}) == 1 and got[0].predicted == 0
    assert toxicity.score_texts(tables[1].limit(0), model).count() == 0


def test_svm_copies_one_block_of_rows_at_a_time():
    import tracemalloc

    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200_000, 32)).astype(np.float32)
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    rows = rnd.permutation(len(x))
    tracemalloc.start()
    w, b = toxicity._svm(x, rows, y[rows], np.ones(len(rows)), block=2_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 4
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.99
