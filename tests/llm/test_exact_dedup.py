import hashlib
import re

from cases import ODD, documents

from tablewright.llm import exact_dedup


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        bare = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[bare])[3]
        out.append((i, keep, len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_brute_force(spark):
    texts = ODD * 3 + ["hot copy %s" % (" " * (k % 7)) for k in range(200)]
    docs = documents(spark, texts).repartition(13)
    got = exact_dedup.exact_groups(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(list(enumerate(texts)))


def test_any_fan_and_number_of_leaves(spark):
    texts = ["t%d" % (k % 30) for k in range(300)]
    docs = documents(spark, texts).repartition(29)
    rows = exact_dedup.digests(docs)
    for fan, parts in ((2, 1), (2, 32), (8, 100)):
        merged = exact_dedup.merge_runs(rows, parts, fan).collect()
        assert len(merged) == 30 and {(r.best.id, r["size"]) for r in merged} == {
            (min(k for k in range(300) if "t%d" % (k % 30) == t), 10) for t in set(texts) if len(t) == 3
        } | {(k, 10) for k in range(10)}


def test_stage_keeps_one_row_of_each(spark):
    docs = documents(spark, ["a b", "ab", "ab", "c", None, "", "c"], [1, 2, 2, 3, None, 4, 3])
    got = exact_dedup.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b"), (3, "c"), (4, "")]
    docs = documents(spark, ["a b", "ab", "c d", "x"])
    assert sorted(r.doc_id for r in exact_dedup.without_copies(docs).collect()) == [0, 2, 3]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.without_copies(docs).count() == 0
