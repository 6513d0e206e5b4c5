import zlib

from cases import ODD, documents

from tablewright.llm import sharding


def check(spark, texts, ids, shards):
    rows = [tuple(r) for r in sharding.byte_shards(documents(spark, texts, ids), shards).collect()]
    own = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in zip(ids, texts))
    got = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[2], r[1]))
    assert [((-1 if r[0] is None else r[0]), r[2], r[1]) for r in got] == own
    assert all(r[3] == "bytes" and r[6] is None for r in rows)
    # brute force: the middle of each row on the line of bytes
    total, at, place = sum(o[2] for o in own), 0, {}
    want = []
    for o in own:
        shard = min((2 * at + o[2]) * shards // (2 * total), shards - 1)
        want.append((*o, shard, place.get(shard, 0)))
        place[shard] = place.get(shard, 0) + 1
        at += o[2]
    assert sorted((-1 if r[0] is None else r[0], r[2], r[1], r[4], r[5]) for r in rows) == sorted(want)


def test_shards_equal_brute_force(spark):
    check(spark, ODD * 4, list(range(4 * len(ODD))), 5)
    check(spark, ["x" * (k % 50) for k in range(1000)], list(range(1000)), 40)


def test_ties_nulls_and_one_huge_text(spark):
    check(spark, ["a", "a", "b", None, "z" * 100000, ""], [1, 1, 1, None, 2, None], 4)


def test_empty_table(spark):
    assert sharding.byte_shards(documents(spark, [])).count() == 0
