import random
import re
import zlib
from collections import Counter

import pytest
from cases import documents
from pyspark.sql import functions as F

from tablewright.llm import queries, spelling


def edit_one(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(counts, factor=10):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if edit_one(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= factor * n else None, len(near))
    rows = {}
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, counts[w], n_near, counts[form] if form else None)
    return rows


def vocab(spark, counts):
    return spark.createDataFrame([(w, n, "x", 0) for w, n in counts.items()], "word string, n long, key string, g int")


def words(seed, n, letters="ab", longest=9):
    r = random.Random(seed)
    found = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): int(10 ** (4 * r.random())) + 1 for _ in range(n)}
    return found


@pytest.mark.parametrize("letters, crowd", [("ab", 8192), ("ab", 20), ("abcé漢🤦", 8192), ("abcé漢🤦", 5), ("aab", 1)])
def test_equals_brute_force(spark, letters, crowd):
    counts = words(len(letters) + crowd, 500, letters)
    got = {r[0]: tuple(r)[1:] for r in spelling.variant_forms(vocab(spark, counts), crowd=crowd).collect()}
    assert got == forms(counts)


def test_blocks_and_tiles(spark, monkeypatch):
    counts = words(9, 900, "abc", 6)
    want = forms(counts)
    # the tasks' own module is not patched, so the index is called here
    listed = sorted(counts, key=lambda w: (-counts[w], w))
    monkeypatch.setattr(spelling, "TILE", 4)
    seen = Counter()
    for g in range(1, 8):
        for s, t in ((0, (g + 1) // 2), ((g + 1) // 2, g + 1)):
            cut_of = lambda w: (w[:s], w[len(w) - max(g - t, 0) :] if g > t else "")  # noqa: E731,B023
            inside = sorted([w for w in listed if len(w) in (g, g + 1)], key=cut_of)
            if not inside:
                continue
            keys = [cut_of(w) for w in inside]
            numbers = {k: i for i, k in enumerate(sorted(set(keys)))}
            import numpy as np

            for asked, count, first in spelling.near_in_block(inside, g, s, t, np.array([numbers[k] for k in keys])):
                for i, c, f in zip(asked, count, first):
                    seen[inside[i]] += int(c)
                    assert edit_one(inside[i], inside[f])
    assert seen == Counter({w: r[3] for w, r in want.items() if r[3]})


def test_chains_of_forms(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "aabbbbb": 200000, "zzzzzzz": 5}
    got = {r[0]: tuple(r)[1:] for r in spelling.variant_forms(vocab(spark, counts)).collect()}
    assert got == forms(counts) and got["aaaaaaa"][1] == "aabbbbb"
    with pytest.raises(ValueError):
        spelling.variant_forms(vocab(spark, counts), factor=1)


def test_empty_vocabulary(spark):
    assert spelling.variant_forms(vocab(spark, {})).collect() == []
    assert queries.QUERIES  # registered


def test_query_equals_plain_program(spark, tmp_path):
    r = random.Random(2)
    pool = ["correct", "receive", "beginning", "GROßARTIG", "élémentaire", "abcdefghijkl", "naïveté", "short", "a×÷bÀÿcdef"]
    texts = [None, "", "x" * 4000, "Receive\nRECEIVE,receive;recéive"]
    for _ in range(400):
        texts.append(" ".join(r.choice(pool) if r.random() < 0.9 else r.choice(pool)[:-1] for _ in range(30)))
    documents(spark, texts).drop("id").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = {x["word"]: tuple(x)[1:] for x in queries.QUERIES["op13_spelling"](spark, str(tmp_path)).collect()}
    assert got == forms(counts)
    assert sum(1 for v in got.values() if v[0]) > 5


def test_word_runs_are_maximal(spark):
    df = documents(spark, ["abcdefg-hijklmno p abcdef", None, "ABCDEFGÉĀabcdefgh"])
    got = [x[1] for x in spelling.word_runs(df).orderBy(F.desc("word")).collect()]
    assert sorted(got) == sorted(["abcdefg", "hijklmno", "abcdefgÉ", "abcdefgh"])
