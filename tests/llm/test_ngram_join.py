import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, documents, edited, prose

from tablewright.llm import ngram_join
from tablewright.llm.words import chunks, shingles, words


def gram_set(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def expected(rows, width, percent):
    sets = [gram_set(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus():
    texts = list(ODD) * 2
    for k in range(12):
        size = [5, 12, 30, 60, 130, 400][k % 6]
        one = prose(k, size)
        texts += [one, one, edited(one, k, 1), edited(one, k + 1, max(1, size // 60)), edited(one, k + 2, max(1, size // 30)), one + " tail"]
        texts.append(" ".join(one.split(" ")[: int(size * 0.93)]))
    return texts


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 60)])
def test_components_equal_brute_force(spark, width, percent):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(6)
    got = ngram_join.similar_groups(docs, width, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, width, percent)


@pytest.mark.parametrize("bits", [1, 6])
def test_a_large_group_with_several_components(spark, monkeypatch, bits):
    """Documents that share pieces without being similar: all pairs have to be looked at."""
    monkeypatch.setattr(ngram_join, "STEP_BITS", bits)
    base = prose(9, 60, 10**6).split(" ")
    texts = []
    for k in range(60):  # each changes one of few places, some of them two or three
        r, own = random.Random(k), list(base)
        for _ in range(1 + k % 3):
            own[r.randrange(60)] = "v%d" % k
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = ngram_join.similar_groups(documents(spark, texts), 3, 90)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 3, 90)


def test_repeated_and_missing_ids(spark):
    one = prose(1, 50)
    rows = [(4, one), (4, prose(2, 50)), (None, one), (3, one + " x"), (4, one), (None, prose(3, 40)), (None, None)]
    got = ngram_join.similar_groups(documents(spark, [t for _, t in rows], [i for i, _ in rows]), 3, 90)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 3, 90)


def test_every_similar_pair_shares_a_piece():
    """The guarantee of the pieces, without Spark."""
    r = random.Random(6)
    for percent in (60, 80, 90, 97):
        texts = []
        for k in range(150):
            one = prose(1000 + k, r.choice([1, 3, 4, 7, 11, 20, 50, 200, 700]), 10**6)
            n = len(one.split(" "))
            texts += [one, edited(one, k, r.randrange(1 + n // 20)), " ".join(one.split(" ")[: r.randrange(n * 3 // 4, n + 1)])]
        bands, keys, sets = ngram_join.Bands(percent), {}, [gram_set(t, 2) for t in texts]
        for first, data, at in chunks(pa.array(texts)):
            row, value, count = ngram_join.text_sets(data, at, 2)
            assert count.tolist() == [len(s) for s in sets]
            bands.cover(int(count.max()))
            for scheme in (bands.home, bands.zone):
                for i, key in zip(*ngram_join._pieces_of(row, value, count, scheme, bands, 1)):
                    keys.setdefault(first + i, set()).add(int(key))
        for k in range(0, len(texts), 3):
            for a, b in ((k, k + 1), (k, k + 2), (k + 1, k + 2)):
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]):
                    assert keys[a] & keys[b], (percent, len(sets[a]), len(sets[b]))


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_bands_do_not_depend_on_the_order_of_sizes(percent):
    """A task covers the largest set of each chunk in turn; all sizes up to it need their bands."""
    whole = ngram_join.Bands(percent)
    whole.cover(3000)
    for sizes in ([2000, 3000], [1, 7, 90, 2000, 2400, 2700, 3000], range(1, 3001, 37)):
        bands = ngram_join.Bands(percent)
        for size in sizes:
            bands.cover(size)
            assert (bands.home[1 : size + 1] >= 0).all()
        bands.cover(3000)
        assert np.array_equal(bands.home[:3001], whole.home[:3001]) and np.array_equal(bands.zone[:3001], whole.zone[:3001])
        assert bands.schemes == whole.schemes


def test_components_with_growing_sizes_in_small_chunks(spark, monkeypatch):
    """One task whose chunks bring larger and larger sets."""
    monkeypatch.setattr(ngram_join, "chunks", lambda texts: chunks(texts, 2000))
    texts = []
    for k, size in enumerate([2000, 2300, 2450, 2600, 2700, 3000, 3400, 3590, 5000]):
        one = prose(50 + k, size, 10**6)
        texts += [one, edited(one, k, size // 60)]
    rows = list(enumerate(texts))
    got = ngram_join.similar_groups(documents(spark, texts).coalesce(1), 3, 90)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 3, 90)


def test_words_and_shingles_equal_plain_python():
    texts = [*ODD, "A\x0bB\x0cc\x85d\xa0e", "x", None]
    for size in (7, 1 << 20):
        for width in (1, 2, 5):
            got = [[] for _ in texts]
            codes = {}
            for first, data, at in chunks(pa.array(texts), size):
                row, start, end, code = words(data, at)
                said = [bytes(data[s:e]).decode() for s, e in zip(start, end)]
                for i, w in zip(row, said):
                    got[first + i].append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
                r, f, value = shingles(row, code, width, len(at) - 1)
                for i, v in zip(r, value):
                    codes.setdefault(first + int(i), []).append(int(v))
            for k, t in enumerate(texts):
                assert got[k] == re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
                assert len(set(codes.get(k, []))) == len(gram_set(t, width))
    assert np.array_equal(words(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0], [])


def test_stage_keeps_one_of_each_group(spark):
    one = prose(1, 80)
    docs = documents(spark, [edited(one, 1, 1), one, prose(2, 80), None, "", one], [7, 5, 6, 1, 2, 9])
    got = ngram_join.without_near_copies(docs, 3, 80)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 5, 6]


def test_empty_table(spark):
    assert ngram_join.similar_groups(documents(spark, [])).count() == 0
    assert ngram_join.without_near_copies(documents(spark, ["", None])).count() == 2


def test_wide_sketches_bound_the_difference_and_fold():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1200, 3000, 9000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        for changed in (0, 10, n // 9, n // 2, n):
            other = np.concatenate([base[changed:], r.integers(0, 2**63, changed + n // 5, dtype=np.uint64)])
            x, y = (ngram_join._wide_sketch(v, ngram_join._wide_words(len(v), 80)) for v in (base, other))
            assert len(x) * 64 >= 4 * 2 * n * 20 // 180
            words = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(w.reshape(-1, words), axis=0) for w in (x, y))
            assert int(np.bitwise_count(x ^ y).sum()) <= 2 * changed + n // 5
            assert (ngram_join._wide_sketch(base, words) == x).all()
    assert ngram_join._wide_words(1000, 80) == 0


def test_texts_are_not_shuffled_to_drop_near_copies(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    docs = documents(spark, ["a b c d e f g h", "a b c d e f g h", "one two three four five six"])
    kept = ngram_join.without_near_copies(docs, 3, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "doc_id" in line]
