import random
import re

import xxhash
from cases import ODD, documents, edited, prose

from tablewright.llm import simhash


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def check(spark, texts, **options):
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    got = {r[0]: (r[1], r[2]) for r in simhash.near_groups(documents(spark, texts, ids), **options).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = dict(zip(ids, zip([f"{p:016x}" for p in prints], components(prints, ids))))
    assert got == want
    return want


def test_equals_brute_force(spark):
    texts = list(ODD) * 2
    for k in range(12):
        base = prose(k, 150 + 40 * k)
        texts += [base] + [edited(base, 100 * k + i, 1 + i % 4) for i in range(8)]
    want = check(spark, texts)
    assert len({c for _, c in want.values()}) < len(texts) - 30


def test_crowds_are_linked_exactly(spark):
    base = prose(1, 600)
    texts = [edited(base, i, 1 + i % 3) for i in range(150)] + [prose(50 + i, 80) for i in range(40)]
    assert check(spark, texts, crowd=2) == check(spark, texts, crowd=10_000)


def test_links_of_all_distances(spark):
    """All pairs of a table of fingerprints, plain and crowded, against brute force."""
    r = random.Random(5)
    prints = {0, 1, (1 << 63), (1 << 63) | 1, (1 << 64) - 1}
    for _ in range(60):
        p = r.getrandbits(64)
        for d in (0, 1, 2, 2, 3):
            q = p
            for k in r.sample(range(64), d):
                q ^= 1 << k
            prints.add(q)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    mask = (1 << 64) - 1
    near = {(a, b) for a in map(signed, prints) for b in map(signed, prints) if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert {tuple(x) for x in simhash.near_pairs(df).collect()} == near
    for crowd in (0, 1, 3):
        found = {tuple(x) for x in simhash.near_pairs(df, crowd).collect()}
        assert found <= near
        up = {p: p for pair in near for p in pair}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in found:
            up[root(a)] = root(b)
        assert all(root(a) == root(b) for a, b in near)


def test_repeated_and_missing_ids_and_empty_table(spark):
    df = documents(spark, ["a b c d", "a b c d", None, "z y x w v", "a b c d"], [7, 7, None, 3, None])
    got = sorted(f"{r[0]} {r[2]}" for r in simhash.near_groups(df).collect())
    assert got == ["3 3", "7 7", "7 7", "None 7", "None None"]
    assert simhash.near_groups(documents(spark, [])).collect() == []


def test_hot_copies_take_the_broadcast_way(spark):
    texts = ["one hot text of some words"] * 600 + [prose(i, 30) for i in range(1500)]
    got = {r[0]: r[2] for r in simhash.near_groups(documents(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(600)) and len(got) == 2100


def test_long_text_in_pieces(monkeypatch):
    text = prose(4, 5000) + "\t" + "x" * 300 + " " + prose(5, 10)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint(text) & ((1 << 64) - 1) == plain_fingerprint(text)
    assert simhash.fingerprint("a" * 500 + " " + "b" * 500) & ((1 << 64) - 1) == plain_fingerprint("a" * 500 + " " + "b" * 500)
