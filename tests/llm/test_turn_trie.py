import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, key int, seq string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)


def built(df, shards=None):
    seqs = turn_trie.sequences(df)
    heads = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    nodes = turn_trie.trie(turn_trie.spliced(seqs, F.col("id") - F.col("id") % 20, heads, 3), shards)
    return sorted(tuple(r) for r in nodes.collect())


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), sha, role, text))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)

    def below(s):
        todo, found = [s], []
        while todo:
            at = todo.pop()
            found.append(at)
            todo += kids.get(at, [])
        return found

    out = []
    for s, who in members.items():
        under = below(s)
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(s))))
        out.append((
            min(who), len(s), min(members[s[:-1]]) if s else None, len(who), len(kids.get(s, [])),
            sum(1 for x in under if x not in kids), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: tuple((v is not None, v) if i == 2 else v for i, v in enumerate(r)))


def same(got, want):
    key = lambda r: tuple((v is not None, v or 0) if i == 2 else v for i, v in enumerate(r))
    assert sorted(got, key=key) == sorted(want, key=key)


def many(n):
    """Conversations that share beginnings, of 0 to 9 turns, one text in three starts most of them."""
    rows = []
    for c in range(n):
        for t in range(c * 7 % 10):
            word = "hello there" if t == 0 and c % 3 else "a b c d"[: 1 + (c * 31 + t * t) % (2 + t)]
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", word))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_equals_brute_force_on_any_number_of_shards(spark, shards):
    rows = many(120)
    same(built(table(spark, rows), shards), expected(rows))


def test_copies_of_one_conversation_and_extensions(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1200, 20) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in range(2000, 2100, 20) for t in range(1 + c // 20 % 5)]
    same(built(table(spark, rows), 7), expected(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "x"), (21, 5, "", ""),
        (21, None, "user", "\t \n"), (-7, 1, "user", "minus"), (-20, 0, "user", "base"), (None, 0, "user", "no id"),
        (20, 0, "user", "word " * 5000), (40, 0, "u", "ser"), (41, 0, "us", "er"), (60, 1, "user", "🤦 漢字"),
    ]
    same(built(table(spark, rows), 5), expected(rows))


def test_turnless_conversations_and_empty_table(spark):
    # 3 has a base that does not exist and fewer turns than it gives away
    lone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 2][:5]
    rows = [(c, 0, "user", "only") for c in lone]
    got = built(table(spark, rows))
    same(got, expected(rows))
    assert len(got) == 1 and got[0][1] == 0 and got[0][3] == 5 and got[0][5] == 1
    assert built(table(spark, [])) == []


def test_long_conversation(spark):
    rows = [(0, t, "user", f"t{t}") for t in range(3000)] + [(20, t, "user", f"t{t}") for t in range(2000)]
    rows += [(40, t, "user", f"t{t}" if t < 2500 else "other") for t in range(2600)]
    got = built(table(spark, rows), 3)
    by_depth = {r[1]: r for r in got if r[0] == 0}
    assert len(got) == 3000 + 1 + 100 and by_depth[0][3] == 3 and by_depth[2500][3] == 2 and by_depth[2500][4] == 2
    assert by_depth[0][5] == 2 and by_depth[0][6] == 2000 * 2 + 500


def test_frequent_turns_take_the_broadcast_way(spark):
    rows = many(60) + [(c, t, "user", "same") for c in range(1000, 3000, 20) for t in range(2)]
    rows += [(c, 2, "user", f"own {c}") for c in range(1000, 3000, 20)] + [(5000 + c, 0, "user", f"x{c}") for c in range(1500)]
    same(built(table(spark, rows), 6), expected(rows))


def test_medians_visit_all_once_balanced():
    order = list(turn_trie.medians(1000))
    assert sorted(order) == list(range(1000)) and order[0] == 500
    tree = turn_trie.Tree()
    for i in order:
        tree.insert([i], [1], 1, i, "")
    deepest, todo = 0, [(tree.below[0], 1)]
    while todo:
        u, d = todo.pop()
        if u >= 0:
            deepest = max(deepest, d)
            todo += [(tree.less[u], d + 1), (tree.more[u], d + 1)]
    assert deepest == 10
