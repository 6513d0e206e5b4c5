import random
import re
from collections import Counter

from cases import ODD, documents, edited, prose

from tablewright.llm import decontaminate


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best_window(text, item, width):
    w, own = tokens(text), tokens(item)
    width = min(width, len(own))
    if not width or len(w) < width:
        return 0.0
    grams = lambda x: [tuple(x[i : i + width]) for i in range(len(x) - width + 1)]
    a, b = grams(w), Counter(grams(own))
    n, best = sum(b.values()), 0.0
    for s in range(max(1, len(a) - n + 1)):
        part = Counter(a[s : s + n])
        common = sum((part & b).values())
        best = max(best, common / (sum(part.values()) + n - common))
    return best


def tables(spark):
    items = [prose(500 + k, [15, 20, 35, 57][k % 4], 10**6) for k in range(30)] + ["a b c", "one", None, "", "rep rep rep rep rep rep rep", "a b c"]
    r, texts = random.Random(3), list(ODD)
    for k in range(120):
        item = r.choice(items[:30])
        words = item.split(" ")
        part = r.choice([item, edited(item, k, 1), " ".join(words[r.randrange(4) :]), " ".join(words[: len(words) - r.randrange(6)]), item.upper(), ""])
        texts.append("%s %s\n%s" % (prose(k, r.choice([0, 30, 300])), part, prose(k + 999, r.choice([0, 30, 300]))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return texts, items, bench


def test_passages_equal_brute_force(spark, monkeypatch):
    texts, items, bench = tables(spark)
    want = {(d, i): s for d, t in enumerate(texts) for i, x in enumerate(items) if (s := best_window(t, x, 5)) >= 0.8}
    docs = documents(spark, texts).repartition(5)
    for group in (1 << 20, 300):  # one group of items, and several
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        rows = decontaminate.find_passages(docs, bench).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == {k: round(s, 9) for k, s in want.items()}
        assert len(rows) == len(want)
        for r in rows:
            part = texts[r.doc_id][r.start : r.end]
            assert abs(best_window(part, items[r.item_id], 5) - r.similarity) < 1e-9
            assert r.differing_bits <= decontaminate.RADIUS


def test_stage_drops_those_documents_only(spark):
    texts, items, bench = tables(spark)
    docs = documents(spark, texts, [None if k == 3 else k // 2 for k in range(len(texts))])
    kept = decontaminate.without_passages(docs, bench)
    assert kept.columns == docs.columns
    want = [t for t in texts if not any(best_window(t, x, 5) >= 0.8 for x in items)]
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t in want)


def test_empty_tables(spark):
    texts, _, bench = tables(spark)
    docs = documents(spark, texts)
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_passages(docs.limit(0), bench).count() == 0
    assert decontaminate.without_passages(docs, bench.limit(0)).count() == len(texts)
