"""Spelling variants: words one edit apart, found with a bit-sliced position index.

The index of a block of words has a bitset over them for each position and
letter.  A word is matched against all words of the block at once: going over
its letters, the set Z of words without an error so far is intersected with the
bitset of the letter at its position; at the same time sets of words with one
error are kept, at the same position (a replaced letter), shifted by one to the
right (an inserted one) and by one to the left (a deleted one).

Words are dealt to groups in which only a stretch of places is free for the
edit: words of length g or g + 1 that agree in the letters before place s and in
the last g - t letters.  A pair belongs to the stretch in which its first
difference lies, so it is found once.  A word is in the two halves of its own
length's groups and of those of the length below.  A group of more than
``CROWD`` words is dealt anew, its stretch cut in half, until one place is left;
so no group is large, however often a beginning or an ending occurs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.plans.lineage import cut

LETTERS = "a-zÀ-ÿ"
CROWD = 8192  # words of a group
BLOCK = 2048  # words of groups that share an index
TILE = 1 << 16  # words of 64 bits that a step works on
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_runs(docs, min_length=7, id_col="doc_id", text_col="text"):
    """``id, word``: maximal runs of letters of whole texts, A-Z lower-cased, in any number.

    Runs of fewer than ``min_length`` code points are left out; NULL text has none.
    """
    low = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    runs = F.regexp_extract_all(low, F.lit("[%s]{%d,}" % (LETTERS, min_length)), 0)
    return docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("word"))


def vocabulary(words, min_length=7, min_count=2):
    """``word, n``: words of at least ``min_length`` code points that occur ``min_count`` times."""
    kept = words.where(F.length("word") >= min_length)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed(rows):
    fixed = F.greatest(F.col("g") - F.col("t"), F.lit(0))
    ahead = F.substring("word", F.lit(1), F.col("s"))
    behind = F.when(fixed > 0, F.substring("word", F.length("word") - fixed + 1, fixed)).otherwise("")
    return rows.withColumn("key", F.concat_ws("\u0001", ahead, behind))


def _halved(rows, s, t):
    mid = F.floor((s + t) / 2).cast("int")
    halves = F.array(F.struct(s.alias("s"), mid.alias("t")), F.struct(mid.alias("s"), t.alias("t")))
    return _keyed(rows.withColumn("half", F.explode(halves)).select("word", "n", "g", "half.s", "half.t"))


GROUP = ["g", "s", "t", "key"]


def groups(vocab, crowd=CROWD):
    """``word, n, g, s, t, key``: the groups of each word, none larger than ``crowd`` if it can be cut."""
    length = F.length("word")
    rows = vocab.select("word", "n", F.explode(F.array(length, length - 1)).alias("g")).where("g > 0")
    level, done = _halved(rows, F.lit(0), F.col("g") + 1), None
    while True:
        hot = level.where("t - s > 1").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size"))
        hot = cut(hot.where(F.col("size") > crowd).select(*GROUP))
        last = hot.isEmpty()
        cold = level if last else level.join(hot, GROUP, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        if last:
            return done
        level = cut(_halved(level.join(hot, GROUP, "left_semi"), F.col("s"), F.col("t")))


def _pack(bits):
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Index:
    """Bitsets by position and letter of the free letters of some words of length g or g + 1.

    ``group`` numbers the group of each word, from 0 on, in ascending order.
    """

    def __init__(self, words, g, s, t, group):
        n = len(words)
        self.g, self.s, self.t = g, s, t
        self.open_end = t > g  # the edit may be behind the last letter
        self.free = min(t, g) - s
        raw = np.frombuffer("".join(w.ljust(g + 1, "\0") for w in words).encode("utf-32-le"), np.uint32)
        length = np.array([len(w) for w in words])
        self.long = length > g
        letters = raw.reshape(n, g + 1)[:, s : s + self.free + 1].copy()
        kinds, code = np.unique(letters, return_inverse=True)
        self.code = code.reshape(letters.shape) + 1
        held = np.where(self.long, self.free + 1, self.free)
        self.code[np.arange(self.free + 1)[None, :] >= held[:, None]] = 0
        wide = -(-n // 64) * 64
        bits = np.zeros((self.free + 2, len(kinds) + 1, wide), bool)
        for i in range(self.free + 1):
            bits[i, self.code[:, i], np.arange(n)] = True
        bits[:, 0] = False
        self.at = _pack(bits)
        own = np.zeros((int(group[-1]) + 1, wide), bool)
        own[group, np.arange(n)] = True
        self.own = _pack(own)
        shorter = np.zeros(wide, bool)
        shorter[:n] = ~self.long
        self.shorter = _pack(shorter)
        self.group = group

    def same_or_longer(self, asked):
        """Bitsets of the near words of length g or g + 1 of words (numbers) of length g."""
        code = self.code[asked]
        none_wrong = self.own[self.group[asked]]
        replaced, inserted = np.zeros_like(none_wrong), np.zeros_like(none_wrong)
        for i in range(self.free):
            here, right = self.at[i][code[:, i]], self.at[i + 1][code[:, i]]
            replaced = (replaced & here) | (none_wrong & ~here)
            inserted = (inserted | none_wrong) & right
            none_wrong = none_wrong & here
        # without an error up to the end: the letter too many is the next one
        inserted = inserted | none_wrong if self.open_end else inserted & ~none_wrong
        return (replaced & self.shorter) | (inserted & ~self.shorter)

    def shorter_by_one(self, asked):
        """Bitsets of the near words of length g of words (numbers) of length g + 1."""
        code = self.code[asked]
        none_wrong = self.own[self.group[asked]]
        deleted = np.zeros_like(none_wrong)
        for i in range(self.free + 1):
            skipped = none_wrong
            if i:
                deleted = deleted & self.at[i - 1][code[:, i]]
            if i < self.free or self.open_end:
                deleted = deleted | skipped
                none_wrong = none_wrong & self.at[i][code[:, i]]
        if not self.open_end:
            deleted = deleted & ~none_wrong
        return deleted & self.shorter


def near_in_block(words, g, s, t, group):
    """``(asked, count, first)``: words with near words in their group, how many, and the first of them."""
    index = Index(words, g, s, t, group)
    rows = max(1, TILE // index.shorter.shape[-1])
    for longer, find in ((False, index.same_or_longer), (True, index.shorter_by_one)):
        todo = np.flatnonzero(index.long == longer)
        for at in range(0, len(todo), rows):
            asked = todo[at : at + rows]
            near = find(asked)
            count = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(count)
            word = (near[hit] != 0).argmax(axis=1)
            value = near[hit, word]
            low = np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1))
            yield asked[hit], count[hit], word * 64 + low.astype(np.int64)


def near_counts(vocab, crowd=CROWD):
    """``word, n_near, near, near_n``: near words of each word, the most frequent of them (then smallest) and its n."""

    def run(batches):
        held = {c: [] for c in ("word", "n", "g", "s", "t", "key")}
        for batch in batches:
            for c in held:
                held[c] += batch.column(batch.schema.get_field_index(c)).to_pylist()
            cuts = _cuts(held)
            for a, b in zip(cuts, cuts[1:]):
                yield from blocks(held, a, b)
            held = {c: v[cuts[-1] :] for c, v in held.items()}
        if held["word"]:
            yield from blocks(held, 0, len(held["word"]))

    def _cuts(held):
        """Where blocks of whole groups end, as far as is known."""
        names = list(zip(held["g"], held["s"], held["t"], held["key"]))
        cuts = [0]
        for i in range(1, len(names)):
            if names[i] != names[i - 1] and (i - cuts[-1] >= BLOCK or names[i][:3] != names[i - 1][:3]):
                cuts.append(i)
        return cuts

    def blocks(held, a, b):
        key = held["key"][a:b]
        new = np.array([0] + [x != y for x, y in zip(key, key[1:])])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        if not many.any():
            return
        kept = np.flatnonzero(many)
        words = [held["word"][a + i] for i in kept.tolist()]
        n = [held["n"][a + i] for i in kept.tolist()]
        group = np.unique(group[kept], return_inverse=True)[1]
        for asked, count, first in near_in_block(words, held["g"][a], held["s"][a], held["t"][a], group):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in asked.tolist()], pa.string()), pa.array(count, pa.int64()),
                 pa.array([n[i] for i in first.tolist()], pa.int64()), pa.array([words[i] for i in first.tolist()], pa.string())],
                ["word", "count", "near_n", "near"],
            )

    # in a group the most frequent word is first, so that the lowest bit of a result is the best one
    dealt = groups(vocab, crowd).repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("n"), "word")
    found = dealt.mapInArrow(run, "word string, count long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("count").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )


def variant_forms(vocab, factor=10, crowd=CROWD):
    """``word, form, root, n, n_near, form_n`` for each word of ``vocab (word, n)``.

    Two words are near if they differ by one inserted, deleted or replaced code
    point.  ``form`` is the near word of largest ``n`` (ties: the smallest in
    code-point order) if that is at least ``factor`` times the word's; ``root``
    is where following forms ends, the word itself without a form.  Words
    must be distinct and not NULL or empty; ``factor`` more than 1, as then forms
    have no cycles.  Other columns are ignored; an empty vocabulary gives no rows.
    """
    if factor <= 1:
        raise ValueError("factor must be more than 1")
    vocab = cut(vocab.select("word", "n"))
    near = near_counts(vocab, crowd)
    judged = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("near_n") >= factor * F.col("n"), F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n"))).alias("f"),
    )
    judged = cut(judged.select("word", "n", "n_near", "f.form", "f.form_n"))
    # pointers are doubled until none moves; a step multiplies n, so a chain has few
    roots = cut(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
