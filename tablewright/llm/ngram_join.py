"""Near copies by Jaccard similarity of word n-grams: a parity-sketch join.

Each distinct n-gram of a document flips one bit of the document's sketch, so
the Hamming distance of two sketches is at most the size of the symmetric
difference of the two sets.  At similarity t two sets of sizes a and b differ in
D = (1 - t) / (1 + t) * (a + b) n-grams at most.  Documents are put into bands
of sizes; in a band the n-grams of a document are dealt by hash over more than
D pieces, each with the XOR of its n-grams' hashes.  Two similar documents have
the same n-grams in more pieces than either may leave out, so a join on the
piece finds the pair, without exception; a document leaves out the pieces of
fewest n-grams, which say least.  Neighbouring bands meet in a zone around their
boundary.
Pairs whose whole sketches are too far apart are dropped; the texts of the rest
are compared exactly.  Sketches of 1,024 bits are compared inside the join; a
large set, whose allowed difference would fill them, has a wide sketch, too, of
at least four bits for each n-gram that a similar set may lack or have more.

A piece that many documents share is not expanded into pairs: all are compared
with the one first that shares most with others, usually the text the others
were made from.  After that only members of different components are compared,
with more and more of them as centres, until every pair was compared or both
sides are known to be connected; the join itself drops pairs whose sketches are
too far apart.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.llm.words import chunks, mix, shingles, words
from tablewright.operators.graph import components
from tablewright.plans.lineage import cut

GROWTH = 1.5  # of the sizes from band to band
STEP_BITS = 6  # each step compares with 2^6 times as many centres of a piece
SPARE = 1 / 40, 1 / 20, 1 / 10, 1 / 8, 1 / 6, 1 / 4
LEAST = 16  # n-grams of a piece up to which it may count as small
SKETCH = 16  # 64-bit words of the whole sketch
FEW_IDS = 2_000_000  # ids up to which those of candidates go to every task (16 MB)


def spare_share(percent):
    """Pieces beyond those that two similar sets can differ in, as a share of them.

    The smallest one that lets a large set leave out its pieces of one n-gram or
    none, whose number is that of a Poisson distribution, with a fifth to spare.
    """
    for share in SPARE:
        mean = (100 + percent) / (2 * max(100 - percent, 1) * (1 + share))  # n-grams of a piece
        if (1 + mean) * np.exp(-mean) <= 0.8 * share / (1 + share):
            break
    return share


class Bands:
    """Bands of set sizes, and how many pieces a document of a size has in each."""

    def __init__(self, percent, growth=GROWTH):
        # a pair spans one boundary at most, and no size lies in two zones
        self.percent, self.growth, self.schemes = percent, max(growth, 1.05 * (100 / percent) ** 2), []
        self.spare = spare_share(percent)
        self.low, self.zone_end = 1, 0
        self.home, self.zone = np.full(1, -1), np.full(1, -1)

    def _scheme(self, low_end, top):
        """``(pieces, low_end, top)`` of pairs of sizes below ``low_end`` and up to ``top``."""
        most = (100 - self.percent) * (low_end - 1 + top) // (100 + self.percent)
        spare = 1 + int(most * self.spare) if most else 0
        return most + 1 + spare, low_end, top

    def may_go(self, n, pieces, low_end, top):
        """How many pieces a set of size ``n`` may leave out: all but one of those that any similar set shares."""
        partner = np.where(n < low_end, np.minimum(n * 100 // self.percent, top), low_end - 1)
        return pieces - 1 - (100 - self.percent) * (n + partner) // (100 + self.percent)

    def cover(self, largest):
        """Makes the bands up to a size; ``home[n]`` and ``zone[n]`` number the schemes of size n."""
        while self.low <= largest:  # the arrays reach beyond ``low``, but are filled below it only
            after = max(self.low + 1, int(self.low * self.growth))
            while -(-self.percent * after // 100) <= self.zone_end:
                after += 1
            home = np.full(max(after + after // 2, len(self.home)), -1)
            zone = home.copy()
            home[: len(self.home)], zone[: len(self.zone)] = self.home, self.zone
            home[self.low : after] = len(self.schemes)
            self.schemes.append(self._scheme(after, after - 1))
            first = -(-self.percent * after // 100)
            last = (after - 1) * 100 // self.percent
            if first < after <= last:
                zone = np.concatenate([zone, np.full(max(0, last + 1 - len(zone)), -1)])
                home = np.concatenate([home, np.full(len(zone) - len(home), -1)])
                zone[first : last + 1] = len(self.schemes)
                self.schemes.append(self._scheme(after, last))
                self.zone_end = last
            self.home, self.zone, self.low = home, zone, after


def text_sets(data, at, width):
    """``(row, hash)`` of the distinct n-grams of a chunk, by row, then hash; and the count of each row."""
    n = len(at) - 1
    row, _, _, code = words(data, at)
    row, _, value = shingles(row, code, width, n)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
        row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=n)


def _pieces_of(row, value, count, scheme_of, bands, seed):
    """``(row, key)``: the piece keys of the rows that ``scheme_of`` gives a scheme.

    A row leaves out its smallest pieces: those of fewer than t n-grams, for the
    largest t that leaves out no more than it may.  The same piece has the same
    n-grams in both rows of a pair, so of the two the one of larger t decides
    for both, and at least one shared piece stays.
    """
    scheme = scheme_of[count]
    use = scheme[row] >= 0
    row, value = row[use], value[use]
    if not len(row):
        return row, value
    pieces, low_end, top = (np.array(column, np.int64) for column in zip(*bands.schemes))
    piece = ((value >> np.uint64(32)) * pieces.astype(np.uint64)[scheme[row]]) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])]))
    held = np.diff(np.concatenate([first, [len(row)]]))
    x = np.bitwise_xor.reduceat(mix(value ^ np.uint64(seed)), first)
    row, piece = row[first], piece[first]
    n = len(count)
    own = np.flatnonzero((scheme >= 0) & (count > 0))
    kind = scheme[own]
    may = np.zeros(n, np.int64)
    may[own] = bands.may_go(count[own], pieces[kind], low_end[kind], top[kind])
    total = np.zeros(n, np.int64)
    total[own] = pieces[kind]
    least = np.zeros(n, np.int64)  # t
    for t in range(1, LEAST + 1):
        small = total - np.bincount(row[held >= t], minlength=n)
        least[small <= may] = t
    keep = held >= least[row]
    tag = mix((scheme[row].astype(np.uint64) << np.uint64(40)) ^ piece)
    key = mix(x ^ tag)[keep]
    full_row, full_piece = row, piece
    row = row[keep]
    many = own[least[own] == 0]  # they have their empty pieces, too
    if len(many):
        more_row, more_key = [row], [key]
        begin, end = np.searchsorted(full_row, many), np.searchsorted(full_row, many, side="right")
        for i, a, b in zip(many.tolist(), begin, end):
            empty = np.setdiff1d(np.arange(int(total[i]), dtype=np.uint64), full_piece[a:b])
            more_row.append(np.full(len(empty), i))
            more_key.append(mix(mix((np.uint64(scheme[i]) << np.uint64(40)) ^ empty)))
        row, key = np.concatenate(more_row), np.concatenate(more_key)
    return row, key


def _wide_words(n, percent):
    """64-bit words of the wide sketch of a set of size ``n``, a power of two; 0 if the usual one will do."""
    bits = 4 * (100 - percent) * 2 * n // (100 + percent)
    return 0 if bits <= 64 * SKETCH else 1 << (bits - 1).bit_length() - 6


def _wide_sketch(value, words):
    out = np.zeros(words, np.uint64)
    place = ((value >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (value & np.uint64(63)))
    return out


def sketches(docs, width, percent, id_col="id", text_col="text"):
    """``id, n, h1, h2, s0.., wide, keys``: set size, hash of the set, whole sketches, piece keys."""

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            ids = batch.column(0)
            for first, data, at in chunks(batch.column(1)):
                n = len(at) - 1
                row, value, count = text_sets(data, at, width)
                bands.cover(int(count.max(initial=1)))
                parts = [_pieces_of(row, value, count, s, bands, 0x51ED) for s in (bands.home, bands.zone)]
                rows = np.concatenate([p[0] for p in parts])
                order = np.argsort(rows, kind="stable")
                keys = np.concatenate([p[1] for p in parts])[order].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
                some = np.flatnonzero(count)
                begin = np.searchsorted(row, some)
                whole = np.zeros((2 + SKETCH, n), np.uint64)
                if len(some):
                    whole[0, some] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5)), begin)
                    whole[1, some] = np.add.reduceat(mix(value ^ np.uint64(0x5A5A)), begin)
                    flip = np.uint64(1) << (value & np.uint64(63))
                    word = ((value >> np.uint64(6)) % np.uint64(SKETCH)).astype(np.int64)
                    np.bitwise_xor.at(whole, (2 + word, row), flip)
                wide, upto = [np.zeros(0, np.uint64)], np.zeros(n + 1, np.int32)
                starts = np.concatenate([[0], np.cumsum(count)])
                for i in range(n):
                    size = _wide_words(int(count[i]), percent)
                    if size:
                        wide.append(_wide_sketch(value[starts[i] : starts[i + 1]], size))
                    upto[i + 1] = upto[i] + size
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(count.astype(np.int64)), *[pa.array(w.view(np.int64)) for w in whole],
                     pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(wide).view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                    names,
                )

    names = ["id", "n", "h1", "h2", *[f"s{k}" for k in range(SKETCH)], "wide", "keys"]
    kinds = ["long"] * (4 + SKETCH) + ["array<long>"] * 2
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))


SKETCH_COLS = ["n", *[f"s{k}" for k in range(SKETCH)]]


def _near(a, b, percent):
    """Whether sizes and sketches, in columns prefixed ``a`` and ``b``, allow two sets to be similar."""
    small, large = F.least(a + "n", b + "n"), F.greatest(a + "n", b + "n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in SKETCH_COLS[1:]])
    few = apart * (100 + percent) <= (100 - percent) * (F.col(a + "n") + F.col(b + "n"))
    return (small * 100 >= large * percent) & few


def _prefixed(classes, name):
    return classes.select(F.col("id").alias(name), *[F.col(c).alias(name + c) for c in SKETCH_COLS])


def _possible(pairs, classes, percent):
    """Of pairs of classes ``a < b`` those that size and sketch allow to be similar."""
    left = pairs.join(_prefixed(classes, "a"), "a")
    right = _prefixed(classes, "b").withColumnRenamed("b", "own")
    return left.join(right, (F.col("b") == F.col("own")) & _near("a", "b", percent)).select("a", "b")


def _widely_possible(pairs, classes, percent):
    """Of ``pairs (a, b)`` those that wide sketches allow to be similar; sets without one pass."""

    def run(batches):
        for batch in batches:
            sizes = [c.to_numpy() for c in batch.columns[2:4]]
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (w.values.to_numpy().view(np.uint64) if w.is_valid and len(w.values) else None for w in (x, y))
                if x is None or y is None:
                    keep.append(True)
                    continue
                # the larger one is folded: bits of equal place modulo the smaller length are added up
                words = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(w.reshape(-1, words), axis=0) for w in (x, y))
                apart = int(np.bitwise_count(x ^ y).sum())
                keep.append(apart * (100 + percent) <= (100 - percent) * int(sizes[0][i] + sizes[1][i]))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    named = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("wide").alias("w" + x))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")


def _similar(pairs, texts, width, percent):
    """Of ``pairs (a, b)`` those whose texts are similar, compared exactly."""

    def run(batches):
        known, own = None, None
        for batch in batches:
            a = batch.column(0).to_pylist()
            fresh = [i for i in range(len(a)) if i == 0 and a[0] != known or i and a[i] != a[i - 1]]
            left, right = [], []
            for out, text in ((left, batch.column(2).take(pa.array(fresh, pa.int64()))), (right, batch.column(3))):
                for _, data, at in chunks(text):
                    row, value, _ = text_sets(data, at, width)
                    out += np.split(value, np.searchsorted(row, np.arange(1, len(at) - 1)))
            linked, at = [], 0
            for i in range(len(a)):
                if at < len(fresh) and fresh[at] == i:
                    known, own, at = a[i], left[at], at + 1
                other = right[i]
                place = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
                common = int(np.count_nonzero(own[place] == other)) if len(own) else 0
                linked.append(100 * common >= percent * (len(own) + len(other) - common) and common > 0)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _texts_of(pairs, docs, have):
    """Texts of the ids in ``pairs`` that are not in ``have`` yet, as a table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if have is not None:
        ids = ids.join(have, "id", "left_anti")
    ids = cut(ids)
    n = ids.count()
    if not n:
        return have
    if n <= FEW_IDS:
        ids = F.broadcast(ids)  # counted just now
    found = cut(docs.join(ids, "id", "left_semi"))
    return found if have is None else have.unionByName(found)


def _groups(sketch, classes, docs, width, percent):
    """``id, label``: the smallest class that links reach, for each class that is linked."""
    copies = cut(classes.where("id <> rep").select("id"))
    copies = F.broadcast(copies) if copies.count() <= FEW_IDS else copies
    pieces = sketch.join(copies, "id", "left_anti").select("id", F.explode("keys").alias("key"))
    shared = pieces.groupBy("key").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size")
    )
    shared = cut(shared.where("size > 1"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def test(pairs, texts):
        pairs = cut(_widely_possible(pairs, classes, percent))
        texts = _texts_of(pairs, docs, texts)
        return (cut(_similar(pairs, texts, width, percent)) if texts is not None else pairs.limit(0)), texts

    # a piece of two classes is a pair; one of more is a crowd
    duo = shared.where("size = 2 AND first <> last").select(F.col("first").alias("one"), F.col("last").alias("rep"))
    crowd = pieces.join(shared.where("size > 2").select("key", "size"), "key")
    crowd = cut(crowd.select("key", F.col("id").alias("node"), "size").distinct())
    shares = crowd.groupBy("node").agg(F.sum("size").alias("shares"))
    lead = crowd.join(shares, "node").groupBy("key").agg(
        F.max_by("node", F.struct("shares", (-F.col("node")).alias("node"))).alias("lead")
    )
    crowd = cut(crowd.join(lead, "key"))
    stars = crowd.where("node <> lead").select(*pair("node", "lead"))
    pairs = duo.select(*pair("one", "rep")).unionByName(stars).distinct()
    links, texts = test(cut(_possible(pairs, classes, percent)), None)

    step, label = 1, None
    crowd = crowd.where("size > 2")
    while not crowd.isEmpty():
        label = _labels(links) if label is None else label
        named = crowd.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        named = cut(named.join(mixed, "key"))
        # a node is a centre from the step on at which its hash has enough zeros for the size of the piece
        steps = F.ceil(F.log(float(1 << STEP_BITS), F.col("size")))
        when = F.greatest(F.lit(1), steps - F.floor(_zeros(F.xxhash64("node")) / STEP_BITS))
        full = named.join(_prefixed(classes, "node"), "node")
        centres = named.where((when == step) & (F.col("node") != F.col("lead"))).select(
            F.col("key").alias("c_key"), F.col("node").alias("c"), F.col("label").alias("c_label")
        ).join(_prefixed(classes, "c"), "c")
        apart = (F.col("key") == F.col("c_key")) & (F.col("label") != F.col("c_label")) & _near("node", "c", percent)
        pairs = cut(full.join(centres, apart).select(*pair("node", "c")).distinct())
        found, texts = test(pairs, texts)
        if not found.isEmpty():
            links, label = links.unionByName(found), None
        crowd = named.where(steps > step).drop("label")
        step += 1
    return _labels(links) if label is None else label


def _zeros(h):
    """Trailing zero bits of a long, 63 at most."""
    low = h.bitwiseAND(-h)
    return F.when(h == 0, 63).otherwise(F.bit_count(low - 1))


def _labels(links):
    """``id, label``: the smallest class connected to each class in ``links``."""
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return cut(
        components(ids, links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(
            "id", F.col("component").alias("label")
        )
    )


def similar_groups(docs, width=5, percent=80, id_col="doc_id", text_col="text"):
    """``<id>, n_shingles, component_id`` for each row.

    A document's set are its distinct ``width``-word n-grams, or its whole
    sequence of words if it has fewer; one without words (NULL, empty, white
    space) has none and is linked with nothing.  Two documents are linked if
    ``100 * common >= percent * union``; ``component_id`` is the smallest id
    that links reach.  Copies are one class and are never paired.  Repeated ids
    and NULL ids are told apart by row: each gets its own line, and NULLs do
    not count for the smallest id.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = None
    sketch = cut(sketches(rows, width, percent))
    ids = sketch.groupBy("id").count()
    if not ids.where("count > 1 OR id IS NULL").isEmpty():
        own = cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"))
        rows = own.select(F.col("row").alias("id"), "text")
        sketch = cut(sketches(rows, width, percent))
    same = ["n", "h1", "h2"]
    first = sketch.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    first = first.where("size > 1").select(*[F.col(c).alias("f_" + c) for c in same], F.col("rep").alias("f_rep"))
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col("f_" + c) for c in same])
    classes = cut(
        sketch.drop("keys").join(first, match, "left").select("*", F.coalesce("f_rep", "id").alias("rep")).drop(*first.columns)
    )
    label = _groups(sketch, classes, rows, width, percent).withColumnRenamed("id", "rep")
    found = classes.join(label, "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id")
    )
    if own is None:
        return found.withColumnRenamed("id", id_col)
    named = found.join(own.select(F.col("row").alias("id"), F.col("id").alias("own")), "id")
    least = named.groupBy("component_id").agg(F.min("own").alias("least"))
    return named.join(least, "component_id").select(
        F.col("own").alias(id_col), "n_shingles", F.col("least").alias("component_id")
    )


def without_near_copies(docs, width=5, percent=80, id_col="doc_id", text_col="text"):
    """``docs`` with one document of each group, that of the smallest id, all columns kept.

    Rows that repeat an id, or have none, go only if each of them is a copy of
    a document with another id.
    """
    groups = similar_groups(docs, width, percent, id_col, text_col)
    own = F.max(F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = cut(groups.groupBy(F.col(id_col).alias("gone")).agg(own.alias("stays")).where("NOT stays").select("gone"))
    if gone.count() <= FEW_IDS:
        gone = F.broadcast(gone)  # counted just now; the texts stay where they are
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone"]), "left_anti")
