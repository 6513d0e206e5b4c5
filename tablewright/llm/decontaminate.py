"""Benchmark passages in documents: SimHash of item-sized windows, looked up by Hamming blocks.

Every place of every text is looked at: where a word shingle of an item occurs,
all windows of that item's length over the place get a 64-bit SimHash of their
shingles.  Fingerprints are cut into ``BLOCKS`` blocks; two that differ in
``RADIUS`` bits at most differ in ``RADIUS // BLOCKS`` bits at most in one of
them, so the block tables return every item within the radius.  For those the
weighted Jaccard similarity of the two multisets of shingles is computed exactly.

Items come to the tasks in groups of ``GROUP_BYTES`` of text; each group is
searched over all documents, so neither the driver nor a task holds more.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.llm.words import chunks, shingles, words

BLOCKS, RADIUS = 8, 23  # blocks of 8 bits; 8 * (2 + 1) differences are needed to hide from all of them
GROUP_BYTES = 4 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SHIFT = np.arange(64, dtype=np.uint64)
_TABLE = 1 << 20


def _bits(code):
    """+1 or -1 for each bit of each shingle."""
    return ((code[:, None] >> _SHIFT) & np.uint64(1)).astype(np.int16) * np.int16(2) - np.int16(1)


def _packed(signs):
    return (signs.astype(np.uint64) << _SHIFT).sum(axis=1, dtype=np.uint64)


def simhash(code):
    """Fingerprint of a multiset of shingles; a bit without majority is 0."""
    return _packed(_bits(code).sum(axis=0, keepdims=True, dtype=np.int32) > 0)[0]


def similarity(a, b):
    """Weighted Jaccard of two multisets: sum of smaller counts over sum of larger ones."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


class ItemIndex:
    """Items of a benchmark by shingle, and by blocks of their fingerprints."""

    def __init__(self, ids, texts, width):
        self.ids, self.codes, self.widths = ids, [], {}
        self.length = np.zeros(len(ids), np.int64)
        for first, data, at in chunks(pa.array(texts, pa.string())):
            row, _, _, code = words(data, at)
            cuts = np.searchsorted(row, np.arange(len(at)))
            for i in range(len(at) - 1):
                own = code[cuts[i] : cuts[i + 1]]
                self.length[first + i] = len(own)
                w = min(width, len(own))
                self.codes.append(shingles(np.zeros(len(own), np.int64), own, w, 1)[2] if w else own)
        self.size = np.array([len(c) for c in self.codes], np.int64)
        for w in range(1, width + 1):
            items = [i for i in range(len(ids)) if min(width, self.length[i]) == w]
            if items:
                self.widths[w] = self._by_width(items)

    def _by_width(self, items):
        code = np.concatenate([self.codes[i] for i in items])
        item = np.repeat(items, [len(self.codes[i]) for i in items])
        order = np.argsort(code, kind="stable")
        code, item = code[order], item[order]
        seen = np.zeros(_TABLE, bool)
        seen[code & np.uint64(_TABLE - 1)] = True
        lengths = {}
        for n in {len(self.codes[i]) for i in items}:
            own = np.array([i for i in items if len(self.codes[i]) == n])
            prints = np.array([simhash(self.codes[i]) for i in own], np.uint64)
            parts = prints.view(np.uint8).reshape(-1, BLOCKS)
            near = _ONES[np.arange(256, dtype=np.uint8)[:, None, None] ^ parts[None]] <= RADIUS // BLOCKS
            lengths[n] = own, prints, near.transpose(2, 0, 1)  # block, value, item
        return seen, code, item, lengths

    def search(self, row, code, n_rows, percent):
        """``(row, item, first word, shingles, similarity, differing bits)`` of the best window of each row and item."""
        for w, (seen, known, item, lengths) in self.widths.items():
            at_row, first, value = shingles(row, code, w, n_rows)
            maybe = np.flatnonzero(seen[value & np.uint64(_TABLE - 1)])
            place = np.minimum(np.searchsorted(known, value[maybe]), len(known) - 1)
            hit = maybe[known[place] == value[maybe]]
            if not len(hit):
                continue
            low = np.searchsorted(known, value[hit])
            count = np.searchsorted(known, value[hit], side="right") - low
            of = item[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            size = self.size[of]
            at = np.repeat(hit, count)
            # one task for each text and window size: the places where windows may lie
            keys = np.unique(np.stack([at_row[at], size, at]), axis=1)
            cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            for part in np.split(keys, cuts, axis=1):
                r, n = int(part[0, 0]), int(part[1, 0])
                begin, end = np.searchsorted(at_row, r), np.searchsorted(at_row, r, side="right")
                yield from (
                    (r, i, int(first[s]), size, sim, apart)
                    for i, s, size, sim, apart in self._best(value, begin, end, n, part[2], lengths[n], percent)
                )

    def _best(self, value, begin, end, n, hits, index, percent):
        own, prints, near = index
        if end - begin < n:  # a text shorter than the item is one window
            starts, n = np.array([begin]), end - begin
        else:
            wanted = np.zeros(end - begin + 2, np.int32)
            np.add.at(wanted, np.maximum(hits - n + 1, begin) - begin, 1)
            np.add.at(wanted, np.minimum(hits, end - n) - begin + 1, -1)
            starts = np.flatnonzero(np.cumsum(wanted[: end - begin - n + 1]) > 0) + begin
        best = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):  # windows that overlap
            for k in range(0, len(part), 4096):
                some = part[k : k + 4096]
                base = int(some[0])
                total = np.zeros((int(some[-1]) + n - base + 1, 64), np.int32)
                np.cumsum(_bits(value[base : int(some[-1]) + n]), axis=0, out=total[1:])
                found = _packed(total[some - base + n] - total[some - base] > 0)
                parts = found.view(np.uint8).reshape(-1, BLOCKS)
                listed = reduce(np.logical_or, [near[b][parts[:, b]] for b in range(BLOCKS)])
                window, which = np.nonzero(listed)
                apart = _ONES[(found[window] ^ prints[which]).view(np.uint8).reshape(-1, BLOCKS)].sum(axis=1, dtype=np.int64)
                for x, y, d in zip(window.tolist(), which.tolist(), apart.tolist()):
                    if d > RADIUS:
                        continue
                    start, i = int(some[x]), int(own[y])
                    sim = similarity(value[start : start + n], self.codes[i])
                    if 100 * sim >= percent - 1e-9 and (i not in best or sim > best[i][2]):
                        best[i] = (start, n, sim, d)
        return [(i, *b) for i, b in best.items()]


def find_passages(docs, items, width=5, percent=80, id_col="doc_id", text_col="text", item_col="item_id", item_text="text"):
    """``<id>, <item>, similarity, differing_bits, start, end``: the best window of each document and item.

    A window counts if the weighted Jaccard similarity of its word shingles
    and the item's is ``percent`` or more; of equal ones the first is
    reported.  ``start`` and ``end`` are code points of the whole text.  An item
    of fewer than ``width`` words is one shingle; NULL or empty items and texts
    match nothing.  Repeated rows on either side are reported each.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` long, similarity double, differing_bits int, start long, end long"
    parts = [rows.mapInArrow(_searcher(x, percent, id_col, item_col), schema) for x in _indexes(items, width, item_col, item_text)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _indexes(items, width, item_col="item_id", item_text="text"):
    """An index for each group of items; a group has about ``GROUP_BYTES`` of text."""
    listed = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    groups = 1 + (listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES
    for g in range(groups):
        part = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).toArrow()
        yield ItemIndex(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], width)


def _hits(index, text, percent):
    """``(row, item, similarity, differing bits, start, end)`` of a string array."""
    for first, data, at in chunks(text):
        row, start, end, code = words(data, at)
        for r, i, word, n, sim, apart in index.search(row, code, len(at) - 1, percent):
            last = word + n - 1 + index.length[i] - len(index.codes[i])
            s, e = (int(np.count_nonzero((data[at[r] : b] & 0xC0) != 0x80)) for b in (start[word], end[last]))
            yield first + r, index.ids[i], sim, apart, s, e


def _searcher(index, percent, id_col, item_col):
    def run(batches):
        for batch in batches:
            found = sorted(_hits(index, batch.column(1), percent), key=lambda f: f[0])
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]],
                [id_col, item_col, "similarity", "differing_bits", "start", "end"],
            )

    return run


def without_passages(docs, items, width=5, percent=80, text_col="text", item_col="item_id", item_text="text"):
    """``docs`` without the rows that hold a benchmark passage; all columns and all other rows are kept."""

    def keeper(index):
        def run(batches):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for found in _hits(index, batch.column(batch.schema.get_field_index(text_col)), percent):
                    clean[found[0]] = False
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for index in _indexes(items, width, item_col, item_text):
        docs = docs.mapInArrow(keeper(index), docs.schema)
    return docs
