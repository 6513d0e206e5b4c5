"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The adjacent pairs of pre-tokens wait in buckets, one for each merge rank in
use; a bucket holds the positions of its pairs in a doubly linked list of
pieces.  Two levels of bitmaps over the ranks tell which buckets are in use; the
next rank is the lowest set bit of the lowest word.  A merge changes the pairs
on both sides; their old entries stay where they are and are skipped when their
turn comes, because the pair found there no longer has that rank.  So n bytes
take O(n log n) steps, also in one very long pre-token.

Pre-tokens do not touch each other, so all those of a batch that are not known
yet share one queue.  A task keeps the ids of frequent words and pre-tokens;
the memory for that is bounded.
"""

import base64
import hashlib
import itertools
import sys
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

WORD_BITS = 8  # 256 ranks in a bitmap word
WORD_MASK = (1 << WORD_BITS) - 1
KEPT = 300_000  # pre-tokens remembered in each of two generations
KEPT_WORDS = 200_000  # the same for words, which may hold a few pre-tokens
BATCH = 1 << 21  # code points looked at together
IN_LISTS = 1 << 22  # bytes up to which a queue's positions are in lists, beyond in arrays: 16 bytes for each byte


def read_ranks(path):
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_pairs(ranks):
    """Rank of two bytes at ``256 * first + second``; -1 where they are no token."""
    table = np.full(1 << 16, -1, np.int32)
    for token, rank in ranks.items():
        if len(token) == 2:
            table[token[0] << 8 | token[1]] = rank
    return table


def merge_pieces(tokens, ranks, pairs=None):
    """Ids of each pre-token (bytes, not empty) as 32-bit integers in a row; ``pairs`` is ``byte_pairs(ranks)``, if at hand."""
    pairs = byte_pairs(ranks) if pairs is None else pairs
    data = b"".join(tokens)
    n = len(data)
    rank_of = ranks.get
    column = list if n <= IN_LISTS else partial(array, "i")
    bounds = np.cumsum([0, *map(len, tokens)])
    heads = np.zeros(n + 1, np.uint8)  # 1 where a pre-token begins
    heads[bounds] = 1
    head = heads.tobytes()
    raw = np.frombuffer(data, np.uint8)
    first = np.full(n, -1, np.int32)
    first[:-1] = np.where(heads[1:n], -1, pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]])
    after, before = column(range(1, n + 2)), column(range(-1, n))
    rank_at = column(first.tolist())  # of the pair that begins here; -1 if none
    piece = column(map([ranks[bytes([byte])] for byte in range(256)].__getitem__, data))  # ids; -1: merged away
    top, words, buckets = 0, {}, {}  # words in use; ranks in use by word; positions by rank

    order = np.argsort(first, kind="stable")[np.count_nonzero(first < 0) :]
    cuts = np.flatnonzero(np.diff(first[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        rank = int(first[at[0]])
        buckets[rank] = at.tolist()
        word = rank >> WORD_BITS
        words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
        top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1  # find first set
        bits = words[word]
        low = bits & -bits
        rank = (word << WORD_BITS) + low.bit_length() - 1
        words[word] = bits = bits ^ low
        if not bits:
            top ^= 1 << word
        bucket = buckets.pop(rank)
        bucket.sort()  # the leftmost pair of a pre-token is merged first
        for done, i in enumerate(bucket, 1):
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            piece[i], piece[j] = rank, -1
            rank_at[j] = -1
            new = rank_at[i] = -1 if head[k] else rank_of(data[i : after[k]], -1)
            if new >= 0:
                if new in buckets:
                    buckets[new].append(i)
                else:
                    buckets[new] = [i]
                    word = new >> WORD_BITS
                    words[word] = words.get(word, 0) | 1 << (new & WORD_MASK)
                    top |= 1 << word
            lower = 0 <= new <= rank
            if not head[i]:
                h = before[i]
                new = rank_at[h] = rank_of(data[h:k], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(h)
                    else:
                        buckets[new] = [h]
                        word = new >> WORD_BITS
                        words[word] = words.get(word, 0) | 1 << (new & WORD_MASK)
                        top |= 1 << word
                    lower |= new <= rank
            if lower and done < len(bucket):  # it comes first; the rest of this bucket waits
                if rank in buckets:
                    buckets[rank] += bucket[done:]
                else:
                    buckets[rank] = bucket[done:]
                    word = rank >> WORD_BITS
                    words[word] = words.get(word, 0) | low
                    top |= 1 << word
                break
    ids = np.array(piece, np.int32)
    left = 4 * np.concatenate([[0], np.cumsum(ids >= 0)])[bounds]
    ids = ids[ids >= 0].tobytes()
    return [ids[a:b] for a, b in itertools.pairwise(left.tolist())]


@lru_cache(maxsize=2)
def tokenizer(path, pattern):
    return Tokenizer(read_ranks(path), pattern)


class Tokenizer:
    def __init__(self, ranks, pattern):
        self.ranks, self.pairs = ranks, byte_pairs(ranks)
        self.split = regex.compile(pattern).findall
        # what is known has its ids as bytes, four for each
        self.known, self.known_old = {}, {}  # by pre-token
        self.by_word, self.by_word_old = {}, {}  # by word, a space before it; None if it can't be looked up alone
        pieces = dict(zip(ranks.values(), ranks))
        upto = range(1 + max(pieces, default=-1))
        self.pieces = pa.array([pieces.get(rank, b"") for rank in upto], pa.large_binary())
        self.names = pa.array([f"{rank}," for rank in upto], pa.large_string())

    def _learn(self, tokens):
        """Puts the ids of these pre-tokens into ``known``."""
        if len(self.known) > KEPT:
            self.known_old, self.known = self.known, {}
        known, old, ranks, new = self.known, self.known_old, self.ranks, {}
        for token in tokens.difference(known):
            if token in old:
                known[token] = old[token]
                continue
            raw = token.encode("utf-8")
            rank = ranks.get(raw)
            if rank is None:
                new[token] = raw
            else:
                known[token] = rank.to_bytes(4, sys.byteorder)
        if new:
            known.update(zip(new, merge_pieces(list(new.values()), ranks, self.pairs)))

    def _learn_words(self, words):
        if len(self.by_word) > KEPT_WORDS:
            self.by_word_old, self.by_word = self.by_word, {}
        have, old, new = self.by_word, self.by_word_old, []
        for word in words.difference(have):
            if word in old:
                have[word] = old[word]
            elif not word or word[0].isspace():
                have[word] = None
            else:
                new.append(word)
        if not new:
            return
        tokens = self.split(" " + " ".join(new))
        starts = [i for i, token in enumerate(tokens) if token[0] == " "]
        if len(starts) != len(new):  # a pattern that does not begin a pre-token at each word
            parts = [self.split(" " + word) for word in new]
            tokens = list(itertools.chain.from_iterable(parts))
            starts = list(itertools.accumulate(map(len, parts[:-1]), initial=0))
        self._learn(set(tokens))
        found = list(map(self.known.__getitem__, tokens))
        for word, a, b in zip(new, starts, [*starts[1:], len(tokens)]):
            have[word] = found[a] if b == a + 1 else b"".join(found[a:b])

    def encode_all(self, texts):
        """Ids of each whole text, one list at a time."""
        return (ids.tolist() for ids in self.arrays(texts))

    def arrays(self, texts):
        """Ids of each whole text, one array at a time.

        A pre-token never runs across a space that precedes other than white
        space, so a text is looked up by its words; one with other white space
        is split by the pattern as a whole.
        """
        at = 0
        while at < len(texts):
            size, stop, words, first, rest = 0, at, set(), [], []
            while stop < len(texts) and size < BATCH:
                head, *parts = texts[stop].split(" ")
                first.append(self.split(head))
                rest.append(parts)
                words.update(parts)
                size += len(texts[stop])
                stop += 1
            self._learn_words(words)
            self._learn(set(itertools.chain.from_iterable(first)))
            for text, tokens, parts in zip(texts[at:stop], first, rest):
                found = list(map(self.by_word.__getitem__, parts))
                if None in found:
                    tokens, found = self.split(text), []
                    self._learn_more(tokens)
                ids = b"".join([*map(self.known.__getitem__, tokens), *found])
                yield np.frombuffer(ids, np.int32)
            at = stop

    def _learn_more(self, tokens):
        """As ``_learn``, without dropping what the batch at hand still needs."""
        missing = {t for t in tokens if t not in self.known}
        raw = [t.encode("utf-8") for t in missing]
        self.known.update(zip(missing, merge_pieces(raw, self.ranks, self.pairs)))

    def encode(self, text):
        return next(self.encode_all([text]))

    def decode(self, ids):
        """The bytes that ``ids`` stand for."""
        return _in_a_row(self.pieces.take(pa.array(ids, pa.int32()))).tobytes()

    def written(self, ids):
        """Decimal ids joined by commas, as bytes."""
        return _in_a_row(self.names.take(pa.array(ids, pa.int32())))[:-1]


def _in_a_row(values):
    """The bytes of all values of an Arrow array of its own."""
    data = values.buffers()[2]
    return memoryview(data or b"")[: pc.sum(pc.binary_length(values)).as_py() or 0]


def encode_column(df, path, pattern, text_col="text", out="ids"):
    """``df`` with the ids (array<int>) of each text; NULL text has none.

    ``path``: file of the ranks, found on every executor as part of the
    tokenizer package.  Every text is encoded whole.
    """

    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids = list(own.arrays([t or "" for t in texts.to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, out]
            )

    schema = df.drop(out).schema.add(out, ArrayType(IntegerType()))
    return df.drop(out).mapInArrow(run, schema)


def decode_column(df, path, pattern, ids_col="ids", out="decoded"):
    """``df`` with the bytes that each row's ids stand for; NULL ids give none."""

    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids_col))
            found = [own.decode(r.as_py() or ()) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    schema = df.drop(out).schema.add(out, BinaryType())
    return df.drop(out).mapInArrow(run, schema)


def round_trip(docs, path, pattern, id_col="doc_id", text_col="text", ids_col=None):
    """``<id>, n_tokens, ids_sha256, decoded_sha256, same`` for each row.

    With ``ids_col`` the ids (array<int>) are a column of that name at the end,
    those that the other columns are made from; else ids and bytes of a row exist
    one at a time, so memory is bounded by the longest text.  NULL text is empty: no ids, no bytes.  Repeated rows give
    repeated results; other columns are ignored.
    """

    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            counts, written, decoded, same, kept = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for text, ids in zip(texts, own.arrays(texts)):
                back = own.decode(ids)
                counts.append(len(ids))
                written.append(hashlib.sha256(own.written(ids)).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                same.append(back == text.encode("utf-8"))
                if ids_col:
                    kept.append(pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(written, pa.string()),
                       pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            if ids_col:
                ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays([pa.array([], pa.int32()), *kept])))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "same", *([ids_col] if ids_col else [])]
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    last = f", `{ids_col}` array<int>" if ids_col else ""
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean{last}"
    )
