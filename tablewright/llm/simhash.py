"""Near copies by SimHash: multi-index hashing.

A document's fingerprint has 64 bits: a bit is set if it is set in more than
half of the XXH64 hashes of its word shingles, repeats included.  Two
fingerprints at distance 2 or less differ in one bit at most in their high half,
or not at all in their low half.  So there is a table of each half: a
fingerprint looks up the 33 values of the Hamming ball of radius 1 around its
high half, and its own low half; the whole distance of each match is verified.

Everything after the fingerprints works on distinct ones, so copies cost one
row.  A table entry that more than ``CROWD`` fingerprints share is not compared
with itself: its members and those that look it up are taken to the 65 words at
distance 1 or less of each instead.  Fingerprints that meet at a word are within
2 of each other, and any two within 2 meet at one; at most 65 meet, so a star
around the smallest links them all.  This is exact, too, and linear in the
number of fingerprints.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tablewright.llm.hot import attach
from tablewright.operators.graph import components
from tablewright.plans.lineage import cut

CROWD = 64  # fingerprints that share a half
PIECE = 1 << 20  # bytes of a text whose words are held at once
SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(data):
    """The words of a text (bytes), some at a time; a word is never cut."""
    at = 0
    while len(data) - at > PIECE:
        space = _SPACE.search(data, at + PIECE)
        if space is None:
            break
        yield data[at : space.start()].lower().split()
        at = space.end()
    yield data[at:].lower().split()


def fingerprint(text, width=3):
    """The fingerprint of a text; without words it is zero."""
    ones, n, tail, whole = np.zeros(64, np.int64), 0, [], False
    for words in _word_lists(text.encode("utf-8")):
        words = tail + words
        last = len(words) - width + 1
        if last > 0:
            runs = zip(*[words[k : k + last] for k in range(width)])
            hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)]
            ones += _bits(hashes)
            n += last
            whole = True
        tail = words[max(0, last) :]
    if not whole and tail:
        ones, n = _bits([xxhash.xxh64_intdigest(b" ".join(tail), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _bits(hashes):
    raw = np.array(hashes, np.uint64).view(np.uint8).reshape(len(hashes), 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs, width=3, id_col="doc_id", text_col="text"):
    """``id, fp`` (the 64 bits as a signed long); NULL text is empty.  Every text is read whole."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or "", width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, fp long")


def _ball(value, bits):
    """``value`` and the values that differ from it in one of the lower ``bits``."""
    flips = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(bits)]]
    return F.explode(F.array(*[value.bitwiseXOR(f) for f in flips]))


LOW_TABLE = 1 << 33  # marks keys of the table of low halves


def near_pairs(prints, crowd=CROWD):
    """``a, b`` (a < b): links that connect what fingerprints at distance 2 or less connect.

    ``prints``: distinct fingerprints, column ``fp``.  Every pair outside of
    crowds is there; in a crowd the links are stars.
    """
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(LOW_TABLE))
    table = prints.select("fp", F.explode(F.array(high, low)).alias("key"))
    crowded = cut(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"))
    probes = prints.select(F.col("fp").alias("a"), low.alias("key")).unionByName(
        prints.select(F.col("fp").alias("a"), _ball(high, 32).alias("key"))
    )
    many = not crowded.isEmpty()
    entries = table.join(crowded, "key", "left_anti") if many else table
    verified = (F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= 2)
    met = probes.join(entries.withColumnRenamed("key", "own"), (F.col("key") == F.col("own")) & verified)
    links = met.select("a", F.col("fp").alias("b"))
    if many:
        # who shares a crowded value, and who looks one up
        around = crowded.where(F.col("key") < LOW_TABLE).select(_ball(F.col("key"), 32).alias("key"))
        touched = crowded.where(F.col("key") >= LOW_TABLE).unionByName(around).distinct()
        inside = table.join(touched, "key", "left_semi").select("fp").distinct()
        # at most 65 fingerprints are within 1 of a word
        meet = inside.select("fp", _ball(F.col("fp"), 64).alias("word")).groupBy("word")
        meet = meet.agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        stars = meet.select("a", F.explode("all").alias("b")).where("a < b")
        links = links.unionByName(stars)
    return links.distinct()


def near_groups(docs, width=3, id_col="doc_id", text_col="text", crowd=CROWD):
    """``<id>, fingerprint, component_id`` for each row of ``docs``.

    Words are runs of other than white space, A-Z lower-cased; a text with
    fewer than ``width`` words is one shingle; one without words (NULL, empty)
    has fingerprint zero and is linked like any other.  Documents are linked if
    their fingerprints differ in two bits or fewer; ``component_id`` is the
    smallest id that links reach.  ``fingerprint`` is 16 hexadecimal digits.
    Repeated rows and ids each have their own line; NULL ids do not count for
    the smallest one.  Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, width, id_col, text_col))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")))
    links = cut(near_pairs(prints.select("fp"), crowd))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = components(ids, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    label = cut(label.select(F.col("id").alias("fp"), "component").join(prints, "fp"))
    whole = cut(label.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    linked = label.drop("least")
    n = linked.count()
    found = attach(linked, whole, "component", "n", n).select("fp", "component_id", "size")
    alone = prints.join(found, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "size")
    facts = cut(found.unionByName(alone))
    return attach(rows, facts, "fp", "size", rows.count()).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
