"""Exact copies by a tree-merge of sorted digest runs.

Every input partition is a leaf of the tree and has a run of digests.  Nodes
are numbered in base ``FAN``; in round r the nodes that differ in digit r only
exchange their runs, each taking over the digests whose own digit r is its
digit.  After the last round a node holds all digests of one bucket.  In each
round a task sorts what it has, merges equal digests before anything is sent
and merges the runs it receives, so a group of copies is one row for each
run at every level, however large it is.

A run is sorted by a 64-bit key; two entries are merged only if the SHA-256 of
the whole normalised text agrees too.  Each entry keeps the row that stays (most
code points in the original text, then smallest id; an id that is NULL comes
last) and the number of rows merged.
"""

from pyspark.sql import functions as F

from tablewright.plans.lineage import cut

FAN = 8
FEW_IDS = 2_000_000  # dropped ids up to which a counted table of them goes to every task (16 MB)
WHITE = "[\\x20\\x09-\\x0D]+"


def digests(docs, id_col="doc_id", text_col="text"):
    """``id, n (code points), key, sha``; NULL text is the empty text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.regexp_replace(text, WHITE, "")
    return docs.select(
        F.col(id_col).alias("id"),
        F.spark_partition_id().alias("leaf"),
        F.length(text).cast("long").alias("n"),
        F.xxhash64(bare).alias("key"),
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("sha"),
    )


def merge_runs(rows, parts, fan=FAN):
    """Digest table to ``key, sha, best, size``: one row for each digest."""
    rounds = 1
    while fan**rounds < parts:
        rounds += 1
    nodes = fan**rounds
    bucket = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(nodes))
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id")
    runs = rows.select(
        F.pmod(F.col("leaf"), F.lit(nodes)).cast("long").alias("node"), "key", "sha",
        best.alias("best"), F.lit(1).cast("long").alias("size"),
    )
    for r in range(rounds):
        step = fan**r
        digit = lambda c: F.pmod(F.floor(c / F.lit(step)), F.lit(fan))  # noqa: E731,B023
        moved = F.col("node") + (digit(bucket) - digit(F.col("node"))) * F.lit(step)
        runs = (
            runs.withColumn("node", moved.cast("long"))
            .groupBy("node", "key", "sha")
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
    return runs.drop("node")


def exact_groups(docs, id_col="doc_id", text_col="text", fan=FAN):
    """One row per row of ``docs``: ``<id>, keep_id, group_size, kept, text_sha256``.

    Copies are texts equal after deleting spaces, tabs and line breaks; NULL
    and empty texts form one group.  Rows that repeat an id and a text all get
    the same decision.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(digests(docs, id_col, text_col))
    return decide(rows, id_col, int(spark.conf.get("spark.sql.shuffle.partitions")), fan)


def decide(rows, id_col, parts, fan=FAN):
    merged = merge_runs(rows, parts, fan).where("size > 1")
    merged = merged.select(F.col("key").alias("m_key"), F.col("sha").alias("m_sha"), "best", "size")
    joined = rows.join(merged, (F.col("key") == F.col("m_key")) & (F.col("sha") == F.col("m_sha")), "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs, id_col="doc_id", text_col="text", fan=FAN):
    """``docs`` with one row of each group of copies, all columns kept.

    Of rows that repeat an id and a text one stays.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(digests(docs, id_col, text_col))
    judged = cut(decide(rows, id_col, parts, fan).select(F.col(id_col).alias("id"), "kept", "text_sha256"))
    if rows.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        gone = cut(judged.where("NOT kept").select("id"))
        gone = F.broadcast(gone) if gone.count() <= FEW_IDS else gone
        return docs.join(gone, docs[id_col] == gone["id"], "left_anti")
    stay = judged.where("kept").drop("kept")
    # some ids repeat or are missing: rows are told apart by their text, too
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("own"), text.alias("text"),
        F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256).alias("sha"),
    )
    stay = stay.distinct()
    found = whole.join(stay, whole["own"].eqNullSafe(stay["id"]) & (whole["sha"] == stay["text_sha256"]), "left_semi")
    best = F.max_by("row", F.struct(F.length("text").alias("n"), "text"))
    return found.groupBy("own", "sha").agg(best.alias("row")).select("row.*")
