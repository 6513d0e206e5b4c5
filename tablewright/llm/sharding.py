"""Contiguous shards of equal bytes, from global prefix sums.

Rows are put in the order of the id, on many partitions; each partition sums
its own bytes and rows, the totals of the partitions (one row for each) are
added up, and a row's place in the whole table is its partition's start plus a
running sum inside the partition.  The line of bytes is cut at equal targets.
"""

from pyspark.sql import Window as W, functions as F

from tablewright.plans.lineage import cut

OVERHEAD = 16


def byte_shards(docs, shards=40, id_col="doc_id", text_col="text", overhead=OVERHEAD):
    """``<id>, size, text_crc32, law, shard, slot, grown_shard``, a row for each row.

    A row's size is the bytes of its text plus ``overhead``; NULL text has
    none.  A row goes to the shard in which the middle of its bytes lies, so a
    shard's bytes are off the target by one row at most, and a row larger than
    the target may leave a neighbour empty.  Ties of the id are ordered by
    checksum and size; NULL ids come first.  ``slot`` numbers the rows of a
    shard from 0.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["id", "crc", "size"]
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
    )
    ranged = sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)  # fixes the ranges: the totals and the rows below must see the same
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    line = ranged.join(starts, "part").select(
        "id", "size", "crc",
        (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.count(F.lit(1)).over(inside) - 1).alias("place"),
        "total",
    )
    middle = (2 * F.col("start") + F.col("size")).cast("decimal(38,0)")
    cuts = F.floor(middle * F.lit(shards) / (2 * F.col("total")).cast("decimal(38,0)"))
    line = cut(line.withColumn("shard", F.least(cuts, F.lit(shards - 1)).cast("int")).drop("start", "total"))
    first = line.groupBy("shard").agg(F.min("place").alias("first"))
    return line.join(F.broadcast(first), "shard").select(  # as many rows as shards
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
