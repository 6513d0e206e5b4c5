"""Readers for the file formats in use; schemas are given, not inferred."""

from pyspark.sql import Window as W, functions as F


def csv(spark, path, schema, header=True, **options):
    """CSV with quoted text, doubled quotes inside quotes.

    Pass ``multiLine=True`` for line breaks inside quotes; a file is then read
    by one task.
    """
    multi = options.pop("multiLine", False)
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("escape", '"')
        .option("multiLine", multi)
        .options(**options)
        .csv(path)
    )


def csv_directory(spark, path, schema, **options):
    """Directory of header-less CSV parts."""
    return csv(spark, path, schema, header=False, **options)


def csv_in_order(spark, path, schema, out="pos", **options):
    """CSV with its row order as ``pos``: 0, 1, ... over all files by name.

    Rows are numbered inside each file split; the row counts of the splits,
    one row per split, give where each of them starts.
    """
    split = ["_file", "_start"]
    raw = csv(spark, path, schema, **options).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    before = W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)
    offsets = raw.groupBy(*split).agg(F.count(F.lit(1)).alias("_n")).select(
        *split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(W.partitionBy(*split).orderBy("_at"))
    placed = raw.join(offsets, split).withColumn(out, inside - 1 + F.col("_before"))
    return placed.drop(*split, "_at", "_before")


def tsv_gz(spark, path, schema, partitions=None, header=True, **options):
    """Gzipped TSV.  A gzip file is read by one task, so rows are spread after."""
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return csv(spark, path, schema, header=header, sep="\t", **options).repartition(n)


def json_lines(spark, path, schema):
    return spark.read.schema(schema).json(path)


def edge_list(spark, path, sep=" "):
    """Vertex pairs of a delimited text: ``(src, dst)``."""
    return spark.read.schema("src bigint, dst bigint").option("sep", sep).csv(path)


def pair_list(spark, path):
    """JSON array of two-element arrays: ``(pair_no, id1, id2)``."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pair_no", "p"))
    return pairs.select("pair_no", F.col("p")[0].alias("id1"), F.col("p")[1].alias("id2"))


def graphml(spark, path):
    """Vertices and edges of a GraphML file.

    Vertices: ``id``, ``data`` (a map of attribute key to text).  Edges: ``id,
    src, dst, data``.  ``hex_float`` turns C hex floats into doubles.
    """
    data = "data array<struct<_VALUE: string, _key: string>>"
    keep = lambda c: F.map_from_entries(F.transform(c, lambda d: F.struct(d["_key"], d["_VALUE"])))
    read = lambda tag, cols: spark.read.format("xml").option("rowTag", tag).schema(f"{cols}, {data}").load(path)
    vertices = read("node", "_id string").select(F.col("_id").alias("id"), keep("data").alias("data"))
    edges = read("edge", "_id string, _source string, _target string").select(
        F.col("_id").alias("id"), F.col("_source").alias("src"), F.col("_target").alias("dst"), keep("data").alias("data")
    )
    return vertices, edges


def hex_float(col):
    """A C hex float as text to a double."""
    return F.trim(col).cast("double")


def hex_floats(col):
    """A comma-separated list of hex floats."""
    return F.transform(F.split(col, ","), lambda v: F.trim(v).cast("double"))


def saved_pages(spark, path):
    """Text files, one page each: ``(file, html)``."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("html")
    )
