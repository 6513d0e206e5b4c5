"""URL verdicts by rules, and by a blocked Bloom filter before an exact join."""

from functools import reduce

from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # of 32 bits in a block
BITS_PER_KEY = 16
SMALL_FILTER = 8 << 20  # bytes up to which the filter goes to every task


def host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(url):
    """Host, path without slashes at its end, and query without ``utm_`` parameters; NULL without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "://[^?#]*\\?([^#]*)", 1)
    query = F.ltrim(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), F.lit("&"))
    whole = F.concat(
        host(url), F.rtrim(path(url), F.lit("/")), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    )
    return F.when(host(url) != "", whole)


def longest_rule(rules, host_col, path_col):
    """``struct(rule, verdict)`` of the longest rule that fits, or NULL.

    ``rules``: ``(verdict, host, path prefix)``.  A rule holds for its host
    and all its subdomains.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bits(key):
    spread = F.xxhash64(key, F.lit(1))
    places = [F.shiftright(spread, 5 * j).bitwiseAND(F.lit(31)).cast("int") for j in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def bloom_blocks(listed, key, blocks):
    """Blocked Bloom filter of a key column: ``block, w0..w7``, a row for each block in use."""
    at = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")
    cells = listed.select(at, *[b.alias(f"w{j}") for j, b in enumerate(_bits(key))])
    return cells.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)])


def in_list(rows, key, listed, bits_per_key=BITS_PER_KEY):
    """``rows`` with ``maybe`` (the filter's answer) and ``listed`` (the truth).

    Only rows that pass the filter go to the exact join.  NULL keys are not
    listed.  ``listed`` has distinct keys in its only column.
    """
    own = listed.columns[0]
    n = listed.count()
    blocks = max(1, -(-n * bits_per_key // (32 * WORDS)))
    bloom = bloom_blocks(listed, own, blocks)
    if blocks * 8 * (WORDS + 1) <= SMALL_FILTER:
        bloom = F.broadcast(bloom)  # its size was just computed
    probed = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).join(
        bloom.withColumnRenamed("block", "_block"), "_block", "left"
    )
    hit = reduce(lambda a, b: a & b, [F.col(f"w{j}").bitwiseAND(b) == b for j, b in enumerate(_bits(key))])
    maybe = F.coalesce(F.col(key).isNotNull() & hit, F.lit(False))
    probed = probed.withColumn("maybe", maybe).drop("_block", *[f"w{j}" for j in range(WORDS)])
    exact = listed.select(F.col(own).alias("_listed"))
    found = probed.where("maybe").join(exact, F.col(key) == F.col("_listed"), "left")
    found = found.withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    return found.unionByName(probed.where("NOT maybe").withColumn("listed", F.lit(False)))


def judge(pages, listed, rules, id_col="page_id", url_col="url"):
    """``<id>, host, path, rule, verdict, canonical, maybe, listed`` for each row.

    The longest rule decides; without one, a URL is blocked if its canonical
    form is among the canonical forms of ``listed`` (a table with a column
    ``url``), else allowed.  A NULL URL, or one without ``://``, has empty host
    and path and is allowed.  Repeated rows are judged each.
    """
    u = F.col(url_col)
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    rows = pages.select(F.col(id_col), host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    rows = in_list(rows, "canonical", keys)
    rows = rows.withColumn("_rule", longest_rule(rules, F.col("host"), F.col("path")))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"),
        "canonical", "maybe", "listed",
    )
