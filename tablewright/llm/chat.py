"""Reply trees to conversations: root-to-leaf paths, ranked, formatted, with a loss mask.

Paths are enumerated by self-joins that double: after round k each leaf has
its ancestors up to 2^k steps away, and every node knows the one at 2^k, so a
thread of n messages takes log2(n) rounds.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message.
Inside roles and texts a backslash is doubled, and the first character of a
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``,
``<</SYS>>``) gets one behind it; a line break in a role gets one before it.
``unescape`` reverses all of this.
"""

from pyspark.sql import Window as W, functions as F

from tablewright.plans.lineage import cut

START, END = "<|im_start|>", "<|im_end|>"
MESSAGE = "(?s)<\\|im_start\\|>((?:[^\\\\\\n]|\\\\.)*+)\\n(.*?)<\\|im_end\\|>\\n"


def escape(c):
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, "<(\\||/?s>|</?SYS>>)", "<\\\\$1")
    return F.regexp_replace(c, "\\[(/?INST\\])", "[\\\\$1")


def escape_role(c):
    return F.replace(escape(c), F.lit("\n"), F.lit("\\\n"))


def unescape(c):
    return F.regexp_replace(c, "(?s)\\\\(.)", "$1")


def _key(tree):
    """A tree id to join by: plain equality of structs holds for NULL fields, too."""
    return F.struct(F.col(tree).alias("id")).alias("tree")


def reply_paths(nodes, tree, node, parent, score):
    """``tree, leaf, node, depth, path_score``: a row for each message of each root-to-leaf path.

    A message whose parent is NULL or unknown is a root; ``depth`` counts from
    the root, from 0.  ``path_score`` is the mean score of the path (NULL
    counts as 0).  Messages without a tree id are one tree.  Node ids are unique
    in a tree; messages in a cycle of replies hang from no root and are left out.
    """
    base = nodes.select(
        _key(tree), F.col(node).alias("node"), F.col(parent).alias("parent"),
        F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
    )
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    base = cut(
        base.join(known, ["tree", "parent"], "left").select(
            "tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"
        )
    )
    inner = base.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = base.join(inner, ["tree", "node"], "left_anti")
    chain = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump = base.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("above"))
    largest = base.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < largest:
        more = chain.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("up") + F.lit(step)).alias("up")
        )
        chain = cut(chain.unionByName(more))
        jump = cut(
            jump.join(jump.select("tree", F.col("node").alias("above"), F.col("above").alias("higher")), ["tree", "above"])
            .select("tree", "node", F.col("higher").alias("above"))
        )
        step *= 2
        if jump.isEmpty():
            break
    scored = chain.join(base.select("tree", "node", "score"), ["tree", "node"])
    whole = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"), F.max("up").alias("length"))
    return scored.join(whole, ["tree", "leaf"]).select(
        F.col("tree.id").alias("tree"), "leaf", "node", (F.col("length") - F.col("up")).alias("depth"), "path_score"
    )


def best_paths(paths, best=None):
    """Adds ``rank`` of each path in its tree, by score, then leaf; keeps the first ``best`` if given."""
    paths = paths.withColumn("tree", _key("tree"))
    ends = paths.where("node = leaf").select("tree", "leaf", "path_score")
    order = W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    ranked = ends.select("tree", "leaf", F.row_number().over(order).alias("rank"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return paths.join(ranked, ["tree", "leaf"]).withColumn("tree", F.col("tree.id"))


def format_paths(paths, messages, tree, node, role, text):
    """One row per path: ``tree, leaf, rank, formatted, loss_spans``.

    ``loss_spans`` are ``(start, length)`` in code points of ``formatted``,
    one for each assistant message, covering its escaped text alone.
    """
    said = messages.select(
        _key(tree), F.col(node).alias("node"), escape_role(F.col(role)).alias("role"),
        escape(F.col(text)).alias("text"),
    )
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    pieces = paths.withColumn("tree", _key("tree")).join(said, ["tree", "node"]).select(
        "tree", "leaf", "rank", "depth", head.alias("head"), "text",
        F.concat(head, F.col("text"), F.lit(END + "\n")).alias("piece"), (F.col("role") == "assistant").alias("learn"),
    )
    earlier = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("at").alias("start"), F.length("text").cast("long").alias("length"))
    rows = pieces.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), span))).alias("loss_spans"),
    )
    return rows.select(F.col("tree.id").alias("tree"), "leaf", "rank", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")


def threads(conversations, conv="conv_id", turn="turn", role="role", text="text"):
    """Rows by turn as reply trees: each message answers the one before it.

    Rows of one turn follow each other by role and text, so none is lost;
    NULL turns come first.  Adds ``node``, ``parent``, ``score``.
    """
    order = W.partitionBy(conv).orderBy(turn, role, text)
    node = F.row_number().over(order).cast("long")
    rows = conversations.select(conv, role, text, node.alias("node"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def format_trees(messages, tree, node, parent, role, text, score, best=1):
    """The ``best`` paths of each tree (all if None) as formatted conversations.

    Empty table: no rows.  NULL roles and texts are empty; messages whose tree
    id is NULL are one tree, whose id is NULL.  Extra columns are ignored.
    """
    paths = reply_paths(messages, tree, node, parent, score)
    return format_paths(best_paths(paths, best), messages, tree, node, role, text)


def read_back(formatted):
    """What a reader finds in ``formatted`` and ``loss_spans``: the turns, and the text under the mask."""
    turns = F.arrays_zip(
        F.regexp_extract_all("formatted", F.lit(MESSAGE), 1).alias("role"),
        F.regexp_extract_all("formatted", F.lit(MESSAGE), 2).alias("text"),
    )
    lines = F.transform(
        turns, lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["text"]), F.lit("\n"))
    )
    masked = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))),
    )
    return formatted.withColumns({"turns": lines, "masked": F.array_join(masked, "")})
