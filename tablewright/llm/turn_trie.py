"""The prefix trie of conversations: ternary search trees on ranges of them.

Distinct turns are numbered in a dictionary, so a conversation is a sequence of
numbers.  Distinct sequences, each with its number of conversations, are sorted
and cut into range shards.  A task builds a ternary search tree of a shard:
the letters are turn numbers, and sequences go in from the median outwards, so
that the search trees under each node are balanced.  A traversal with its own
stack adds up members, leaves and savings from the leaves to the root.

A node whose sequence starts the last conversation of a shard and the first of
the next one is in both trees.  Each shard knows how many turns it shares with
its neighbours, so exactly one of them, the first, counts such a node as a child
and takes off its one unsaved copy; sums over shards then give the node's own
numbers.  Only nodes on these borders are merged.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.llm.hot import attach
from tablewright.plans.lineage import cut

SHARD = 200_000  # turns of distinct sequences that a shard has on average
FEW = 1_000_000  # border nodes up to which their names go to every task (about 50 MB)
NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """``id, part, seq (array<long>), cost (array<int>)``: each conversation as turn numbers and words of the texts.

    Turns are in order, NULL first, equal ones by the SHA-256 of role and text;
    a repeated row is a turn of its own.  NULL role and text are empty.  Rows
    without an id belong to no conversation.  ``part`` rises with the id: ids of
    a part are all larger than those of the parts before it.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = cut(
        conversations.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(said.cast("binary"), 256)).alias("said"),
            F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("cost"),
        )
    )
    names = rows.groupBy("said").agg(F.count(F.lit(1)).alias("n"))
    names = cut(names.withColumn("number", F.monotonically_increasing_id()))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "said", "number", "cost")
    held = attach(rows, names, "said", "n", rows.count())
    whole = held.repartitionByRange("id").groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return cut(
        whole.select(
            "id", F.spark_partition_id().alias("part"), F.col("turns.number").alias("seq"), F.col("turns.cost").alias("cost")
        )
    )


def spliced(seqs, base, heads, most):
    """Sequences that start with the first ``heads`` turns (``most`` at most) of the conversation ``base``.

    Then come a conversation's own turns after its first ``heads``; a base that
    does not exist gives none.  ``base`` and ``heads`` are expressions of ``id``.
    """
    start = seqs.select(F.col("id").alias("base"), F.slice("seq", 1, most).alias("b_seq"), F.slice("cost", 1, most).alias("b_cost"))
    own = seqs.withColumn("base", base).withColumn("h", heads.cast("int"))
    both = own.join(start, "base", "left")

    def joined(head, tail):
        empty = F.array().cast("array<int>" if tail == "cost" else "array<long>")
        return F.concat(F.slice(F.coalesce(F.col(head), empty), F.lit(1), F.col("h")), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail), F.lit(1))))

    return both.select("id", "part", joined("b_seq", "seq").alias("seq"), joined("b_cost", "cost").alias("cost"))


def distinct_sequences(seqs):
    """``seq, cost, n, least, ends``: distinct sequences, their members, and the digest of the sorted ids.

    Ids of a sequence are first joined for each part; the parts' texts go in
    order through one SHA-256, so no task holds the ids of a frequent sequence.
    """

    def run(batches):
        now, state = None, None
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns])
            out = []
            for same, ids, seq, cost, n, least in rows:
                if same != now:
                    if state:
                        out.append(finish(state))
                    now, state = same, [seq, cost, 0, least, hashlib.sha256()]
                    state[4].update(ids.encode())
                else:
                    state[4].update(b"," + ids.encode())
                state[2] += n
                state[3] = min(state[3], least)
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if state:
            yield pa.RecordBatch.from_pylist([finish(state)], schema=kinds)

    def finish(state):
        return {"seq": state[0], "cost": state[1], "n": state[2], "least": state[3], "ends": state[4].hexdigest()}

    kinds = pa.schema(
        [("seq", pa.list_(pa.int64())), ("cost", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())]
    )
    same = F.unhex(F.sha2(F.array_join(F.col("seq").cast("array<string>"), ",").cast("binary"), 256))
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    packed = seqs.withColumn("same", same).groupBy("same", "part").agg(
        ids.alias("ids"), F.first("seq").alias("seq"), F.first("cost").alias("cost"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least")
    )
    rows = packed.repartition("same").sortWithinPartitions("same", "part").select("same", "ids", "seq", "cost", "n", "least")
    return rows.mapInArrow(run, "seq array<long>, cost array<int>, n long, least long, ends string")


class Tree:
    """A ternary search tree of number sequences; node 0 is the root of the trie."""

    def __init__(self):
        self.letter, self.less, self.more, self.below = [None], [-1], [-1], [-1]
        self.up, self.depth, self.cost = [-1], [0], [0]
        self.n, self.least, self.ends = [0], [None], [None]

    def _new(self, letter, up, cost):
        self.letter.append(letter)
        for links in (self.less, self.more, self.below):
            links.append(-1)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.cost.append(cost)
        self.n.append(0)
        self.least.append(None)
        self.ends.append(None)
        return len(self.letter) - 1

    def insert(self, seq, cost, n, least, ends):
        at = 0
        self._count(at, n, least)
        for letter, words in zip(seq, cost):
            u = self.below[at]
            if u < 0:
                u = self.below[at] = self._new(letter, at, words)
            while self.letter[u] != letter:
                links = self.less if letter < self.letter[u] else self.more
                if links[u] < 0:
                    links[u] = self._new(letter, at, words)
                u = links[u]
            at = u
            self._count(at, n, least)
        self.ends[at] = ends

    def _count(self, at, n, least):
        self.n[at] += n
        if self.least[at] is None or least < self.least[at]:
            self.least[at] = least

    def path(self, seq):
        """The nodes of a sequence that is in the tree, the root first."""
        nodes, at = [0], 0
        for letter in seq:
            at = self.below[at]
            while self.letter[at] != letter:
                at = self.less[at] if letter < self.letter[at] else self.more[at]
            nodes.append(at)
        return nodes

    def order(self):
        """All nodes, each after its parent."""
        stack, found = [0], []
        while stack:
            at = stack.pop()
            found.append(at)
            u = self.below[at]
            search = [u] if u >= 0 else []
            while search:
                u = search.pop()
                stack.append(u)
                search += [x for x in (self.less[u], self.more[u]) if x >= 0]
        return found


def medians(n):
    """0 to n - 1, the middle of each stretch before its halves."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            mid = (a + b) // 2
            yield mid
            spans += [(a, mid), (mid + 1, b)]


def shard_nodes(rows, before, after):
    """Rows of the nodes of a shard's sorted sequences ``(seq, cost, n, least, ends)``.

    ``before`` and ``after`` are the numbers of turns that the first sequence
    shares with the shard before and the last one with the shard after, -1
    without such a shard.  A row: ``key`` (border nodes), ``conv_id, depth,
    n_convs, n_children, n_leaves, saved_tokens, ends, up_key, up_conv``.
    """
    tree = Tree()
    for i in medians(len(rows)):
        tree.insert(*rows[i])
    first, last = tree.path(rows[0][0])[: before + 1], tree.path(rows[-1][0])
    goes_on = last[-1] if after == len(rows[-1][0]) else -1
    keys = {}
    for nodes in (first, last[: after + 1]):
        sha = hashlib.sha256()
        for v in nodes:
            sha.update(b"%d," % tree.letter[v] if v else b"")
            keys[v] = sha.digest()
    counted_before = set(first)
    size = len(tree.n)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    order = tree.order()
    for v in reversed(order):
        if tree.below[v] < 0 and v != goes_on:
            leaves[v] = 1
        saved[v] += (tree.n[v] - (v not in counted_before)) * tree.cost[v]
        p = tree.up[v]
        if p >= 0:
            children[p] += v not in counted_before
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    for v in order:
        p = tree.up[v]
        yield (
            keys.get(v), tree.least[v], tree.depth[v], tree.n[v], children[v], leaves[v], saved[v], tree.ends[v],
            keys.get(p), tree.least[p] if p >= 0 and p not in keys else None,
        )


NODE = "key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, up_key binary, up_conv long"


def _shared(one, other):
    """How many leading elements two arrays share; -1 if the other one is NULL."""
    differs = F.array_position(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(F.col(other).isNull(), -1).when(differs > 0, differs - 1).otherwise(F.size(one)).cast("int")


def trie(seqs, shards=None):
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``seqs``: rows of ``id (long), part, seq, cost`` as from ``sequences``.  A
    node is a distinct sequence of the first ``depth`` turns, its members are the
    conversations that start with it, empty ones in the root only; ``conv_id`` is
    the smallest.  ``saved_tokens`` sums over the subtree, the node included,
    members less one times words of the last text.  ``ends_sha256`` is the
    digest of the ids of the members that end there.  No conversations give no
    nodes.  A task holds one shard; a sequence is never cut, so the longest
    conversation has to fit (12 bytes a turn).
    """
    spark = seqs.sparkSession
    found = cut(distinct_sequences(seqs))
    turns = found.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    if not shards:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD))
    dealt = cut(found.repartitionByRange(shards, "seq").withColumn("shard", F.spark_partition_id()))
    # one row a shard
    ends = dealt.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    row = Window.orderBy("shard")
    ends = ends.select("shard", "first", "last", F.lag("last").over(row).alias("old"), F.lead("first").over(row).alias("new"))
    ends = cut(ends.select("shard", _shared("first", "old").alias("before"), _shared("last", "new").alias("after")))

    def run(batches):
        now, rows, edge = None, [], None
        for batch in batches:
            for shard, before, after, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != now:
                    if rows:
                        yield from tables(rows, *edge)
                    now, rows, edge = shard, [], (before, after)
                rows.append(row)
        if rows:
            yield from tables(rows, *edge)

    def tables(rows, before, after):
        out = []
        for row in shard_nodes(rows, before, after):
            out.append(dict(zip(names, row)))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    types = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = pa.schema([(f.split()[0], types[f.split()[1]]) for f in NODE.split(", ")])
    sent = dealt.join(F.broadcast(ends), "shard").repartition(shards, "shard").sortWithinPartitions("shard", "seq")
    nodes = cut(sent.select("shard", "before", "after", "seq", "cost", "n", "least", "ends").mapInArrow(run, NODE))
    border = nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends"), F.first("up_key").alias("up_key"), F.first("up_conv").alias("up_conv"),
    )
    border = cut(border)
    names_of = border.select(F.col("key").alias("up_key"), F.col("conv_id").alias("up_name"))
    if border.count() <= FEW:
        names_of = F.broadcast(names_of)
    whole = nodes.where("key IS NULL").unionByName(border).join(names_of, "up_key", "left")
    return whole.select(
        "conv_id", "depth", F.coalesce("up_name", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
    )
