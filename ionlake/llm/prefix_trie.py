"""A trie of conversation prefixes, built as a burst trie.

A conversation is the sequence of its turns' ids (128 bits of a SHA-256 of role and text). Equal sequences are one suffix with
a number of members, so groups of copies cost one row. Suffixes lie in containers under trie heads, the root
container first. A container of more than ``most`` suffixes bursts: the turns that all its suffixes begin with become a chain
of nodes, and the next turn's id deals the rest to new containers; this goes on, for all oversized containers at
once, until none is left. The remaining containers are sorted by their turn ids and swept once, a stack of open nodes at
a time. Sums over subtrees come up from swept containers to burst ones, latest bursts first.

Bounds: a conversation's ids (24 bytes a turn) are held in one row; a task of the sweep holds the open nodes of one
container, which has ``most`` suffixes at most, and streams over its rows. What every burst container
shares is one row each, joined by broadcast while there are at most MOST_BROADCAST. The members that end at a
node are put in order by ranges of ids and hashed as a stream, a range after the other, so that no group of copies
is held as a whole.

Defined cases: null turns come first, equal turns are ordered by their ids; null role and text are empty; rows without
conv_id take no part; repeated rows are turns of their own; a conversation without turns is a member of the root; an empty
table gives no nodes; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Suffixes of a container that is swept, at most.
MOST_SUFFIXES = 256
#: Burst containers whose rows are broadcast: about 20 MB.
MOST_BROADCAST = 100_000
#: Conversations of a range in which the members of a node are put in order, about.
RANGE_ROWS = 100_000
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE_SHA = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table (conv_id, turn, role, text): arrays of (id, words) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tid = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    held = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", tid.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    got = held.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def share_heads(convs: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Conversation c with its first h = crc32(c) % most turns replaced by those of conversation c - c % block (none
    where that is missing)."""
    c = F.col("conv_id")
    heads = convs.where(c % block == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    held = convs.withColumn("h", F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int")).withColumn("base", c - c % block).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    kept = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    return held.select("conv_id", F.concat(kept, own).alias("turns"))


def _ends(members: DataFrame, rows: int) -> DataFrame:
    """(seq, ends) of (seq, conv_id): the SHA-256 of each group's ids in order, comma-joined."""
    ranges = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    held = members.repartitionByRange(ranges, "conv_id").select("seq", "conv_id", F.spark_partition_id().alias("range"))
    held = held.groupBy("seq", "range").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = seq, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], ["seq", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["seq", "ends"])

    return held.repartition("seq").sortWithinPartitions("seq", "range").select("seq", "ids").mapInArrow(run, "seq string, ends string")


def _beside(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row a container, broadcast where it is small."""
    return rows.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few, on, how)


def _common(a: Column, b: Column) -> Column:
    """The number of first elements that two arrays share."""
    differ = F.filter(F.transform(a, lambda x, i: F.when(F.get(b, i) == x, F.lit(None)).otherwise(i)), lambda x: x.isNotNull())
    return F.coalesce(F.get(differ, F.lit(0)), F.size(a))


def _burst(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, rows): one row a container with what its suffixes share, and the suffixes dealt to new containers."""
    heads = rows.groupBy("container").agg(
        F.min("up").alias("up"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("own").alias("own"), F.min("first").alias("head_first"), F.sum("n").alias("head_n"),
        F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("words", "ids").alias("low_words"))
    k = _common(F.col("low"), F.col("high"))
    heads = heads.withColumn("k", k).withColumn("chain", F.concat(F.array("own"), F.slice("low_words", 1, F.col("k")))).drop("low_words")
    # the least suffix is the one that ends with the chain, if any does
    heads = heads.withColumn("stops", F.size("low") == F.col("k")).drop("low", "high")
    heads = materialize(heads)
    met = _beside(rows.drop("up", "parent"), heads.select("container", "k", "head_first"), "container")
    k, ids = F.col("k"), F.col("ids")
    rest = met.where(F.size(ids) > k).select(
        F.md5(F.concat(F.col("container").cast("binary"), F.get(ids, k))).alias("container"), F.col("container").alias("up"), F.col("head_first").alias("parent"), (F.col("depth") + k + 1).alias("depth"),
        F.get("words", k).alias("own"), "first", "n", "ends", F.slice(ids, k + 2, F.greatest(F.size(ids), F.lit(1))).alias("ids"), F.slice("words", k + 2, F.greatest(F.size(ids), F.lit(1))).alias("words"))
    ended = met.where(F.size(ids) == k).select("container", "ends")
    return heads.join(ended, "container", "left"), materialize(rest)


class _Node:
    __slots__ = ("depth", "words", "n", "first", "ends", "children", "leaves", "saved", "below")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.n, self.first, self.ends = depth, words, 0, None, NONE_SHA
        self.children = self.leaves = self.saved = 0
        self.below: list[_Node] = []

    def add(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None or first < self.first else self.first

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.words

    def take(self, child: _Node) -> None:
        child.close()
        self.add(child.n, child.first)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved
        self.below.append(child)

    def row(self, parent: int | None) -> tuple:
        return self.first, self.depth, parent, self.n, self.children, self.leaves, self.saved, self.ends


def _swept(rows: DataFrame) -> DataFrame:
    """The nodes of all containers, from their suffixes in order; ``up`` is set at a container's head."""
    names = ["container", "up", "parent", "depth", "own", "first", "n", "ends", "ids", "words"]
    kind = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("up", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container = up = parent = None
        path: list[bytes] = []
        stack: list[_Node] = []
        out: list[tuple] = []

        def shut(keep: int) -> None:
            """Close the open nodes beyond the first ``keep``; a node's children are handed on when it knows its first member."""
            while len(stack) > keep:
                node = stack.pop()
                if stack:
                    stack[-1].take(node)
                else:
                    node.close()
                    out.append((*node.row(parent), up))
                out.extend((*child.row(node.first), None) for child in node.below)
                node.below = []

        for batch in batches:
            for c, u, p, depth, own, first, n, ends, ids, words in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if c != container:
                    shut(0)
                    container, up, parent, path = c, u, p, []
                    stack.append(_Node(depth, own))
                same = 0
                while same < len(path) and same < len(ids) and path[same] == ids[same]:
                    same += 1
                shut(same + 1)
                for i in range(same, len(ids)):
                    stack.append(_Node(depth + 1 + i, words[i]))
                path = ids
                stack[-1].add(n, first)
                stack[-1].ends = ends
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(kind)], schema=kind)
            out.clear()
        shut(0)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(kind)], schema=kind)

    return rows.repartition("container").sortWithinPartitions("container", "ids").select(*names).mapInArrow(run, f"{NODE}, up string")


def prefix_nodes(convs: DataFrame, most: int = MOST_SUFFIXES) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), with the columns of NODE. conv_id and depth name a node: its smallest
    member, which belongs to one node a depth."""
    if most < 1:
        raise ValueError("prefix_nodes: a container holds one suffix at least")
    ids = F.transform("turns", lambda t: t["id"])
    seq = F.sha2(F.array_join(F.transform(ids, lambda x: F.hex(x)), ",").cast("binary"), 256)
    held = materialize(convs.select("conv_id", seq.alias("seq"), ids.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words")))
    # a hash stands for its sequence; only one copy of this moves on
    distinct = held.groupBy("seq").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"), F.first("words").alias("words"))
    distinct = distinct.join(_ends(held.select("seq", "conv_id"), held.count()), "seq")
    root = (F.lit("root").alias("container"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("own"))
    rows = materialize(distinct.select(*root, "first", "n", "ends", "ids", "words"))
    rests, rounds = [], []
    while True:
        # the first round has the root alone; later ones all containers of more than ``most`` suffixes
        large = materialize(rows.groupBy("container").agg(F.count(F.lit(1)).alias("suffixes")).where(F.col("suffixes") > (most if rounds else 1)).select("container"))
        if large.isEmpty():
            rests.append(rows)
            break
        few = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
        rests.append(rows.join(few, "container", "left_anti"))
        heads, rows = _burst(rows.join(few, "container", "left_semi"))
        rounds.append(heads)
    rest = rests[0]
    for r in rests[1:]:
        rest = rest.unionByName(r)
    nodes = materialize(_swept(rest))
    total = lambda df: df.where(F.col("up").isNotNull()).groupBy("up").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    below = [total(nodes.select("up", "n_leaves", "saved_tokens"))]
    out = [nodes.drop("up")]
    for heads in reversed(rounds):
        sums = below[0]
        for b in below[1:]:
            sums = sums.unionByName(b)
        sums = sums.groupBy(F.col("up").alias("container")).agg(F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        held = heads.join(sums, "container", "left").select("*", zero("children").alias("kids"), F.greatest(zero("leaves"), F.lit(1).cast("long")).alias("n_leaves"), zero("saved").alias("under"))
        at = held.select("*", F.posexplode("chain").alias("j", "w"))
        last = F.col("j") == F.col("k")
        saved = F.col("under") + (F.col("head_n") - 1) * F.aggregate(F.slice("chain", F.col("j") + 1, F.size("chain")), F.lit(0).cast("long"), lambda x, y: x + y)
        found = materialize(at.select(
            F.col("head_first").alias("conv_id"), (F.col("depth") + F.col("j")).alias("depth"), F.when(F.col("j") > 0, F.col("head_first")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("head_n").alias("n_convs"),
            F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last & F.col("stops"), F.col("ends")).otherwise(F.lit(NONE_SHA)).alias("ends_sha256"),
            F.when(F.col("j") == 0, F.col("up")).alias("up")))
        below.append(total(found.select("up", "n_leaves", "saved_tokens")))
        out.append(found.drop("up"))
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result.withColumn("depth", F.col("depth").cast("long"))
