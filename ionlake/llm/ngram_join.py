"""N-gram Jaccard join with a token-group matrix.

Texts are sets of word shingles; two are linked at a Jaccard coefficient of ``PART / WHOLE`` or more. Texts
with equal sets are one class. The order of tokens that all sets share puts frequent tokens last, by hash
otherwise, and a set's prefix is so long that two linked sets share a token of their prefixes.

1. Linking: every class is compared with the classes that lead the prefix tokens it shares (the smallest
   member of each token and the one with most frequent tokens, as the common origin of edited copies has),
   then once more with leaders in other components; the links found join most near copies, and with them
   the groups of similar documents, at a cost in proportion to the tokens.
2. Token-group matrix: a row for each prefix token and group (a component so far, or unlinked classes
   around the leader they came nearest, in parts of bounded size), the group's token union. Matching a class's own prefix tokens with the unions of other groups gives an upper
   bound of its overlap with any member; only qualifying groups are opened, and there the union of whole
   sets bounds the overlap again before members are compared one by one.

No link between different components is lost: a linked pair shares a prefix token, and both bounds are sound.

Defined cases: texts without words have the empty set, n_shingles 0, and are linked with nothing; a row with
a null key has a null component and links nothing; rows that share a key count as one node, whatever their
texts; repeated rows stay repeated in the result; of equally good leaders the smaller key leads; very long texts are
worked through whole; columns beside key and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .shared import let_go, materialize, slices
from .shingles import shingle_sets

WIDTH, PART, WHOLE = 5, 4, 5
#: A token is frequent above this many sets; there are never more than MOST_FREQUENT such tokens.
FREQUENT, MOST_FREQUENT = 12, 400_000
#: Tokens that a task counts at a time.
COUNTED = 1_000_000
#: The bit that puts frequent tokens behind all others.
RAISED = 1 << 62
#: Members of a group's part, and queries that meet it in one task.
GROUP_MEMBERS, TASK_QUERIES = 64, 256
#: Up to this many ids (8 bytes each) the texts to compare are picked with a broadcast list, else by a shuffle.
BROADCAST_IDS = 1_000_000


def _prefix_size(n):
    """n less the least overlap with a linked set, and one more."""
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def _ordered(tokens: np.ndarray, frequent: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """Tokens as 62-bit hashes in ascending order, the frequent ones raised above all others, by tiers of frequency."""
    keys = np.unique((tokens >> np.uint64(2)).astype(np.int64))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        keys = np.sort(np.where(frequent[at] == keys, np.int64(RAISED) | (tiers[at] << np.int64(56)) | (keys >> np.int64(6)), keys))
    return keys


def _counts(docs: DataFrame, width: int) -> DataFrame:
    """(t, n): how many sets hold a token. All tokens of prefixes (in order of hashes) count, and of the others those
    that meet again within COUNTED tokens of a task: what is held by many sets is found wherever it stands in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = (counts > 1) | np.isin(tokens, np.concatenate(first))
            held.clear()
            first.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(counts[keep].astype(np.int64))], ["t", "n"])

        for batch in batches:
            for part in slices(batch.column(0), rows=256):
                for s in shingle_sets(part.to_pylist(), width):
                    keys = np.unique((s >> np.uint64(2)).astype(np.int64))
                    held.append(keys)
                    first.append(keys[: _prefix_size(len(keys))] if len(keys) else keys)
                if sum(map(len, held)) >= COUNTED:
                    yield flush()
                    let_go()
        if held:
            yield flush()
        let_go()

    return docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def _sketch(docs: DataFrame, frequent: np.ndarray, tiers: np.ndarray, width: int) -> DataFrame:
    """(id, n, digest, hub, hot, prefix) of every row; hot: how many tokens of the prefix are frequent; hub: in a thousand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), rows=256):
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                sets = [_ordered(s, frequent, tiers) for s in shingle_sets(part.to_pylist(), width)]
                prefixes = [s[: _prefix_size(len(s))] if len(s) else s for s in sets]
                hots = [int((x >= RAISED).sum()) for x in prefixes]
                hubs = [1000 * h // max(1, len(x)) for h, x in zip(hots, prefixes, strict=True)]
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), pa.array(hubs, pa.int32()), pa.array(hots, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))], ["id", "n", "digest", "hub", "hot", "prefix"])
            let_go()

    return docs.mapInArrow(run, "id long, n int, digest binary, hub int, hot int, prefix array<long>")


def _open(docs: DataFrame, wanted: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Links (u, v) between queries and members of the groups they open.

    wanted: (x, g) and members: (g, y), tables or cheap to compute. Queries of a group are dealt to tasks of about TASK_QUERIES, each with
    the group's members (at most a part's).
    """
    # a table of its own: a join of two tables can be split where one leader has very many queries
    held = materialize(wanted.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("tasks")))
    asked = wanted.join(held, "g").select("g", F.pmod(F.xxhash64("x"), "tasks").cast("int").alias("task"), F.col("x").alias("id"), F.lit(1).alias("role"))
    holding = members.join(held, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("y").alias("id"), F.lit(0).alias("role"))
    parts = materialize(asked.unionByName(holding))
    ids = parts.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, "id", "left_semi")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("id", "ascending")])
        roles, ids_ = table.column("role").to_numpy(), table.column("id").to_numpy()
        first = int(np.searchsorted(roles, 1))
        sets = shingle_sets(table.column("text").to_pylist(), width)
        inside, us, vs = sets[:first], [], []
        leader = list(range(len(sets)))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        union = np.unique(np.concatenate(inside)) if inside else np.zeros(0, dtype=np.uint64)
        for i in range(first, len(sets)):
            x = sets[i]
            known = x[np.isin(x, union, assume_unique=True)]
            if not len(x) or WHOLE * len(known) < PART * len(x):
                continue
            for j, y in enumerate(inside):
                if ids_[i] == ids_[j] or find(i) == find(j) or WHOLE * min(len(x), len(y)) < PART * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(known, y, assume_unique=True))
                if WHOLE * both >= PART * (len(x) + len(y) - both):
                    leader[find(i)] = find(j)
                    us.append(int(ids_[i]))
                    vs.append(int(ids_[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return parts.join(texts, "id").select("g", "task", "id", "role", "text").groupBy("g", "task").applyInArrow(compare, "u long, v long")


def _candidates(led: DataFrame) -> DataFrame:
    """(x, g): for each class the two leaders with most tokens in common, of those a link to is likely."""
    near = led.where(WHOLE * F.least("n", "y.n") >= PART * F.greatest("n", "y.n")).groupBy("id", "n", F.col("y.id").alias("y")).agg(F.count(F.lit(1)).alias("common"))
    near = near.where(F.col("common") * 3 >= _prefix(F.col("n")))
    best = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("common", "y")), asc=False), 1, 2).alias("best"))
    return best.select(F.col("id").alias("x"), F.explode("best.y").alias("g"))


def _as_groups(pairs: DataFrame) -> DataFrame:
    return pairs.select("g").distinct().select("g", F.col("g").alias("y"))


def _split(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Shared tokens with their component c, without the tokens that one component holds alone."""
    token = Window.partitionBy("t")
    mine = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    return mine.withColumn("c0", F.min("c").over(token)).withColumn("c1", F.max("c").over(token)).where(F.col("c0") != F.col("c1")).drop("c0", "c1")


def _qualifying(mine: DataFrame, group: Column) -> DataFrame:
    """(x, g): the groups that a class has to open, by the token-group matrix.

    A token that many prefixes hold stands behind all others in every set. Where a pair's first common token is such a
    one, all they have in common lies at it or behind it; so at these tokens a class meets a group only if what both
    have left there can still suffice. Rows at such tokens are then no count of common tokens, but a class has few of
    them in its prefix, and the bound takes them all for common.
    """
    facts = mine.select("single", "key", "part", "id", "n", "hot").distinct().groupBy("single", "key", "part")
    facts = facts.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("hot").alias("g_hot"))
    union = mine.groupBy("t", "single", "key", "part", "size", "held").agg(F.max("onward").alias("g_onward"), F.min("n").alias("g_n"))
    union = union.join(materialize(facts), ["single", "key", "part"])
    matrix = union.select("t", group.alias("g"), F.col("size").alias("g_size"), F.col("held").alias("g_held"), "least", "most", "g_hot", "g_onward", "g_n")
    names = {"id": "x", "n": "x_n", "c": "x_c", "size": "x_size", "key": "x_key", "hot": "x_hot", "onward": "x_onward"}
    q = mine.select("t", *(F.col(a).alias(b) for a, b in names.items()))
    # smaller components ask larger ones; single classes also ask each other's groups, in one direction
    larger = ~F.col("g.single") & (F.col("x_c") != F.col("g.key")) & (F.struct("x_size", "x_c") < F.struct("g_size", "g.key"))
    peers = F.col("g.single") & (F.col("x_size") == 1) & ((F.col("x_key") < F.col("g.key")) | ((F.col("x_key") == F.col("g.key")) & (F.col("g_held") > 1)))
    alike = (WHOLE * F.col("x_n") >= PART * F.col("least")) & (PART * F.col("x_n") <= WHOLE * F.col("most"))
    needed = PART * (F.col("x_n") + F.col("g_n"))  # (WHOLE + PART) times the overlap that a link takes
    left = ((WHOLE + PART) * F.col("x_onward") >= needed) & ((WHOLE + PART) * F.col("g_onward") >= needed)
    met = q.join(matrix, "t").where((larger | peers) & alike & ((F.col("t") < RAISED) | left))
    met = met.groupBy("x", "g", "x_n", "x_hot", "least", "most", "g_hot").agg(F.count_if(F.col("t") < RAISED).alias("common"))
    slack = lambda n: n - _prefix(n)
    most = F.col("common") + F.least("x_hot", "g_hot") + F.greatest(slack(F.col("x_n")), slack(F.col("most")))
    return met.where((WHOLE + PART) * most >= PART * (F.col("x_n") + F.col("least"))).select("x", "g")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the smallest key reachable by links."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    # tokens that many sets hold
    many = materialize(_counts(rows, width).where(F.col("n") > FREQUENT))
    bound, level = many.count(), FREQUENT
    while bound > MOST_FREQUENT:
        level *= 2
        bound = many.where(F.col("n") > level).count()
    found = sorted((r["t"], r["n"]) for r in many.where(F.col("n") > level).toLocalIterator())
    frequent = np.array([t for t, _ in found], dtype=np.int64)
    tiers = np.array([min(63, n.bit_length()) for _, n in found], dtype=np.int64)

    sketch = materialize(_sketch(rows, frequent, tiers, width))
    linkable = sketch.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = materialize(linkable.groupBy("digest").agg(F.min(F.struct("id", "n", "hub", "hot", "prefix")).alias("c")).select("digest", "c.id", "c.n", "c.hub", "c.hot", "c.prefix"))

    token = Window.partitionBy("t")
    shared = classes.select("id", "n", "hub", "hot", F.posexplode("prefix").alias("p", "t")).withColumn("held", F.count(F.lit(1)).over(token))
    # onward: how much of the set lies at the token and behind it
    shared = materialize(shared.where(F.col("held") > 1).select("t", "id", "n", "hub", "hot", (F.col("n") - F.col("p")).alias("onward")))

    # 1. linking with leaders, then with leaders of other components
    led = shared.withColumn("low", F.min(F.struct("id", "n")).over(token)).withColumn("top", F.max(F.struct("hub", (-F.col("id")).alias("o"), "id", "n")).over(token))
    led = led.select("id", "n", F.explode(F.array("low", F.struct("top.id", "top.n"))).alias("y"))
    pairs = materialize(_candidates(led.where(F.col("id") != F.col("y.id"))))
    links = materialize(_open(rows, pairs, _as_groups(pairs), width))
    mine = _split(shared, connected(links))
    lead = F.struct("hub", (-F.col("id")).alias("o"), "id", "n", "c")
    mine = mine.withColumn("a", F.max(lead).over(token)).withColumn("b", F.max(F.when(F.col("c") != F.col("a.c"), lead)).over(token))
    led = mine.select("id", "n", F.when(F.col("c") != F.col("a.c"), F.col("a")).otherwise(F.col("b")).alias("y"))
    again = materialize(_candidates(led).join(pairs, ["x", "g"], "left_anti"))
    first = materialize(links.unionByName(_open(rows, again, _as_groups(again), width)))
    tried = pairs.unionByName(again)
    labels = connected(first)

    # 2. the token-group matrix: groups are components so far, and single classes around the leader they came nearest
    sizes = materialize(labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("component", "c"))
    around = tried.groupBy("x").agg(F.min("g").alias("near")).withColumnRenamed("x", "id")
    mine = _split(shared, labels).join(sizes, "c", "left").join(around, "id", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    mine = materialize(mine.withColumn("single", F.col("size") == 1).withColumn("key", F.when(F.col("single"), F.coalesce("near", "c")).otherwise(F.col("c"))).drop("near"))
    held = mine.select("single", "key", "id").distinct().groupBy("single", "key").agg(F.count(F.lit(1)).alias("held"))
    mine = mine.join(materialize(held), ["single", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("held") / GROUP_MEMBERS)).cast("int"))
    mine = materialize(mine)
    group = F.struct("single", "key", "part")
    opened = materialize(_qualifying(mine, group))
    members = mine.select(group.alias("g"), F.col("id").alias("y")).distinct()
    second = materialize(_open(rows, opened, members, width))

    # a key with several sets ties their classes together
    known = sketch.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    several = materialize(known.where(F.col("a") != F.col("b")).select("id"))
    ties = several.join(linkable.select("id", "digest").distinct(), "id").join(classes.select("digest", F.col("id").alias("v")), "digest")
    ties = materialize(ties.select(F.col("id").alias("u"), "v", "digest"))
    tied = bool(ties.take(1))
    final = connected(first.unionByName(second).unionByName(ties.select("u", "v"))) if tied or second.take(1) else labels
    named = classes.select("digest", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    named = materialize(named)
    out = sketch.select("id", "n", "digest").join(named, "digest", "left")
    if tied:  # also for such a key's texts without words
        whole = materialize(ties.join(named, "digest").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("whole")))
        out = out.join(whole, "id", "left").withColumn("component", F.coalesce("whole", "component"))
        alone = F.col("id").isNull() | ((F.col("n") == 0) & F.col("whole").isNull())
    else:
        alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def _prefix(n):
    """The prefix size as a column."""
    return n - F.ceil(F.lit(PART) * n / WHOLE) + 1


def _smallest(docs: DataFrame, *before: str) -> Column:
    """Of the structs ``row`` of docs' columns the smallest, by other columns first; maps, which have no order, are
    compared as JSON."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    if not maps:
        return F.min(F.struct(*before, "row"))["row"]
    order = [F.to_json(F.struct(F.col(f"row.`{c}`"))) if c in maps else F.col(f"row.`{c}`") for c in docs.columns]
    return F.min_by("row", F.struct(*before, *order))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One document of each group: the one whose key is its component's smallest (of several rows with that key
    the smallest row), and all rows with a null key. Where a key has different texts, each (key, text) is a document
    of its own and each group keeps its smallest, so that no text goes because another one of its key is a near copy."""
    said = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("kept"), F.xxhash64(F.col(text)).alias("h"))
    if said.groupBy("kept").agg(F.min("h").alias("a"), F.max("h").alias("b")).where(F.col("a") != F.col("b")).take(1):
        return _deduplicated_texts(docs, key, text, width)
    found = similar_components(docs, key, text, width)
    keep = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    names = [f"`{c}`" for c in docs.columns]
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("kept"), F.struct(*names).alias("row"))
    once = known.join(materialize(keep.withColumnRenamed(key, "kept")), "kept", "left_semi").groupBy("kept").agg(_smallest(docs).alias("row"))
    return once.select(*(F.col(f"row.{c}") for c in names)).union(docs.where(F.col(key).isNull()).select(*names))


def _deduplicated_texts(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """deduplicated where keys have different texts: nodes are the hashes of (key, text)."""
    names = [f"`{c}`" for c in docs.columns]
    known = docs.where(F.col(key).isNotNull()).select(F.xxhash64(key, text).alias("node"), F.col(text).alias("text"), F.col(key).alias("kept"), F.struct(*names).alias("row"))
    found = materialize(similar_components(known.select("node", "text"), "node", "text", width).select("node", "component_id").distinct())
    once = known.join(found, "node").groupBy("component_id").agg(_smallest(docs, "kept").alias("best"))
    return once.select(*(F.col(f"best.{c}") for c in names)).union(docs.where(F.col(key).isNull()).select(*names))
