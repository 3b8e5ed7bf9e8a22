"""Mixing sources to target weights, with DataFrame operations only.

Every source's words, document after document, are packed into blocks of a fixed number of words. Source
weights become word targets (a source gives at most ``most_repeats`` times its own words; what lies above is
shared out again by weight), targets become numbers of blocks. Each output shard's source counts are one multinomial
draw: every slot of the shard draws a source by a seeded hash. A source's slots over all shards are numbered and sent
through a pseudorandom permutation of their numbers. Drawn more often than its target has it, a source gives up the slots
whose place lies beyond the target, wherever they are, to sources drawn too seldom; so the totals meet the targets. A
slot's place, modulo the source's number of blocks, is its block, and blocks are joined by source and number.

The permutation is swap-or-not: in each round x and its partner (key - x) mod n change places if a hash bit
of their larger one says so; a bijection on any range.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source of its own, last in
order; an empty table gives no rows; a source without words has target 0; rows with equal keys are ordered by size and a
hash of the text, repeated rows count each for itself; sources whose share is under half a block may take nothing; very
long texts are counted whole; columns beside key, text and source are not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS = 64, 1024
ROUNDS = 20
#: Shards whose counts are summed up together.
SHARD_GROUP = 1024
#: Rows that share a packing bucket, about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256


class Mix(NamedTuple):
    documents: DataFrame  # one row a document: doc_id, size, source_size, target, taken; if carried rid and spans
    counts: DataFrame  # shard, source_no, n: the draws
    sources: DataFrame  # source, source_no, source_size, weight, target, blocks, slots
    rows: DataFrame  # if carried: rid and the struct row of all columns of docs


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """x's place in a pseudorandom permutation of 0 to n - 1 named by the key."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(r, key), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, partner), r, key).bitwiseAND(1) == 1, partner).otherwise(at)

    return F.aggregate(F.array(*(F.lit(r + 1).cast("long") for r in range(rounds))), x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most_repeats: float) -> DataFrame:
    """(source, source_no, source_size, weight, target): the water level of capped shares.

    One row a source; windows over all of them run in one task, which grows with the number of sources only.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    listed = sizes.withColumn("source_no", F.row_number().over(in_order) - 1)
    listed = listed.withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")))
    full = listed.withColumn("most", F.col("source_size") * F.lit(float(most_repeats))).withColumn("level", F.col("most") / F.col("weight"))
    # sources fill up in order of their level; the water level is the first that the next source does not fill at
    rising = Window.orderBy("level", "source_no")
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    wanted = F.sum("source_size").over(everywhere) * F.lit(float(total_share))
    full = full.withColumn("water", (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    full = full.withColumn("open", F.col("water") <= F.col("level")).withColumn("water", F.min(F.when(F.col("open"), F.struct("level", "source_no", "water"))).over(everywhere)["water"])
    return full.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most")))).select("source", "source_no", "source_size", "weight", "target")


#: Into how many cells numbers are cut, about, to find the range that holds one by a join on equality.
CELLS = 4096


def _cell(x: Column, total: int) -> Column:
    return F.floor(x / max(1, -(-total // CELLS)))


def _in_cells(ranges: DataFrame, first: str, n: str, total: int) -> DataFrame:
    """Each range in every cell that it reaches into."""
    return ranges.withColumn("cell", F.explode(F.sequence(_cell(F.col(first), total), _cell(F.col(first) + F.col(n) - 1, total))))


def _within(x: Column, first: str, n: str) -> Column:
    return (x >= F.col(first)) & (x < F.col(first) + F.col(n))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most_repeats: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False, seed: int = 1) -> Mix:
    """Plan the mix. ``carry`` writes the rows of docs beside a row number, to find them again; whole
    rows take no part in the work in between."""
    extra = [F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rid = ["rid"] if carry else []
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("h"), *extra)
    base = materialize(sized)  # texts are read and counted once
    sized = base.drop("row")
    n = sized.count()
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    groups = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, total_share, most_repeats)
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    targets = targets.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long"))
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = materialize(targets.withColumn("first_slot", F.coalesce(F.sum("slots").over(ahead), F.lit(0)).cast("long")))

    # packing: a document's first word within its source, by the words of earlier buckets and of its own
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(sources.select(F.col("source").alias("s"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select("source_no", "source", "bucket", "base", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    held = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # groups are at most sources x buckets rows
    placed = held.alias("d").join(starts.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.bucket") == F.col("g.bucket")))
    placed = materialize(placed.select("d.doc_id", "source_no", "size", "source_size", "target", (F.col("base") + F.col("within")).alias("first_word"), *rid))

    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    spark = docs.sparkSession
    slots = spark.range(total).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("drawn"))
    ranges = _in_cells(sources.where(F.col("slots") > 0), "first_slot", "slots", total).select("source_no", "first_slot", "slots", "cell")
    draws = slots.withColumn("cell", _cell(F.col("drawn"), total)).join(ranges, "cell").where(_within(F.col("drawn"), "first_slot", "slots"))
    draws = materialize(draws.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("shard") / SHARD_GROUP)))
    whole = materialize(draws.groupBy("source_no", "group").agg(F.sum("n").alias("n")))
    drawn = whole.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    met = sources.join(drawn, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    met = met.withColumn("over", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).withColumn("short", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before")
    met = materialize(met.select("source_no", "blocks", "slots", "drawn", "over", "short", before("over"), before("short")))
    # a source's slots are numbered over all shards: sums of groups of shards, then within the group
    earlier = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups_ = whole.select("source_no", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = draws.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups_, ["source_no", "group"]).join(met, "source_no")
    first = F.col("base") + F.col("first")
    numbered = numbered.select("shard", "source_no", "blocks", "slots", "drawn", "over_before", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("k"))
    placed_slots = materialize(numbered.select("shard", "source_no", "blocks", "slots", "over_before", permuted(F.col("k"), F.col("drawn"), F.col("source_no") + seed).alias("place")))
    kept = placed_slots.where(F.col("place") < F.col("slots")).select("shard", "source_no", (F.col("place") % F.col("blocks")).alias("block"))
    given_up = placed_slots.where(F.col("place") >= F.col("slots")).select("shard", (F.col("over_before") + F.col("place") - F.col("slots")).alias("r"))
    short = _in_cells(met.where(F.col("short") > 0), "short_before", "short", total).select("source_no", "blocks", "drawn", "short_before", "short", "cell")
    moved = given_up.withColumn("cell", _cell(F.col("r"), total)).join(short, "cell").where(_within(F.col("r"), "short_before", "short"))
    moved = moved.select("shard", "source_no", ((F.col("drawn") + F.col("r") - F.col("short_before")) % F.col("blocks")).alias("block"))
    dealt = kept.unionByName(moved)
    counts = dealt.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))
    uses = dealt.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("copies"))

    # documents meet the blocks that their words lie in
    last_word = F.col("first_word") + F.col("size") - 1
    spans = placed.where(F.col("size") > 0).select("source_no", "first_word", "size", F.explode(F.sequence(F.floor(F.col("first_word") / BLOCK_WORDS), F.floor(last_word / BLOCK_WORDS))).alias("block"))
    a = F.greatest(F.col("first_word"), F.col("block") * BLOCK_WORDS)
    b = F.least(last_word + 1, (F.col("block") + 1) * BLOCK_WORDS)
    met = spans.join(uses, ["source_no", "block"]).select("source_no", "first_word", F.struct((a - F.col("first_word")).alias("at"), (b - a).alias("words"), "copies").alias("span"))
    if carry:
        got = met.groupBy("source_no", "first_word").agg(F.sum(F.col("span.words") * F.col("span.copies")).alias("taken"), F.array_sort(F.collect_list("span")).alias("spans"))
    else:
        got = met.groupBy("source_no", "first_word").agg(F.sum(F.col("span.words") * F.col("span.copies")).alias("taken"))
    # rows of size 0 share their first word with the next document and take nothing
    got = got.withColumn("some", F.lit(True))
    out = placed.withColumn("some", F.col("size") > 0).join(got, ["source_no", "first_word", "some"], "left")
    documents = out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *([*rid, "spans"] if carry else []))
    return Mix(documents, counts, sources, base.select("rid", "row") if carry else base)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, the text of each row being the words that the mix takes of it, in their order and with all that
    stands between them in the text: a text whose words are all taken once stays as it is, to the last blank. A word
    brings what follows it up to the next word, but for the last one taken, unless it ends the text; the text's first word also
    brings what stands before it. Words taken a second time follow behind a blank, in the same way. Rows without any word
    taken are left out."""
    text, chars = how.get("text", "text"), "n_chars"
    plan = mix(docs, carry=True, **how)
    own = F.col(f"row.`{text}`")
    gaps = F.split(own, WORD, -1)  # one more than there are words
    pieces = F.zip_with(F.regexp_extract_all(own, F.lit(f"({WORD})"), F.lit(1)), F.slice("gaps", 2, F.size("gaps")), lambda w, g: F.concat(w, g))
    cut = lambda spans: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(F.col("pieces"), (s["at"] + 1).cast("int"), s["words"].cast("int")))), "")
    ends = lambda spans: F.element_at(spans, -1)["at"] + F.element_at(spans, -1)["words"] == F.size("pieces")
    shut = lambda spans: F.when(ends(spans), cut(spans)).otherwise(F.regexp_replace(cut(spans), r"[\x20\x09-\x0D]+\z", ""))
    whole = lambda spans: F.concat(F.when(F.get(spans, F.lit(0))["at"] == 0, F.get("gaps", F.lit(0))).otherwise(""), shut(spans))
    again = F.filter("spans", lambda s: s["copies"] > 1)
    mixed = F.concat(whole(F.col("spans")), F.when(F.size(again) > 0, F.concat(F.lit(" "), whole(again))).otherwise(""))
    out = plan.documents.where(F.col("taken") > 0).select("rid", "spans").join(plan.rows, "rid").withColumn("gaps", gaps).withColumn("pieces", pieces).withColumn("mixed", mixed)
    new = {text: F.col("mixed")} | ({chars: F.length("mixed").cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
