"""Document fingerprints by SpotSigs.

At every common word (an anchor) a signature starts: the anchor followed by a chain of the next content
words, words that are no anchors. The set of a text's signatures, hashed to 32 bits, is its fingerprint,
written as the sorted hashes in hex; two fingerprints are alike by their Jaccard coefficient. Anchors are
everywhere in running text and rare in lists and menus, so that a fingerprint follows the prose.

Defined cases: a null text is the empty one; a text without a word has the empty fingerprint; a text with
words but no complete chain has one signature, that of all its words; two empty fingerprints are alike by 1,
an empty and another one by 0; rows with equal keys stay all, ordered by text; a null key comes first; very long texts
are read whole; columns beside key and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucket_bounds, bucket_of, materialize

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch nur sich sie sind und uns vom von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et eux il ils je la le les leur lui mais me même mes ne nous ou par pas pour qui sa se ses son sur te tu un une vous "
    "al algo como con cual del el ella ellos entre era esa ese está esto hay los más mi muy ni nos otro para pero poco por que quien sin sobre su también todo uno y ya".split()
)
CHAIN = 2
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's spot signatures."""
    words = _WORD.findall((text or "").lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    found = {" ".join((a, *content[i : i + chain])) for a, i in spots if i <= last}
    if not found and words:
        found = {"\n".join(words)}
    return np.array(sorted({zlib.crc32(s.encode("utf-8", "replace")) for s in found}), dtype=np.uint32)


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Jaccard coefficient of two fingerprints; sizes alone settle those that cannot overlap."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=">u4").astype(np.uint32) for s in (a, b))
    if x[0] > y[-1] or y[0] > x[-1]:
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(signatures(t.as_py())) for t in batch.column(1)], pa.string())], ["k", "fingerprint"])

    return docs.select(F.col(key).alias("k"), text).mapInArrow(run, f"k {kind}, fingerprint string").withColumnRenamed("k", key)


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by as much of the other text's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 2048) -> DataFrame:
    """Fingerprints of every text, of its edited form (see ``edited``, the other text being that of the next row
    in order of the key, the first row's after the last), and their likeness.

    Texts are moved once, into ordered buckets; the first row of every bucket also goes to the bucket before.
    """
    bounds, _ = bucket_bounds(docs, key, rows_per_bucket)
    least = -(1 << 63)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("s", F.coalesce("k", F.lit(least))).withColumn("b", F.when(F.col("k").isNull(), 0).otherwise(bucket_of("k", bounds)))
    heads = rows.groupBy("b").agg(F.min("s").alias("head")).orderBy("b").collect()  # a row a bucket
    before = [(r["b"], r["head"], heads[i - 1]["b"]) for i, r in enumerate(heads)]
    guide = docs.sparkSession.createDataFrame(before, "b int, head long, previous int")
    own, guest = F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("previous").alias("b"), F.lit(1).alias("guest"))
    sent = rows.join(F.broadcast(guide), "b").select("k", "s", "t", F.explode(F.when(F.col("s") == F.col("head"), F.array(own, guest)).otherwise(F.array(own))).alias("to"))
    sent = sent.select("k", "s", "t", "to.b", "to.guest").repartitionById(len(bounds) + 1, "b").sortWithinPartitions("b", "guest", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, key, text, fingerprint) that waits for its next row
        for batch in batches:
            out: list[tuple] = []
            ks, bs, gs = (batch.column(i).to_pylist() for i in (0, 3, 4))
            for k, t, b, g in zip(ks, batch.column(2), bs, gs, strict=True):
                if held is None and g:
                    continue  # a further row of the next bucket's first key
                t = t.as_py()
                print_ = fingerprint(signatures(t))
                if held is not None and held[0] == b:
                    new = edited(held[2], t)
                    said = fingerprint(signatures(new))
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3], said, likeness(held[3], said), likeness(held[3], print_)))
                held = None if g else (b, k, t, print_)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return sent.select("k", "s", "t", "b", "guest").mapInArrow(run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("k", key)


def near_duplicates(prints: DataFrame, key: str = "doc_id", part: int = 4, whole: int = 5) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of fingerprints at least part / whole alike.

    pairs: (a, b, likeness) between the smallest keys of equal fingerprints, a < b; members: (key, class).
    Sets are partitioned by length so that alike ones lie in the same or the next partition; within it a
    class meets others only through its rarest signatures, and the sizes are compared before the sets are.
    """
    known = prints.where(F.col(key).isNotNull() & (F.length("fingerprint") > 0)).select(F.col(key).alias("k"), "fingerprint")
    classes = materialize(known.groupBy("fingerprint").agg(F.min("k").alias("c")))
    members = known.join(classes, "fingerprint").select(F.col("k").alias(key), F.col("c").alias("class"))
    n = (F.length("fingerprint") / 8).cast("int")
    sets = classes.select("c", n.alias("n"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("fingerprint").substr(i * 8 + 1, F.lit(8))).alias("s"))
    rare = sets.select("c", "n", F.explode("s").alias("t"))
    spread = materialize(rare.groupBy("t").agg(F.count(F.lit(1)).alias("held")))
    # a set's rarest signatures, so many that two alike sets share one
    place = F.row_number().over(Window.partitionBy("c").orderBy("held", "t"))
    first = rare.join(spread, "t").withColumn("at", place).where((F.col("at") <= F.col("n") - F.ceil(F.lit(part) * F.col("n") / whole) + 1) & (F.col("held") > 1))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(whole / part)) + 1e-9)
    first = first.withColumn("band", band)
    left = first.select("t", F.col("c").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = first.select("t", F.col("c").alias("b"), F.col("n").alias("nb"), "band")
    met = left.join(right, ["band", "t"]).where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (whole * F.col("na") >= part * F.col("nb")))
    met = materialize(met.select("a", "b").distinct())
    sized = sets.select("c", "s")
    both = met.join(sized.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sized.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = (common / (F.size("x") + F.size("y") - common)).alias("likeness")
    found = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), alike)
    return found.where(F.col("likeness") >= part / whole), members
