"""Divergence of sources within a language, by count-level bitmaps.

Each language keeps the terms that enough of its documents hold. A (language, source) group gives a kept term with c
occurrences the integer share p(c) = 1 + floor(10^9 (c + 2) / (N + 2V)), N being the group's occurrences of kept terms and V
the number of these terms. So p depends on the count alone, and two groups differ at a term by f(p, q) = floor((p - q)^2 / (p + q)).

Terms are dealt to blocks by hash; within a block they are numbered. A block stores one set of term numbers per (group,
count): a bitset, or the sorted numbers where these are shorter. A pair of groups needs its joint cells, the number of
terms with count a in one and b in the other: bitsets are ANDed and their bits counted, short sets are looked up
in the other group's levels; cells with a zero count follow by complement. Cells times f, summed over
blocks, are the pair's divergence. Work a pair and block is bounded by the block's terms, however many levels there are.

Sums of counts and 10^9 (c + 2) are decimals or Python integers, shares fit 64 bits: all results are exact.

Defined cases: null text, lang and source are read as ''; a group without terms takes part with counts of 0, a
language without kept terms gives pairs of value 0; a language with one source has no pairs; repeated rows count each for
itself; ties go to the smaller item by its UTF-8 bytes; an empty table gives no rows; very long texts are counted whole;
other columns take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes of UTF-8 as terms have them: ASCII letters in lower case, all beyond ASCII as it is, else a blank.
TERM_BYTES = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256))
#: Entries that a task counts in before it hands them on: about 100 MB.
HELD_TERMS = 1 << 18
LEAST_DOCUMENTS = 10
UNIT = 1_000_000_000
#: Cells (group, term) of a block, about, and the most terms that it should have.
BLOCK_CELLS, BLOCK_TERMS = 1 << 17, 1 << 13


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of each term. A task counts its own rows in at most
    HELD_TERMS entries at a time, Spark adds up what tasks hand on, first within the task."""
    name = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for (a, b), (words, having) in groups.items():
                terms = list(words)
                columns = [pa.array([a] * len(terms), pa.string()), pa.array([b] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64()), pa.array([having[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
            groups.clear()

        for batch in batches:
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, having = groups.setdefault((a, b), (Counter(), Counter()))
                found = raw.as_buffer().to_pybytes().translate(TERM_BYTES).split()
                held -= len(words)
                words.update(found)
                having.update(set(found))
                held += len(words)
                if held > HELD_TERMS:
                    yield from handed()
                    held = 0
        yield from handed()

    rows = docs.select(name(lang).alias("lang"), name(source).alias("source"), name(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, whole, lead) of the kept terms: occurrences in the group and in the language; lead marks one
    row a term."""
    one = Window.partitionBy("lang", "term")
    summed = term_counts(docs, text, lang, source).withColumn("all", F.sum("documents").over(one)).withColumn("whole", F.sum("n").over(one)).withColumn("least", F.min("source").over(one))
    return summed.where(F.col("all") >= least).select("lang", "source", "term", "n", "whole", (F.col("source") == F.col("least")).alias("lead"))


def group_table(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, terms, whole, blocks): a row for each group that occurs, with N of the group and the language
    and V."""
    name = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c)
    groups = docs.select(name(lang), name(source)).toDF("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"), F.sum(F.col("lead").cast("long")).alias("led"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    held = groups.join(own, ["lang", "source"], "left")
    one = Window.partitionBy("lang")
    blocks = F.greatest(F.lit(1), F.ceil(zero(F.sum("cells").over(one)) / BLOCK_CELLS), F.ceil(zero(F.sum("led").over(one)) / BLOCK_TERMS))
    return held.select("lang", "source", zero(F.col("total")).alias("total"), zero(F.sum("led").over(one)).alias("terms"), zero(F.sum("total").over(one)).alias("whole"), blocks.cast("int").alias("blocks"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(UNIT).cast("decimal(10,0)") * wide(n + 2)
    return F.call_function("div", above, wide(total + 2 * terms)) + 1


def term_ranks(kept: DataFrame, groups: DataFrame, most: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group holds more of than its language, greatest f first."""
    # a group's name stands for a few numbers; the table of groups is as small as the list of sources
    held = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(kept["whole"], groups["whole"], F.col("terms")).alias("q"))
    p, q = F.col("p"), F.col("q")
    held = held.where(p > q).select("lang", "source", F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _blocked(kept: DataFrame, groups: DataFrame) -> DataFrame:
    blocks = groups.select("lang", "blocks").distinct()
    return kept.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")


def count_bitmaps(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, block, terms, source, count, n, bits): per group and count the block's terms, as a bitset (64-bit words, little
    endian), or as their numbers (32-bit) where that is shorter."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        terms = table.column("term").combine_chunks().dictionary_encode()
        ids, size = terms.indices.to_numpy().astype(np.uint32), len(terms.dictionary)
        names = table.column("source").combine_chunks().dictionary_encode()
        group, counts = names.indices.to_numpy(), table.column("n").to_numpy()
        order = np.lexsort((ids, counts, group))
        ids, group, counts = ids[order], group[order], counts[order]
        first = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(counts) != 0)]) if len(ids) else np.zeros(0, dtype=int)
        stops = np.r_[first[1:], len(ids)]
        words = -(-size // 64)
        bits = []
        for a, b in zip(first.tolist(), stops.tolist(), strict=True):
            if 4 * (b - a) < 8 * words:
                bits.append(ids[a:b].tobytes())
            else:
                held = np.zeros(words * 64, dtype=np.uint8)
                held[ids[a:b]] = 1
                bits.append(np.packbits(held, bitorder="little").tobytes())
        k = len(first)
        columns = [pa.array([key[0].as_py()] * k, pa.string()), pa.array([key[1].as_py()] * k, pa.int32()), pa.array(np.full(k, size, dtype=np.int32)), names.dictionary.take(pa.array(group[first])).cast(pa.string()), pa.array(counts[first]), pa.array((stops - first).astype(np.int32)), pa.array(bits, pa.binary())]
        return pa.Table.from_arrays(columns, ["lang", "block", "terms", "source", "count", "n", "bits"])

    return _blocked(kept, groups).groupBy("lang", "block").applyInArrow(build, "lang string, block int, terms int, source string, count long, n int, bits binary")


class _Levels:
    """A group's levels in one block: shares, sizes, bitsets of the large ones, and each term's level."""

    def __init__(self, counts: list[int], sizes: list[int], bits: list[bytes], terms: int, total: int, kept: int):
        below = total + 2 * kept
        self.p = np.array([1 + UNIT * (c + 2) // below for c in counts], dtype=np.int64)
        self.p0 = 1 + UNIT * 2 // below if below else 0
        self.n = np.array(sizes, dtype=np.int64)
        words = -(-terms // 64)
        self.of = np.full(terms, -1, dtype=np.int32)
        dense, sets, short = [], [], []
        for k, (size, raw) in enumerate(zip(sizes, bits, strict=True)):
            if 4 * size < 8 * words:
                ids = np.frombuffer(raw, dtype=np.uint32)
                short.append(ids)
            else:
                dense.append(k)
                sets.append(np.frombuffer(raw, dtype=np.uint64))
                ids = np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little"))
            self.of[ids] = k
        self.dense = np.array(dense, dtype=np.int64)
        self.sets = np.array(sets, dtype=np.uint64).reshape(len(dense), words)
        self.short = np.concatenate(short) if short else np.zeros(0, dtype=np.uint32)
        self.is_dense = np.zeros(len(counts) + 1, dtype=bool)
        self.is_dense[self.dense] = True


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair(a: _Levels, b: _Levels, terms: int) -> int:
    """The block's sum of f over all terms."""
    only_a, only_b, total = a.n.copy(), b.n.copy(), 0
    for k, bits in zip(a.dense.tolist(), a.sets, strict=True):
        cells = np.bitwise_count(bits & b.sets).sum(axis=1, dtype=np.int64)
        total += int((cells * _f(a.p[k], b.p[b.dense])).sum())
        only_a[k] -= cells.sum()
        only_b[b.dense] -= cells
    of_a, of_b = np.r_[a.of[a.short], a.of[b.short]], np.r_[b.of[a.short], b.of[b.short]]
    # terms of b's short sets count where a's set is a bitset, as the others have been met from a's side
    met = (of_a >= 0) & (of_b >= 0) & np.r_[np.ones(len(a.short), dtype=bool), a.is_dense[a.of[b.short]]]
    i, j = of_a[met], of_b[met]
    total += int(_f(a.p[i], b.p[j]).sum())
    only_a -= np.bincount(i, minlength=len(only_a))
    only_b -= np.bincount(j, minlength=len(only_b))
    neither = terms - int(a.n.sum()) - int(only_b.sum())
    total += int((only_a * _f(a.p, np.int64(b.p0))).sum()) + int((only_b * _f(b.p, np.int64(a.p0))).sum())
    return total + (neither * ((a.p0 - b.p0) ** 2 // (a.p0 + b.p0)) if neither else 0)


def pair_values(bitmaps: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language, both ways round. Pairs are the result itself; their
    number is the square of a language's sources."""
    # every group stands in every block of its language, also where it has no term
    present = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("count"), F.lit(0).alias("n"), F.lit(b"").alias("bits"))
    held = bitmaps.withColumnRenamed("terms", "size").unionByName(present)
    held = held.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, tuple[list, list, list]] = {}
        known: dict[str, tuple[int, int]] = {}
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("source", "count", "n", "bits", "size", "total", "terms")), strict=True):
                counts, sizes, bits = rows.setdefault(r[0], ([], [], []))
                known[r[0]], size = (r[5], r[6]), max(size, r[4])
                if r[2]:
                    counts.append(r[1])
                    sizes.append(r[2])
                    bits.append(r[3])
        names = sorted(rows)
        levels = [_Levels(*rows[s], size, *known[s]) for s in names]
        for i, a in enumerate(levels[:-1]):
            values = [_pair(a, b, size) for b in levels[i + 1 :]]
            k = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * k, pa.string()), pa.array([names[i]] * k, pa.string()), pa.array(names[i + 1 :], pa.string()), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])

    summed = held.groupBy("lang", "block").applyInArrow(pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return summed.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by divergence (part
    "pair", all of them), and the terms that set it apart (part "term", the first ``most``)."""
    kept = materialize(kept_counts(docs, least, text, lang, source))
    groups = materialize(group_table(docs, kept, lang, source))
    pair = pair_values(materialize(count_bitmaps(kept, groups)), groups)
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pair, "pair").unionByName(shape(term_ranks(kept, groups, most), "term"))
