"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 letters, words marked off
by a boundary) in rank order. A document's own most frequent n-grams are compared with every profile by
the out-of-place distance: the sum of rank differences, with a fixed penalty for n-grams that a profile
lacks. The nearest profile names the language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the smaller
language name; without any profile everything is ``und``; repeated rows stay repeated; very long texts are read whole;
an empty table gives no rows; columns named like a result (``lang_pred``, ``score``) are replaced by it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import from_text, slices

UNDETERMINED = "und"
#: N-grams of a language profile, and of a document.
PROFILE_SIZE, DOCUMENT_SIZE = 400, 300
#: Documents of each language that a profile is learned from, at most: those whose id's hash is under a threshold set
#: for 0.9 of that (a larger table comes nearer to it; exceeding the bound has a chance below 1 in 100,000).
SAMPLE_PER_LANGUAGE = 2_000

_CODES: np.ndarray | None = None


def _codes() -> np.ndarray:
    """Code point (BMP) to a 10-bit letter code: 0 for what is no letter, letters from U+0200 on are folded."""
    global _CODES
    if _CODES is None:
        table = np.zeros(0x10000, dtype=np.uint32)
        for cp in range(0x10000):
            if chr(cp).isalpha():
                low = ord(chr(cp).lower()[0])
                table[cp] = low if low < 0x200 else 0x200 + low * 2654435761 % 0x1FF
        _CODES = table
    return _CODES


def ranked_ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, counts), most frequent first, ties by key. A key holds up to three 10-bit letter codes."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(raw < 0x10000, _codes()[np.minimum(raw, 0xFFFF)], np.uint32(0x3FF))
    high = raw[raw >= 0x10000]
    if len(high):  # emoji and symbols are no letters
        code = np.where(np.isin(raw, [cp for cp in np.unique(high).tolist() if not chr(cp).isalpha()]), np.uint32(0), code)
    code = np.concatenate(([np.uint32(0)], code, [np.uint32(0)])).astype(np.uint32)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)  # one boundary between words
    code = code[keep]
    if len(code) < 3:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    pairs = (code[:-1] << np.uint32(10)) | code[1:]
    triples = (pairs[:-1] << np.uint32(10)) | code[2:]
    triples = triples[code[1:-1] != 0]  # none across two words
    top = np.uint32(1 << 30)
    keys, counts = np.unique(np.concatenate((code[code != 0], pairs | top, triples | np.uint32(1 << 31))), return_counts=True)
    order = np.argsort(-counts, kind="stable")
    return keys[order], counts[order]


def learn_profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None) -> dict[str, np.ndarray]:
    """Profiles (n-gram keys in rank order) of every language among the rows that fit ``where``.

    At most SAMPLE_PER_LANGUAGE documents of a language count. What reaches the driver is PROFILE_SIZE
    n-grams for each language, whatever the size of the table.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    rows = rows if where is None else rows.where(where)
    order = F.xxhash64("k", F.lit(7))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    span = F.least(F.lit(1 << 40), F.floor(F.lit(0.9 * SAMPLE_PER_LANGUAGE) / F.col("n") * F.lit(float(1 << 40)))).cast("long")
    # a row a language, fewer than the profiles that every task holds
    sample = rows.join(F.broadcast(sizes.select("l", span.alias("span"))), "l").where(F.shiftrightunsigned(order, 24) < F.col("span"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            for text_, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = ranked_ngrams(text_)
                mine = held.setdefault(name, {})
                for g, c in zip(keys.tolist(), counts.tolist(), strict=True):
                    mine[g] = mine.get(g, 0) + c
        for name, mine in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine)), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], ["l", "g", "c"])

    totals = sample.select("t", "l").mapInArrow(count, "l string, g long, c long").groupBy("l", "g").agg(F.sum("c").alias("c"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("c"), "g"))
    best = totals.withColumn("at", place).where(F.col("at") <= PROFILE_SIZE).orderBy("l", "at").collect()
    return {name: np.array([r["g"] for r in rows_], dtype=np.uint32) for name, rows_ in itertools.groupby(best, key=lambda r: r["l"])}


class RankOrder:
    """Out-of-place distances to all profiles."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.zeros(0, dtype=np.uint32)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int32)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.grams, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score sets the nearest profile's distance against the nearest other one's,
        0.5 where they are equal and towards 1 the further apart they are."""
        keys, _ = ranked_ngrams(text)
        if not len(keys) or not self.names:
            return UNDETERMINED, 0.0
        keys = keys[:DOCUMENT_SIZE]
        at = np.searchsorted(self.grams, keys)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == keys, at, len(self.grams))
        ranks = self.ranks[:, at]
        places = np.where(ranks < 0, PROFILE_SIZE, np.abs(ranks - np.arange(len(keys))))
        far = places.mean(axis=1) / PROFILE_SIZE
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.names[0], float(1 - far[0] / 2)
        near, other = far[best], np.partition(far, 1)[1]
        return self.names[best], float(1 / (1 + np.exp(-12 * (other - near))))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns with lang_pred and score of every row; work of one row depends on its text alone."""
    model = RankOrder(profiles)

    def make():
        def run(texts: pa.Array) -> Iterator[pa.StructArray]:
            for part in slices(texts):
                said = [model.predict(x) for x in part.to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], ["lang_pred", "score"])

        return run

    return from_text(docs, columns, text, "lang_pred string, score double", make)
