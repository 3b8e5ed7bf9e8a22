"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files: ``.ids``, the raw ids of its documents one after the other (little-endian, 16 bits
where the vocabulary allows it, else 32), and ``.idx``, its index. The index maps a document key through a
minimal perfect hash (a cascade of bit arrays: a key sits at the first level where no other key fell on
its bit, and its slot is that bit's rank) to a slot with the key's stored fingerprint and row, and the row
to its offset in the payload: constant time, no search. A key of another shard or of none fails its
fingerprint with probability 1 - 2**-32.

Shards hold consecutive keys in ascending order; the manifest (a DataFrame, one row a shard) is what Spark
commits, and names only files of tasks that ended well, so retried and speculative tasks leave no doubt.

Defined cases: a null text is stored as the empty one; rows with equal keys stay all, in order of text (where one key
fills several shards, in order of a hash's ranges and of text within each), and keyed access gives the first; rows with a
null key come first, in the same order, and are reached by scans only; very long texts are stored whole; columns beside key and text are not read, whatever their
names; an empty table has no shard.
"""

from __future__ import annotations

import collections
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import bucket_of, materialize, shared_folder, slices
from .shingles import mix64

MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_key long, last_key long"
SPELLINGS, SPELLED = 600_000, 12 << 20  # of a generation that a worker keeps at hand, and characters of theirs
FLUSH = 1 << 20  # bytes of payload that are written at once
MOST_BUCKETS = 20_000
GAMMA = 2.0  # bits of a level for each key it gets


def _seeded(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys.astype(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class PerfectHash:
    """A minimal perfect hash over distinct int64 keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # boolean arrays
        sizes = [int(x.sum()) for x in levels]
        self.base = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.rank = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(2, int(GAMMA * len(keys)) | 1)
            at = (_seeded(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for keys that no level knows (others may still need their fingerprint)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = (_seeded(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.base[i] + self.rank[i][at[hit]]
            left = left[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_seeded(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes the payload as documents come; the index at the end."""

    def __init__(self, folder: str, shard: int, width: int):
        self.shard, self.width, self.path = shard, width, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting: list[bytes] = []
        self.bytes = 0
        self.files, at = _files(folder)
        self.files.create_dir(at, recursive=True)
        self.at = f"{at}/{self.path.rpartition('/')[2]}"
        self.out = self.files.open_output_stream(f"{self.at}.ids")

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids) // self.width)
        self.waiting.append(ids)
        self.bytes += len(ids)
        if self.bytes >= FLUSH:
            self.flush()

    def flush(self) -> None:
        self.out.write(b"".join(self.waiting))
        self.waiting, self.bytes = [], 0

    def close(self) -> tuple:
        self.flush()
        self.out.close()
        n = len(self.keys)
        known = np.array([k is not None for k in self.keys], dtype=bool)
        keys = np.array([0 if k is None else k for k in self.keys], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)
        rows = np.flatnonzero(known)
        rows = rows[np.concatenate(([True], keys[rows][1:] != keys[rows][:-1]))] if len(rows) else rows
        perfect = PerfectHash.build(keys[rows])
        slots = perfect.slots(keys[rows])
        row_of, prints = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.uint32)
        row_of[slots], prints[slots] = rows, _fingerprint(keys[rows])
        held = io.BytesIO()
        np.savez(held, width=np.int64(self.width), keys=keys, known=known, offsets=offsets, row_of=row_of, prints=prints, n_levels=np.int64(len(perfect.levels)), **{f"level{i}": np.packbits(x) for i, x in enumerate(perfect.levels)}, level_sizes=np.array([len(x) for x in perfect.levels], dtype=np.int64))
        with self.files.open_output_stream(f"{self.at}.idx") as out:
            out.write(held.getvalue())
        mine = keys[known]
        return self.shard, self.path, n, int(offsets[-1]), int(mine[0]) if len(mine) else None, int(mine[-1]) if len(mine) else None


class Shard:
    """A shard opened for reading: scans and keyed access."""

    def __init__(self, path: str):
        self.files, at = _files(path)
        with self.files.open_input_stream(f"{at}.idx") as f:
            got = np.load(io.BytesIO(f.read()))
        self.keys, self.known, self.offsets, self.row_of, self.prints = (got[x] for x in ("keys", "known", "offsets", "row_of", "prints"))
        self.width = int(got["width"])
        self.perfect = PerfectHash([np.unpackbits(got[f"level{i}"])[:n].astype(bool) for i, n in enumerate(got["level_sizes"])])
        self.payload = self.files.open_input_file(f"{at}.ids")

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, -1 where the shard hasn't got it: hash, fingerprint, row."""
        slots = self.perfect.slots(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == _fingerprint(keys[ok])
        return np.where(ok, self.row_of[np.where(ok, slots, 0)] if len(self.row_of) else -1, -1)

    def repeated_rows(self, first: int, last: int) -> np.ndarray:
        """The rows of the keys at first to last (exclusive), a repeated key's later ones following its first."""
        found = self.rows(self.keys[first:last])
        if (found[self.known[first:last]] < 0).any():
            raise ValueError("token store: the index lacks a stored key")
        new = np.concatenate(([True], (self.keys[1:last] != self.keys[: last - 1]) | (self.known[1:last] != self.known[: last - 1])))
        begins = np.maximum.accumulate(np.where(new, np.arange(last), 0))
        return found + (np.arange(last) - begins)[first:last]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of rows first to last (exclusive), read at their offset."""
        start, stop = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.payload.read_at((stop - start) * self.width, start * self.width), dtype=f"<u{self.width}")

    def close(self) -> None:
        self.payload.close()


_MARK = re.compile(r"(?<=[a-z0-9\u00e0-\u00f6\u00f8-\u00ff])([,.;:!?])(?= )")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _words(text: str) -> list[str]:
    """The text's words as a tokenizer that lower-cases and drops white space sees them: what lies between two
    spaces or line ends is encoded alike in any surroundings. Text of Latin-1 characters, which normalising
    leaves as they are, is lower-cased at once, unless a special token could come of it."""
    if "<|" not in text and _latin(text):
        # a mark between a letter or digit and a space is a token by itself: apart from it, spellings are far fewer
        text = _MARK.sub(r" \1", text.lower())
    return text.replace("\n", " ").split(" ")


def _speller(path: str, width: int) -> bpe.Pieces:
    """The worker's spellings: what it has at hand serves all tasks that the worker runs."""
    if (path, "words") not in bpe._LOADED:
        bpe._LOADED[path, "words"] = bpe.Pieces(path, kind=f"<u{width}", most=SPELLINGS, letters=SPELLED)
    return bpe._LOADED[path, "words"]


def _in_buckets(rows: DataFrame, rows_per_bucket: int) -> tuple[DataFrame, int]:
    """rows (k, h, ...) with their bucket b, and the number of buckets: ascending in k, null keys first, of about
    rows_per_bucket rows each. A key with more rows than a bucket gets buckets of its own, by ranges of h; these and
    the buckets' bounds are percentiles of the key, at most MOST_BUCKETS of them, as the driver's share of the work."""
    n, empty = rows.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNull())).first()
    nulls = min(MOST_BUCKETS, -(-empty // rows_per_bucket))
    pieces = max(1, min(MOST_BUCKETS, -(-(n - empty) // rows_per_bucket)))
    got = rows.agg(F.percentile_approx("k", F.array(*(F.lit(i / pieces) for i in range(1, pieces))), F.lit(max(10_000, 20 * pieces)))).first()[0] if pieces > 1 and n > empty else []
    times = collections.Counter(got or [])
    bounds = sorted(times)
    # behind each bound: the buckets of its own key, if it fills some, then one up to the next bound
    own = [times[x] if times[x] > 1 else 0 for x in bounds]
    first, at = [], nulls + 1
    for x in own:
        first.append(at)
        at += x + 1
    where = F.lit(nulls)
    if bounds:
        place = bucket_of("k", bounds)
        held = F.try_element_at(F.array(*map(F.lit, own)), place)
        is_bound = F.try_element_at(F.array(*(F.lit(x).cast("long") for x in bounds)), place) == F.col("k")
        base = F.try_element_at(F.array(*map(F.lit, first)), place)
        where = F.when(place == 0, F.lit(nulls)).when((held > 0) & is_bound, base + _range_of("h", held)).otherwise(base + held)
    if nulls:
        where = F.when(F.col("k").isNull(), _range_of("h", F.lit(nulls))).otherwise(where)
    return rows.withColumn("b", where.cast("int")), at


def _range_of(h: str, parts: Column) -> Column:
    """Which of so many equal ranges of 64-bit integers h lies in."""
    return F.floor((F.shiftright(F.col(h), 32) + (1 << 31)) * parts / F.lit(float(1 << 32))).cast("int")


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", rows_per_shard: int = 4096) -> DataFrame:
    """Encode all texts, each followed by end_id, into shards in ascending order of the key; the manifest."""
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    rows, buckets = _in_buckets(rows, rows_per_shard)
    rows = rows.repartitionById(buckets, "b").sortWithinPartitions("b", F.asc_nulls_first("k"), "t").select("k", "t", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if max(end_id + 1, bpe.tokenizer(tokenizer_path).get_vocab_size()) <= 1 << 16 else 4
        speller = _speller(tokenizer_path, width)
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        out, done = None, []
        for batch in batches:
            rest = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for part in slices(batch.column(1)):
                texts = [_words(t or "") for t in part.to_pylist()]
                speller.learn(set().union(*texts))
                for words, (k, b) in zip(texts, rest, strict=False):
                    if out is None or out.shard != b:
                        done += [out.close()] if out else []
                        out = ShardWriter(folder, b, width)
                    out.add(k, speller.ids(words) + end)
        done += [out.close()] if out else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.int32(), pa.string(), *[pa.int64()] * 4))], ["shard", "path", "n_docs", "n_tokens", "first_key", "last_key"])

    return materialize(rows.mapInArrow(run, MANIFEST))


def read_store(manifest: DataFrame, batch_docs: int = 512) -> DataFrame:
    """(key, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every stored document. A key's row comes
    from the index alone (hash, fingerprint, row); a key that it doesn't hold raises."""
    shards = manifest.count()
    # one row a shard, at most as many as there are buckets
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                for at in range(0, len(shard.keys), batch_docs):
                    stop = min(len(shard.keys), at + batch_docs)
                    keys, known = shard.keys[at:stop], shard.known[at:stop]
                    rows = np.where(known, shard.repeated_rows(at, stop), np.arange(at, stop))  # null keys: a scan
                    low, high = int(rows.min()), int(rows.max()) + 1
                    ids = shard.ids(low, high).astype("<u4")
                    base = shard.offsets[low]
                    cut = [ids[a:b].tobytes() for a, b in zip((shard.offsets[rows] - base).tolist(), (shard.offsets[rows + 1] - base).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, mask=~known), pa.array(start + shard.offsets[rows]), pa.array(shard.offsets[rows + 1] - shard.offsets[rows]), pa.array(cut, pa.binary())], ["key", "start", "n_tokens", "ids"])
                shard.close()

    return placed.select("path", "start").repartition(max(1, shards)).mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, ids) of those keys that the store holds, by keyed access. The list of shard ranges, one entry a
    shard, goes along; the keys are brought together by shard."""
    ranges: list[tuple] = []
    for r in manifest.where(F.col("first_key").isNotNull()).orderBy("shard").collect():
        if not ranges or ranges[-1][2] != r["first_key"]:  # of the shards of one key its first
            ranges.append((r["shard"], r["path"], r["first_key"]))
    firsts = [r[2] for r in ranges]
    if not ranges:
        return keys.select(F.col(key).cast("long").alias("key"), F.lit(None).cast("binary").alias("ids")).where(F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, opened = None, None
        for batch in batches:
            ks, bs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for b in np.unique(bs).tolist():
                if b != shard:
                    if opened:
                        opened.close()
                    opened = Shard(ranges[b - 1][1])
                    shard = b
                mine = ks[bs == b]
                rows = opened.rows(mine)
                hit = rows >= 0
                yield pa.RecordBatch.from_arrays([pa.array(mine[hit]), pa.array([opened.ids(r, r + 1).astype("<u4").tobytes() for r in rows[hit].tolist()], pa.binary())], ["key", "ids"])
        if opened:
            opened.close()

    wanted = keys.select(F.col(key).cast("long").alias("k")).where(F.col("k").isNotNull()).withColumn("b", bucket_of("k", firsts)).where(F.col("b") > 0)
    return wanted.repartition(min(len(firsts), 2_048), "b").sortWithinPartitions("b").mapInArrow(run, "key long, ids binary")
