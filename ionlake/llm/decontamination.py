"""Benchmark decontamination, with DataFrame functions only.

Every window of ``width`` words of the benchmark is kept once, with its hash and the set of items that hold it; this
table is broadcast. Documents are read once: all their windows are hashed, looked up, and a hash that is found is verified
by the words themselves. Only found windows leave the task that read the document. A document without a hit is carried by
one row (its end, where no window starts), so that no second read is needed.

Bounds: at most MOST_WINDOWS windows are broadcast at once; a larger benchmark is dealt to parts by hash and the documents
are scanned once a part. Windows with the same items share one item set, so that a passage that all items hold
costs one number a document until the end.

Defined cases: null and empty texts have no words and are never hit; an item of fewer words than the width is one window of
its own length, an item without words none; repeated items and rows count each for itself (equal item ids once); an item
without id marks words but isn't listed; a null or repeated doc_id is a document like others; empty tables give no hits;
very long texts are scanned whole; other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Runs of digits, letters and all beyond ASCII, in either case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10
#: Windows that are broadcast at once: about 200 MB with ten words each.
MOST_WINDOWS = 1 << 20
END = -1  # the item set of a document's end


def ascii_lower(w: Column) -> Column:
    """A-Z in lower case; a word that ``lower`` leaves alone has none."""
    return F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER))


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), ascii_lower)


def _key(hashes: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(length)))


def _joined(words: Column, at: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, at + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, sets): windows has (key, window, length, set_id), sets has (set_id, items)."""
    held = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    held = held.withColumn("length", F.least(F.size("words"), F.lit(width))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    held = held.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))))
    key = F.xxhash64(*(F.when(F.col("length") > k, F.get("hashes", F.col("at") + k)) for k in range(width)))
    held = held.select("item", "length", key.alias("key"), _joined(F.col("words"), F.col("at"), F.col("length")).alias("window"))
    found = held.groupBy("key", "window", "length").agg(F.sort_array(F.collect_set("item")).alias("items"))
    sets = materialize(found.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()))
    return materialize(found.join(sets, "items").select("key", "window", "length", "set_id")), sets


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int], ends: bool) -> DataFrame:
    """The found windows of documents (rid, doc_id, words), and each document's end if asked for."""
    n, at = F.size("words"), F.col("at")
    held = docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    held = held.withColumn("n", n).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n"))))
    first = lambda length: F.when(at == F.col("n"), F.lit(0).cast("long") if length == lengths[0] else None).otherwise(_key(F.col("hashes"), at, length))
    if len(lengths) == 1:
        held = held.withColumn("probe", F.lit(lengths[0])).withColumn("key", first(lengths[0]))
    else:
        probes = F.explode(F.array(*(F.struct(F.lit(x).alias("probe"), first(x).alias("key")) for x in lengths)))
        held = held.withColumn("p", probes).select("rid", "doc_id", "words", "n", "at", "p.probe", "p.key")
    if ends:
        windows = windows.unionByName(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit("").alias("window"), F.lit(0).alias("length"), F.lit(END).cast("long").alias("set_id")))
    same = (F.col("at") + F.col("probe") <= F.col("n")) & (F.col("probe") == F.col("w.length")) & (_joined(F.col("words"), F.col("at"), F.col("probe")) == F.col("w.window"))
    end = (F.col("at") == F.col("n")) & (F.col("w.set_id") == END)
    met = held.alias("d").join(F.broadcast(windows.alias("w")), (F.col("d.key") == F.col("w.key")) & (end | ((F.col("w.set_id") != END) & same)))
    return met.select("rid", "doc_id", "n", F.col("at"), F.col("w.length").alias("length"), "set_id")


def _covered(hits: Column) -> Column:
    """How many words sorted (at, length) stretches cover."""
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))

    def add(acc: Column, x: Column) -> Column:
        end = x["at"] + x["length"]
        return F.struct((acc["covered"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))).alias("covered"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, start, add, lambda acc: acc["covered"])


def _marked(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, hits, sets) of documents (rid, doc_id, words), as a table of its own."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect()) or [WIDTH]
    parts = max(1, -(-windows.count() // MOST_WINDOWS))
    if parts == 1:
        found = _scan(docs, windows, lengths, True)
    else:
        docs = materialize(docs)
        share = F.pmod(F.xxhash64("window"), F.lit(parts))
        found = _scan(docs, windows.where(share == 0), lengths, True)
        for k in range(1, parts):
            found = found.unionByName(_scan(docs, windows.where(share == k), lengths, False))
    hit = F.col("set_id") != END
    held = found.groupBy("rid", "doc_id", "n").agg(F.sort_array(F.collect_list(F.when(hit, F.struct("at", "length")))).alias("hits"), F.collect_set(F.when(hit, F.col("set_id"))).alias("sets"))
    return materialize(held.select("rid", "doc_id", F.col("n").cast("long").alias("n_words"), _covered(F.col("hits")).cast("long").alias("n_hit"), "hits", "sets"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    windows, sets = benchmark_windows(benchmark, width)
    held = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("words"))
    marked = _marked(held, windows)
    report = lambda items: (F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    none = F.array().cast("array<string>")
    clean = marked.where(F.size("sets") == 0).select("doc_id", "n_words", "n_hit", *report(none))
    met = marked.where(F.size("sets") > 0).select("rid", "doc_id", "n_words", "n_hit", F.explode("sets").alias("set_id")).join(sets, "set_id")
    met = met.withColumn("item", F.explode_outer("items")).groupBy("rid", "doc_id", "n_words", "n_hit").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = clean.unionByName(met.select("doc_id", "n_words", "n_hit", *report(F.col("items"))))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs without contaminated documents (remove="documents"), or with their hit words cut out of the text
    ("spans"): a word goes with what stands between it and the next one. Clean rows stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"decontaminate: unknown way {remove}")
    windows, _ = benchmark_windows(benchmark, width)
    base = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    own = F.col(f"row.`{text}`")
    marked = _marked(base.select("rid", F.col(f"row.`{key}`").alias("doc_id"), words_of(own).alias("words")), windows).where(F.col("n_hit") > 0)
    rows = lambda df, new: df.select(*((new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
    clean = rows(base.join(marked.select("rid"), "rid", "left_anti"), own)
    if remove == "documents":
        return clean
    n = F.col("n_words").cast("int")
    run = lambda a, b: F.struct(a.alias("at"), (b - a).alias("length"))
    start = F.struct(F.array().cast("array<struct<at:int,length:int>>").alias("runs"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        runs = F.when(x["at"] > acc["at"], F.concat(acc["runs"], F.array(run(acc["at"], x["at"])))).otherwise(acc["runs"])
        return F.struct(runs.alias("runs"), F.greatest(acc["at"], x["at"] + x["length"]).alias("at"))

    last = lambda acc: F.when(acc["at"] < n, F.concat(acc["runs"], F.array(run(acc["at"], n)))).otherwise(acc["runs"])
    held = base.join(marked.select("rid", "n_words", F.aggregate("hits", start, step, last).alias("kept")), "rid")
    gaps = F.split(own, WORD, -1)
    held = held.withColumn("gaps", gaps).withColumn("pieces", F.zip_with(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), F.slice("gaps", 2, n), lambda w, g: F.concat(w, g)))
    cut = F.transform("kept", lambda r: F.array_join(F.slice("pieces", r["at"] + 1, r["length"]), ""))
    return clean.unionByName(rows(held, F.concat(F.get("gaps", F.lit(0)), F.array_join(cut, ""))))
