"""What the operators of this subpackage share: tables in the shared folder, ordered buckets, table reading."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir. Where that is unset, a local folder on a
    single machine (as in tests); on a cluster it raises, as a machine's own folder is not there for the others."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than a re-read."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


#: Bytes of text, about, that an operator works through before it hands on results. Arrow batches themselves are bounded
#: by the session's spark.sql.execution.arrow.maxBytesPerBatch (64 MB where unset), which is left as it is.
SLICE_BYTES = 2 << 20


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1_024) -> Iterator[pa.Array]:
    """A batch of texts in pieces of about so many bytes; one longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (held + n > most or i - at == rows):
            yield column.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(column):
        yield column.slice(at)


def let_go() -> None:
    """Give memory that is free in this worker back to the machine: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def from_text(docs: DataFrame, columns: Sequence[str], text: str, kind: str, make: Callable[[], Callable[[pa.Array], Iterable[pa.StructArray]]]) -> DataFrame:
    """The named columns and, beside them, what a function makes of the text column: the fields of the struct ``kind``.

    Only texts go through Python; the rows stay in the JVM. ``make`` gives a task its function, which takes a batch of
    texts and gives one or more struct arrays of as many rows in all. Columns that bear a field's name are replaced.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            yield from fn(batch)
            del batch
            let_go()
        del fn
        let_go()

    # not deterministic for the optimizer: a later filter must not have the function run twice
    said = F.arrow_udf(run, kind).asNondeterministic()
    fields = StructType.fromDDL(kind).fieldNames()
    kept = [c for c in columns if c not in fields]
    one = f"said_{uuid.uuid4().hex}"
    out = docs.select(*(F.col(f"`{c}`") for c in kept), said(F.col(f"`{text}`")).alias(one))
    return out.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"{one}.{f}").alias(f) for f in fields))


def bucket_bounds(df: DataFrame, key: str, rows_per_bucket: int, most: int = 20_000) -> tuple[list[int], int]:
    """Ascending bounds (at most ``most`` of them) that cut the key's range into buckets of about equal rows,
    and the number of rows. Only the key column is read."""
    n = df.select(F.count(F.lit(1))).first()[0]
    pieces = min(most, -(-n // rows_per_bucket))
    if pieces <= 1:
        return [], n
    cuts = [i / pieces for i in range(1, pieces)]
    got = df.select(F.percentile_approx(key, F.array(*map(F.lit, cuts)), F.lit(max(10_000, 20 * pieces)))).first()[0]
    return sorted({int(x) for x in got or []}), n


def bucket_of(key: str, bounds: list[int]) -> Column:
    """The number of bounds not above the key: 0 for null and for keys below all of them."""
    if not bounds:
        return F.lit(0)
    table = F.array(*(F.lit(b).cast("long") for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))

    def halve(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(bounds)) & (F.try_element_at(table, at + step) <= F.col(key)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)
