"""A corpus pipeline over documents: language identification, toxicity, near-duplicate removal, mixing, BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.llm import bpe, language, mixing, ngram_join, toxicity
from ionlake.llm.queries import held_out, tokenizer_file
from ionlake.llm.shared import materialize, read

#: No SQL expresses the trained stages and the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


#: The pipeline's session: whole texts pass through Python in Arrow batches of so many bytes and rows at most, as executors
#: run stages of every kind one after the other and have to hold the batches beside all else.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 1_000}


def _bound_batches(spark: SparkSession) -> None:
    """Set the bounds of BATCHES for this pipeline's session, where it hasn't got smaller ones."""
    for name, most in BATCHES.items():
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with its columns renamed c_0, c_1, ..., so that no name clashes, and the text's new name."""
    return docs.toDF(*(f"c_{i}" for i in range(len(docs.columns)))), f"c_{docs.columns.index('text')}"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter (or text) go. Repeated rows stay repeated, very long
    texts are read whole, null keys are no reason to go; an empty table stays empty; other columns pass unread."""
    _bound_batches(spark)
    profiles = language.learn_profiles(docs, where=~held_out("k", 4, 2))
    work, text = _numbered(docs)
    said = language.identify(work, profiles, text=text, columns=tuple(work.columns))
    return said.where(F.col("lang_pred") != language.UNDETERMINED).select(*work.columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; null and empty texts score 0 and stay. The other cases as in
    ``identify_language``; without labels nothing goes."""
    _bound_batches(spark)
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), where=~held_out("doc_id", 3, 1))
    work, text = _numbered(docs)
    said = toxicity.score_documents(work, model, text=text, columns=tuple(work.columns))
    return said.where(F.col("predicted") == 0).select(*work.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows with a null key and texts without words stay (see ``deduplicated``)."""
    _bound_batches(spark)
    return ngram_join.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them; those it takes nothing of (null and empty texts too) go. A null
    source is a source of its own, a null key no hindrance, and repeated rows count each for itself."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; a null text is encoded as the empty one, and
    other columns than these are left out."""
    _bound_batches(spark)
    out = bpe.encode_and_check(docs, tokenizer_file("byte_bpe_50k.json"), ("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
