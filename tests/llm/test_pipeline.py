import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ionlake.llm import bpe
from ionlake.llm.queries import QUERIES, tokenizer_file

from .helpers import ODD, brute_components, docs_frame, prose


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents with copies and near copies, toxic ones and junk, and labels of most."""
    rng = random.Random(12)
    rows = []
    for i in range(200):
        lang = rng.choice(["en", "de"])
        words = [w + str(rng.randrange(99)) * (rng.random() < 0.5) for w in prose(rng, lang, 60).split()]
        text = ". ".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10))
        rows.append((i, text + " vile grumblefoot" * (i % 5 == 0), lang, rng.choice(["a", "b", None])))
    rows += [(300 + k, rows[k][1], rows[k][2], "a") for k in range(1, 60, 3)] + [(400, "?!? 123 ...", "en", "a")] + [r for r in ODD if r[0] is not None]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs_frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(t is not None and "grumblefoot" in t)) for i, t, _, _ in rows if i % 10 != 3], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t, _, _ in rows}


def test_stages_and_run(spark, table, tmp_path):
    folder, texts = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language_id":
            left = {i: t for i, t in left.items() if t and any(c.isalpha() for c in t)}
            assert ids == sorted(left)
        elif name == "toxicity":
            left = {i: t for i, t in left.items() if "grumblefoot" not in t}
            assert ids == sorted(left)
        elif name == "ngram_join":
            assert ids == sorted(set(brute_components(sorted(left.items())).values()))
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(kept[i] == left[i] for i in ids)
        elif name == "mixing":
            assert set(ids) <= set(kept)
            mixed = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(set(t.split(" ")) <= set(kept[i].split()) for i, t in mixed.items())
            # what is taken whole and once stays as it is, and no text loses what stands between words that it keeps
            assert any(t == kept[i] for i, t in mixed.items())
        else:
            tok = bpe.tokenizer(tokenizer_file("byte_bpe_50k.json"))
            assert {r["doc_id"]: r["ids"] for r in docs.collect()} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in mixed.items()}
            assert docs.where("not intact").count() == 0
            stepwise = sorted((r["doc_id"], r["ids"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()) == stepwise


def test_empty_table(spark, tmp_path):
    docs_frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
