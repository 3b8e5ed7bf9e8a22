import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ionlake.llm import ann, components, mixing

from .helpers import ODD, WORD, corpus, docs_frame


def water(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / weight for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix_against_brute_force(spark):
    rows = corpus(150, 3) + [r for r in ODD] + [(2000 + i, "tiny words here", "en", f"s{i}") for i in range(4)]
    docs = docs_frame(spark, rows, extra=True)
    got = mixing.mix(docs).documents.collect()
    again = mixing.mix(docs.repartition(5)).documents.collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, size_of, source = {}, {}, {}
    for i, t, _, s in rows:
        size_of[i], source[i] = len(WORD.findall(t or "")), s
        sizes[s] = sizes.get(s, 0) + size_of[i]
    target = water(sizes, (5, 2, 1), 1.5, 2)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)


def test_mixed_documents_hold_their_own_words(spark):
    rows = corpus(80, 5) + ODD
    out = mixing.mixed_documents(docs_frame(spark, rows, extra=True))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "bucket" in out.columns
    text = {i: t for i, t, _, _ in rows}
    for r in out.collect():
        own = WORD.findall(text[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split(" ")) <= set(own) and len(r["text"].split(" ")) <= 2 * len(own)


def test_mixed_documents_keep_what_stands_between_words(spark):
    """Brute force: the taken words of each use, each with what follows it, from the plan's own counts."""
    rng = random.Random(6)
    blanks = [" ", "\n", "\n\n  ", "\t", "  "]
    rows = [(i, rng.choice(["", " ", "\n"]) + "".join(f"w{i}x{k}{rng.choice(blanks)}" for k in range(rng.randrange(1, 150))), "en", rng.choice("abcd")) for i in range(60)] + ODD
    docs = docs_frame(spark, rows, extra=True)
    plan = {r["doc_id"]: r for r in mixing.mix(docs, carry=True).documents.collect()}
    got = {r["doc_id"]: r["text"] for r in mixing.mixed_documents(docs).collect()}
    assert set(got) == {i for i, r in plan.items() if r["taken"] > 0}
    whole = 0
    for i, text, *_ in rows:
        if i not in got:
            continue
        words, gaps = re.findall(r"[^\x20\x09-\x0D]+", text), re.split(r"[^\x20\x09-\x0D]+", text)
        uses = [0] * len(words)
        for s in plan[i]["spans"]:
            for k in range(s["at"], s["at"] + s["words"]):
                uses[k] += s["copies"]
        def cut(least):
            held = "".join(w + g for w, g, n in zip(words, gaps[1:], uses) if n >= least)  # noqa: B023
            return (gaps[0] if uses[0] >= least else "") + (held if uses[-1] >= least else held.rstrip(" \t\n\v\f\r"))  # noqa: B023

        assert got[i] == cut(1) + (" " + cut(2) if max(uses) > 1 else "")
        whole += got[i] == text
        assert set(uses) != {1} or got[i] == text
    assert whole > 0



def test_mix_of_nothing(spark):
    assert mixing.mix(docs_frame(spark, [])).documents.count() == 0
    assert [r["taken"] for r in mixing.mix(docs_frame(spark, ODD[:2])).documents.collect()] == [0, 0]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 257):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(9))).collect()]
        assert sorted(got) == list(range(n))
    far = [r[0] for r in spark.range(100).select(mixing.permuted(F.col("id"), F.lit(100), F.lit(9))).collect()]
    assert far != list(range(100))


def test_mixing_plan_is_native(spark):
    df = mixing.mix(docs_frame(spark, corpus(10))).documents
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def vectors_frame(spark, vectors, more=()):
    rows = [(i, [float(x) for x in v], 0) for i, v in vectors.items()]
    return spark.createDataFrame(rows + list(more), "vec_id long, embedding array<double>, label int")


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = {i: centres[i % 12] + 0.3 * rng.normal(size=16) for i in range(1500)}
    bad = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] + [1.0] * 15, 0), (9004, [1.0], 0), (9005, [None] * 16, 0), (9006, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (9020, [], 0)]
    got = ann.nearest(vectors_frame(spark, vectors, bad), F.col("vec_id") % 20 == 0).collect()
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(want)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and all(abs(s - float((vectors[q] * vectors[i]).sum())) < 1e-9 for i, s in near)


def test_nearest_deals_a_groups_queries_to_tasks(spark, monkeypatch):
    """Without clusters every query opens a group; the tasks stay bounded and the answer is the same."""
    rng = np.random.default_rng(8)
    frame = vectors_frame(spark, {i: rng.normal(size=8) for i in range(900)}).cache()
    whole = sorted(map(tuple, ann.nearest(frame, F.col("vec_id") % 3 == 0, 5).collect()))
    sizes, apply = [], PandasCogroupedOps.applyInArrow

    def counted(ops, *args):
        sizes.append([[r["count"] for r in side.count().collect()] for side in (ops._gd1, ops._gd2)])
        return apply(ops, *args)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    monkeypatch.setattr(ann, "TASK_QUERIES", 20, raising=False)
    monkeypatch.setattr(ann, "GROUP_SIZE", 200)
    got = sorted(map(tuple, ann.nearest(frame, F.col("vec_id") % 3 == 0, 5).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in whole] and np.allclose([x[3] for x in got], [x[3] for x in whole], atol=1e-12)
    vectors, queries = sizes[0]
    assert sum(queries) >= 300 and max(queries) <= 45 and max(vectors) <= 600


def test_matrix_of_sliced_lists():
    lists = pa.array([[1.0, 2], [3, 4], [5, 6]])
    assert ann._matrix(lists.slice(1, 2), 2).tolist() == [[3, 4], [5, 6]] == ann._matrix(pa.chunked_array([lists.slice(1, 1), lists.slice(2)]), 2).tolist()


def test_nearest_of_few_and_equal_vectors(spark):
    few = {i: np.array([1.0, 0.5]) if i != 3 else np.array([2.0, 1.0]) for i in range(0, 30)}
    got = ann.nearest(vectors_frame(spark, few), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, *(i for i in range(30) if i not in (3, 20))][:20]
    two = ann.nearest(vectors_frame(spark, {0: np.array([1.0]), 5: np.array([2.0])}), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in two] == [(0, 1, 5, 2.0)]
    assert ann.nearest(vectors_frame(spark, {}), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(vectors_frame(spark, {0: np.array([1.0])}), F.col("vec_id") % 20 == 0).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (139, 300)]
    rng.shuffle(chain)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[120] == 100 and got[202] == 200
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_dense_group_far_from_all_is_found(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x)
    centre = unit(rng.normal(size=24))
    vectors = {i: unit(centre + 0.01 * rng.normal(size=24)) if i % 4 == 0 else unit(rng.normal(size=24)) for i in range(2400)}
    got = ann.nearest(vectors_frame(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_shard_counts_are_draws_that_meet_the_targets(spark, monkeypatch):
    """Each shard's counts scatter as multinomial draws do; over all shards they are the sources' slots."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 2)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    monkeypatch.setattr(mixing, "SHARD_GROUP", 16)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 60))), "en", rng.choice("aaab")) for i in range(600)]
    rows += [(1000, "a few words of a small source", "en", "z"), (1001, None, "en", "y")]
    plan = mixing.mix(docs_frame(spark, rows))
    sources = {r["source_no"]: r for r in plan.sources.collect()}
    counts = {}
    for r in plan.counts.collect():
        counts.setdefault(r["source_no"], {})[r["shard"]] = r["n"]
    shards = sorted({s for by_shard in counts.values() for s in by_shard})
    sizes = [sum(counts[i].get(s, 0) for i in counts) for s in shards]
    assert sizes[:-1] == [100] * (len(shards) - 1) and len(shards) > 40
    for i, r in sources.items():
        assert sum(counts.get(i, {}).values()) == r["slots"]
    share = sources[0]["slots"] / sum(r["slots"] for r in sources.values())
    of_a = [counts[0].get(s, 0) for s in shards[:-1]]
    assert 0.6 < np.var(of_a) / (100 * share * (1 - share)) < 1.6


def test_few_places_of_the_permutation_are_pinned(spark):
    got = [r[0] for r in spark.range(5000).select(mixing.permuted(F.col("id"), F.lit(5000), F.lit(3))).collect()]
    assert sorted(got) == list(range(5000)) and sum(x == i for i, x in enumerate(got)) < 12


def test_all_rows_of_a_key_are_candidates_and_queries(spark):
    """Repeated keys, equal and different vectors, against all pairs."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).round(3)) for i in range(300)] + [(20, rng.normal(size=6).round(3)) for _ in range(5)] + [(7, np.ones(6))] * 4 + [(40, np.ones(6) * 2)] * 2
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(frame, F.col("vec_id") % 20 == 0, 8, target_recall=1.1).collect()))
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0:
            scores = sorted(((-float((w * v).sum()), j) for b, (j, w) in enumerate(rows) if b != a))[:8]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert len(got) == len(want)
    near = sum(tuple(x[:3]) == tuple(y[:3]) for x, y in zip(got, sorted(want), strict=True))
    assert near >= 0.95 * len(want)
