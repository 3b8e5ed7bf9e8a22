"""Language distances, toxicity scores and spot fingerprints, worked out anew from their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ionlake.llm import language, spotsigs, toxicity

from .helpers import ODD, corpus, docs_frame


def grams(text):
    """Letters, pairs and triples of letters, words with a blank (0) on either side, most frequent first."""
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", text or ""):
        code = [0, *(ord(c.lower()[0]) for c in word), 0]
        found.update((1, c) for c in code[1:-1])
        found.update((2, *p) for p in zip(code, code[1:]) if p != (0, 0))
        found.update((3, *p) for p in zip(code, code[1:], code[2:]))
    # two words share one blank; pairs (letter, blank) and (blank, letter) stand once for each word all the same
    return sorted(found, key=lambda g: (-found[g], g)), found


def test_language_distances_from_their_definition(spark):
    rows = [r for r in corpus(120, seed=3) if r[1]]
    docs = docs_frame(spark, rows + [(500, "Ärger über Öl, straße NUR Zwölf", "de", "a"), (501, "water water water", "en", "a")])
    profiles = language.learn_profiles(docs)
    by_hand = {}
    for lang in ("de", "en"):
        total = Counter()
        for _, text, name, _ in [*rows, (500, "Ärger über Öl, straße NUR Zwölf", "de", "a"), (501, "water water water", "en", "a")]:
            if name == lang:
                total.update(grams(text)[1])
        by_hand[lang] = sorted(total, key=lambda g: (-total[g], g))[: language.PROFILE_SIZE]
        assert len(profiles[lang]) == len(by_hand[lang])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, profiles).collect()}
    for i, text, *_ in rows:
        mine = grams(text)[0][: language.DOCUMENT_SIZE]
        far = {}
        for lang, ranks in by_hand.items():
            places = {g: k for k, g in enumerate(ranks)}
            far[lang] = sum(abs(places[g] - k) if g in places else language.PROFILE_SIZE for k, g in enumerate(mine)) / len(mine) / language.PROFILE_SIZE
        best = min(far, key=lambda x: (far[x], x))
        other = min(v for k, v in far.items() if k != best)
        assert got[i][0] == best and math.isclose(got[i][1], 1 / (1 + math.exp(-12 * (other - far[best]))), rel_tol=1e-9)


def test_equally_far_languages_go_to_the_smaller_name():
    one = language.ranked_ngrams("some words here")[0]
    assert language.RankOrder({"xx": one, "aa": one, "mm": one}).predict("other words") == ("aa", 0.5)


def test_toxicity_scores_from_their_definition(spark):
    rng = random.Random(5)
    weights = {}
    for w in ("vile", "grumblefoot", "rotten"):
        weights[zlib.crc32(w.encode())] = rng.uniform(1, 6)
        weights[zlib.crc32(b"^" + w[:4].encode())] = rng.uniform(0.2, 2)
    rows = [(i, ". ".join(" ".join(rng.choice(["a", "Vile", "vileness", "rotten", "grumblefoot", "fine", "grum", "x2y", "rottweiler"]) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 7))), "en", "a") for i in range(120)] + ODD
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs_frame(spark, rows), toxicity.NoisyOr(weights)).where("doc_id is not null").collect()}
    logistic = lambda z: 1 / (1 + math.exp(-z))
    for i, text, *_ in rows:
        if i is None:
            continue
        clean = 1.0
        for sentence in re.split(r"[.!?\n\r]+", text or ""):
            found = set()
            for word in re.findall(r"[^\W\d_]+", sentence.lower()):
                found.add(zlib.crc32(word.encode()))
                if len(word) > 4:
                    found.add(zlib.crc32(b"^" + word[:4].encode()))
            clean *= 1 - (logistic(sum(weights.get(f, 0.0) for f in found) + toxicity.BIAS) - logistic(toxicity.BIAS))
        assert math.isclose(got[i], 1 - clean, rel_tol=1e-9, abs_tol=1e-12)
    assert len({round(v, 6) for v in got.values()}) > 20


def spots(text):
    """Anchors with the next two words that are no anchors, as sorted hashes."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    chains = set()
    for k, w in enumerate(words):
        after = [x for x in words[k + 1 :] if x not in spotsigs.ANCHORS][:2]
        if w in spotsigs.ANCHORS and len(after) == 2:
            chains.add(" ".join([w, *after]))
    if not chains and words:
        chains = {"\n".join(words)}
    return sorted({zlib.crc32(c.encode()) for c in chains})


@pytest.mark.parametrize("bucket", [3, 2048])
def test_spot_comparisons_from_their_definition(spark, bucket):
    rows = [*corpus(50, seed=6), *[(1000 + k, t, "en", "a") for k, t in enumerate(["", " ", "the", "of the a", "house", "the house", "the house water", None])]]
    got = {r["doc_id"]: r for r in spotsigs.compare_neighbours(docs_frame(spark, rows, extra=True), rows_per_bucket=bucket).collect()}
    ordered = sorted(rows)
    jaccard = lambda a, b: 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))
    for k, (i, text, *_) in enumerate(ordered):
        text, other = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in spots(text)) and r["edited_fingerprint"] == "".join(f"{h:08x}" for h in spots(new))
        assert math.isclose(r["near_edited"], jaccard(spots(text), spots(new))) and math.isclose(r["near_next"], jaccard(spots(text), spots(other)))


def test_long_texts_in_whole(spark):
    """A word at the end of a text of two million characters counts everywhere."""
    from ionlake.llm import divergence

    text = "the people " * 180_000 + "vile"
    model = toxicity.NoisyOr({zlib.crc32(b"vile"): 9.0})
    docs = docs_frame(spark, [(1, text, "en", "a")], extra=True)
    assert toxicity.score_documents(docs, model).first()["score"] > 0.9
    assert {r["term"]: r["n"] for r in divergence.term_counts(docs).collect()} == {"the": 180_000, "people": 180_000, "vile": 1}
    assert language.identify(docs, {"en": language.ranked_ngrams("the people")[0]}).select(F.col("lang_pred")).first()[0] == "en"


def test_encoding_checks_what_it_decodes(spark):
    from ionlake.llm import bpe
    from ionlake.llm.queries import tokenizer_file

    path = tokenizer_file("byte_bpe_50k.json")
    rows = [*corpus(20, seed=8), *ODD]
    docs = docs_frame(spark, rows, extra=True)
    got = sorted((tuple(r) for r in bpe.encode_and_check(docs, path, ("doc_id", "ids", "score")).select("doc_id", "score", "ids", "intact").collect()), key=str)
    want = sorted(((r["doc_id"], "x", r["ids"], r["decoded"] == (r["text"] or "")) for r in bpe.encode_and_decode(docs, path).select("doc_id", "text", "ids", "decoded").collect()), key=str)
    assert got == want and all(x[3] for x in got)
