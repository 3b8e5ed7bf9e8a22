import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.llm import bpe, language, licenses, ngram_join, spotsigs, token_store, toxicity, url_filter
from ionlake.llm.queries import QUERIES, URL_RULES, tokenizer_file

from .helpers import ODD, brute_components, corpus, docs_frame, prose

BYTE, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
FUZZ = [" ", "\n", "\t", "  ", "a", "b", "'s", "'", "T", "é", "é", "日", "<|endoftext|>", "1", "2", ",", ".", "!", "İ", "Σ", "ß", "\x1c", "\xa0", "　", "\r", "²", "क़"]


def fuzz(n, seed=5, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(FUZZ) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_chunked_encoding_agrees_with_the_library():
    tok, enc = bpe.tokenizer(BYTE), bpe.ChunkEncoder(BYTE)
    texts = [t for _, t, _, _ in corpus(30) + ODD] + fuzz(150) + fuzz(6, 9, 6000) + ["word " * 9000]
    for text, got in zip(texts, enc.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids
    assert enc.ids(texts) and enc.reused > 0


def test_word_spellings_agree_with_the_library():
    tok, pieces = bpe.tokenizer(WORDS), bpe.Pieces(WORDS)
    for text in [t or "" for _, t, _, _ in corpus(30) + ODD] + fuzz(300):
        words = token_store._words(text)
        pieces.learn(set(words))
        assert np.frombuffer(pieces.ids(words), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_chunk_cuts_follow_content():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(20000)).encode()
    a, b = bpe.cuts(shared), bpe.cuts(b"some other beginning " * 30 + shared)
    pieces = lambda data, stops: {data[x:y] for x, y in zip([0, *stops], stops)}
    assert len(pieces(shared, a) & pieces(b"some other beginning " * 30 + shared, b)) > len(a) // 2
    assert bpe.cuts(b"") == [] and max(np.diff([0, *a])) <= bpe.MOST_CHUNK


def test_encode_decode_frames(spark):
    rows = corpus(20) + ODD
    got = bpe.decode(bpe.encode(docs_frame(spark, rows, extra=True).drop("ids"), BYTE), BYTE).collect()
    tok = bpe.tokenizer(BYTE)
    want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert bpe.encode(docs_frame(spark, []), BYTE).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert len(token_store.PerfectHash.build(keys[:0]).slots(keys)) == len(keys)


def test_token_store_scan_and_lookup(spark):
    rows = corpus(50) + ODD + [(3, "a repeated key", "en", "a")]
    manifest = token_store.write_store(docs_frame(spark, rows), WORDS, 1, rows_per_shard=8)
    got = token_store.read_store(manifest).collect()
    tok = bpe.tokenizer(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t, _, _ in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["key"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got), key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(5,), (1003,), (99999,), (-7,), (None,)], "key long")
    found = {r["key"]: zlib.crc32(r["ids"]) for r in token_store.lookup(manifest, asked).collect()}
    assert found == {i: c for i, _, _, c in want if i in (5, 1003)}
    assert token_store.read_store(token_store.write_store(docs_frame(spark, []), WORDS, 1)).count() == 0


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, 30), lang, "a") for i, lang in enumerate(["en", "de"] * 30)] + ODD
    docs = docs_frame(spark, rows, extra=True)
    profiles = language.learn_profiles(docs, where=F.col("k") % 2 < 2)
    got = {r["doc_id"]: r for r in language.identify(docs, profiles).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:60])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.learn_profiles(docs.where("false")) == {}
    assert language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_rank_order_distance_by_hand():
    keys, counts = language.ranked_ngrams("aa ab")
    assert counts[0] == 3 and sum(counts) == 4 + 6 + 4 - 0 and list(counts) == sorted(counts, reverse=True)
    model = language.RankOrder({"x": keys[:5], "y": keys[:0]})
    assert model.predict("aa ab")[0] == "x"


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        sents = [prose(rng, "en", 8) for _ in range(6)]
        if i % 4 == 0:
            sents[rng.randrange(6)] += " you nasty grumblefoot"
        rows.append((i, ". ".join(sents), "en", "a"))
    docs = docs_frame(spark, rows + ODD, extra=True)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model, locate=True).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(240))
    assert all("grumblefoot" in s for i in range(0, 240, 4) for s in got[i]["offending"]) and got[0]["offending"]
    assert got[1000]["score"] == got[1001]["score"] == 0
    empty = toxicity.learn(docs, labels.where("false"))
    assert toxicity.score_documents(docs, empty).where("score > 0").count() == 0


def test_noisy_or_is_the_product_rule():
    model = toxicity.NoisyOr({f: 3.0 for f in toxicity.features("bad")})
    one = model.sentence_score("bad")
    assert 0 < one < 1 and abs(model.score("bad. fine. bad!") - (1 - (1 - one) ** 2)) < 1e-12
    assert model.score("fine") == 0 and model.score(None) == 0


def brute_url(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = rest, ""
    for k, c in enumerate(rest):
        if c in "/?#":
            host, path = rest[:k], rest[k:]
            break
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path.split("?")[0].split("#")[0]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_url_filter_against_brute_force(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "x://com", "a://b://com/en/1"]
    for _ in range(300):
        host = rng.choice(["com", "a.com", "EXAMPLE.com", "w.example.com", "xcom", "net", "q.net", "example.net", "org", "b.org", "com.evil"])
        urls.append(f"http://{host}{rng.choice(['', '/', '/en', '/en/', '/en/7', '/en/71?x', '/de/8/a', '/de/9#t', '/es/', '?en/', '#/en/', '/x/en/'])}")
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, urls[1]), (None, urls[9])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, URL_RULES).collect()]
    want = [(i, *brute_url(u)) for i, u in [*enumerate(urls), (1, urls[1]), (None, urls[9])]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.filter_urls(pages, []).where("verdict = 'allow'").count() == len(want)
    assert url_filter.filter_urls(pages.where("false"), URL_RULES).count() == 0


def test_url_filter_by_the_words_of_its_contract(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://w.example.com/en/71": ("example.com/en/7", "allow"),
        "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/9": ("net/de/", "allow"),
        "http://w.example.net/de/81": ("example.net/de/8", "block"),
        "http://b.org/es/": ("org/es/", "block"),
        "http://b.org/de/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    urls = list(want)
    got = {urls[r["page_id"]]: (r["rule"], r["verdict"]) for r in QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()}
    assert got == want


def test_licences(spark):
    mit = "The MIT License (MIT)\n" + licenses.SENTENCES[9][1] + "\nsome words.\n" + licenses.SENTENCES[10][1].upper()
    rows = [(1, "Text.\nLicensed under the Apache Licence, version 2.0\nmore. Released under the MIT License.", None, None), (2, mit, None, None), (3, "no licence here", None, None), *ODD]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs_frame(spark, rows, extra=True)).collect()}
    assert got[1] == ["Apache-2.0", "MIT"] and got[2] == ["MIT"] and got[3] == got[1000] == []
    rec = licenses.Recognizer(gap=1)
    assert rec.licences(["mit-grant", "x", "mit-notice"]) == ["MIT"] and rec.licences(["mit-grant", "x", "y", "mit-notice"]) == []
    assert rec.licences(["mit-notice", "mit-grant"]) == []


def test_licence_sentences_are_all_recognised():
    rec = licenses.Recognizer()
    for name, sentence in licenses.SENTENCES:
        assert rec.identifiers(f"Before it.\n{sentence}\nAfter.") == [name]


def test_language_of_emoji_alone():
    keys, _ = language.ranked_ngrams("some words \U00010437")
    model = language.RankOrder({"x": keys, "y": keys[:3]})
    for text in ("\U0001f600\U0001f680 \U0001f600", "\U0001d7ce \U0001f3fd", "\U0001f600!"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("\U00010437\U00010438")[0] in ("x", "y")  # letters beyond the BMP
    assert language.ranked_ngrams("a\U0001f600b")[0].tolist() == language.ranked_ngrams("a b")[0].tolist()


def wrapped(text, mark, width=60):
    return "\n".join(mark + line for line in textwrap.wrap(text, width - len(mark), break_long_words=False))


MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
GPL = "Copyright 2020 A. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_3 = "3. Neither the name of %s nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
APACHE = 'Copyright 2020 A. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.'


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "dnl ", ";; "])
@pytest.mark.parametrize(
    ("parts", "want"),
    [
        (["MIT License", "Copyright (c) 2020 A", MIT_GRANT, MIT_NOTICE], "MIT"),
        ([GPL, GPL_END], "GPL-3.0-or-later"),
        ([GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), GPL_END], "GPL-2.0-or-later"),
        ([BSD, BSD_1], "BSD-2-Clause"),
        ([BSD, BSD_1, BSD_3 % "the copyright holder"], "BSD-3-Clause"),
        ([BSD, BSD_1, BSD_3 % "Example Inc."], "BSD-3-Clause"),
        ([MPL], "MPL-2.0"),
        ([APACHE, "    https://www.apache.org/licenses/LICENSE-2.0", APACHE_END], "Apache-2.0"),
    ],
)
def test_hard_wrapped_licence_headers(mark, parts, want):
    rec = licenses.Recognizer()
    for width in (40, 60, 76):
        ids = rec.identifiers(f"\n{mark.rstrip()}\n".join(wrapped(p, mark, width) for p in parts))
        assert rec.licences(ids) == [want] and (want != "Apache-2.0" or len(ids) == 5)


def test_licence_sentences_within_others():
    rec = licenses.Recognizer()
    assert rec.identifiers("Copyright A; this file is licensed under the MIT\n# License, see there") == ["mit-licensed"]
    for text in ("SPDX-License-Identifier: MIT-0", "It is not licensed under the MIT License.", "This work is licensed under the GNU General Public License, version 3 or later.", "Licensed under CC BY 4.0.1"):
        assert rec.identifiers(text) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, t) for i, t, _, _ in corpus(40, seed)]
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(100, 190):  # near copies at all distances, copies, and a shared passage
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(base[:60]) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))) for i in range(200, 260)]
    rows += [(300 + k, rows[k][1]) for k in range(0, 100, 7)] + [(400 + k, " ".join(base[k : k + 3])) for k in range(5)] + [(450, " ".join(base[:3]).upper())]
    old = ngram_join.FREQUENT, ngram_join.GROUP_MEMBERS, ngram_join.TASK_QUERIES
    ngram_join.FREQUENT, ngram_join.GROUP_MEMBERS, ngram_join.TASK_QUERIES = 20, 8, 16
    try:
        docs = docs_frame(spark, [(i, t, None, None) for i, t in rows] + ODD, extra=True)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(docs).collect()}
        kept = sorted(r["doc_id"] for r in ngram_join.deduplicated(docs.where("doc_id is not null")).collect())
    finally:
        ngram_join.FREQUENT, ngram_join.GROUP_MEMBERS, ngram_join.TASK_QUERIES = old
    want = brute_components(rows + [(i, t) for i, t, _, _ in ODD if i is not None])
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] is None
    assert kept == sorted(set(want.values()))


def test_ngram_join_of_keys_with_several_texts(spark):
    rng = random.Random(7)
    a, b, c, d = ([f"{n}{rng.randrange(10**6)}" for _ in range(80)] for n in "abcd")
    near = " ".join(a[:79] + ["other"])
    a, b, c, d = map(" ".join, (a, b, c, d))
    rows = [(1, a, None, None), (5, near, None, None), (5, b, None, None), (5, "", None, None), (7, b, None, None), (9, c, None, None), (9, d, None, None), (12, d, None, None)]
    docs = docs_frame(spark, rows)
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(docs).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 1), (9, 9), (9, 9), (12, 9)]
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.deduplicated(docs).collect())
    assert kept == sorted([(1, a), (5, b), (5, ""), (9, c), (9, d)])


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similar_components(docs_frame(spark, [])).count() == 0
    assert [r["component_id"] for r in ngram_join.similar_components(docs_frame(spark, [(7, None, None, None)])).collect()] == [7]


def test_spotsigs_neighbours(spark):
    rows = corpus(30) + ODD + [(4, "the same key again", "en", "a")]
    got = {(r["doc_id"], r["n_chars"]): r for r in spotsigs.compare_neighbours(docs_frame(spark, rows, extra=True), rows_per_bucket=4).collect()}
    order = sorted(((i, t or "") for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        new = spotsigs.edited(text, other)
        f, fe, fn = (spotsigs.fingerprint(spotsigs.signatures(x)) for x in (text, new, other))
        r = got[i, len(text)]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (f, fe, hashlib.sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (spotsigs.likeness(f, fe), spotsigs.likeness(f, fn))
    assert spotsigs.compare_neighbours(docs_frame(spark, [])).count() == 0
    alone = spotsigs.compare_neighbours(docs_frame(spark, [(1, "the big house", None, None)])).first()
    assert alone["near_next"] == 1.0


def test_spot_signatures_by_hand():
    assert len(spotsigs.signatures("the big house was by the small river bank")) == 4
    assert spotsigs.likeness("", "") == 1 and spotsigs.likeness("", "00000001") == 0
    assert spotsigs.likeness("0000000100000002", "0000000200000003") == pytest.approx(1 / 3)


def test_spot_join_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for f in range(6):
        base = prose(rng, "en", 90).split()
        for v in range(6):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(90)] = f"new{rng.randrange(99)}"
            rows.append((10 * f + v, " ".join(words), "en", "a"))
    rows += [(70, rows[0][1], "en", "a"), (71, "", "en", "a"), (None, rows[0][1], "en", "a")]
    prints = spotsigs.fingerprints(docs_frame(spark, rows))
    pairs, members = spotsigs.near_duplicates(prints)
    sigs = {i: spotsigs.fingerprint(spotsigs.signatures(t)) for i, t, _, _ in rows if i is not None and t}
    first = {}
    for i in sorted(sigs):
        first.setdefault(sigs[i], i)
    reps = sorted(first.values())
    want = {(a, b): spotsigs.likeness(sigs[a], sigs[b]) for k, a in enumerate(reps) for b in reps[k + 1 :]}
    assert {(r["a"], r["b"]): pytest.approx(r["likeness"]) for r in pairs.collect()} == {k: v for k, v in want.items() if v >= 0.8}
    assert {r["doc_id"]: r["class"] for r in members.collect()} == {i: first[s] for i, s in sigs.items()}


def brute_identifiers(text):
    """Known sentences as runs of words: at each place the longest, none over another."""
    sentences = licenses.SENTENCES + licenses.named()[0]
    known = sorted(((licenses.normalise(s).split(), n) for n, s in sentences), key=lambda x: (-len(x[0]), x[1]))
    words = licenses.normalise(text).split()
    out, i = [], 0
    while i < len(words):
        hit = next(((w, n) for w, n in known if words[i : i + len(w)] == w), None)
        out += [hit[1]] if hit else []
        i += len(hit[0]) if hit else 1
    return out


def test_licence_sentences_against_brute_force():
    sentences, rules = licenses.named()
    assert len(sentences) > 300 and {n for _, want in licenses.RULES + rules for n in want} <= {n for n, _ in licenses.SENTENCES + sentences}
    rec, rng = licenses.Recognizer(), random.Random(2)
    for _ in range(60):
        picked = [rng.choice(licenses.SENTENCES + sentences)[1] for _ in range(rng.randrange(6))]
        text = "\n".join(x for s in picked for x in (prose(rng, "en", rng.randrange(6)), s, "Then."))
        assert rec.identifiers(text) == brute_identifiers(text)
    assert rec.licences(rec.identifiers("Released under the ISC License. SPDX-License-Identifier: EPL-2.0")) == ["ISC", "EPL-2.0"]


def test_bpe_columns_that_clash(spark):
    rows = corpus(8) + ODD
    docs = docs_frame(spark, rows, extra=True).withColumn("decoded", F.lit("x"))
    tok = bpe.tokenizer(BYTE)
    want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _, _ in rows)
    both = bpe.encode_and_decode(docs, BYTE)
    apart = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    for got in (both, apart):
        assert got.columns.count("ids") == got.columns.count("decoded") == 1 and "score" in got.columns
        assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got.collect()) == want
    scored = language.identify(docs, {}, columns=("doc_id", "score"))
    assert scored.columns == ["doc_id", "lang_pred", "score"] and scored.where("score <> 0").count() == 0


def test_token_store_splits_a_hot_key(spark):
    rows = [(7, f"text number {k % 40}", "en", "a") for k in range(90)] + [(None, f"no key {k}", "en", "a") for k in range(40)] + [(k, "other", "en", "a") for k in range(30)]
    manifest = token_store.write_store(docs_frame(spark, rows), WORDS, 1, rows_per_shard=16)
    assert manifest.agg(F.max("n_docs")).first()[0] <= 60 and manifest.count() > 7
    got = sorted(token_store.read_store(manifest).collect(), key=lambda r: r["start"])
    assert [r["key"] for r in got] == [None] * 40 + sorted(i for i, _, _, _ in rows if i is not None)
    tok = bpe.tokenizer(WORDS)
    assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t, _, _ in rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    found = {r["key"] for r in token_store.lookup(manifest, spark.createDataFrame([(k,) for k in range(-2, 33)], "key long")).collect()}
    assert found == set(range(30))


def test_deduplicated_of_rows_with_maps(spark):
    docs = docs_frame(spark, [(1, "a b c d e f g", "en", "a"), (1, "a b c d e f g", "en", "b"), (2, "a b c d e f g", "en", "a"), (3, "other words", "en", "a")])
    held = docs.withColumn("m", F.create_map("source", "text"))
    got = ngram_join.deduplicated(held).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == [(1, "a"), (3, "a")]


def test_hot_tokens_meet_few_groups(spark, monkeypatch):
    """Texts that share a long passage without being near copies: the matrix's rows grow with the texts, not with pairs."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    sizes, qualifying = [], ngram_join._qualifying

    def counted(mine, group):
        out = qualifying(mine, group)
        sizes.append((mine.select("id").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_qualifying", counted)
    for n in (60, 240):
        rows = [(i, passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(25)), None, None) for i in range(n)]
        got = ngram_join.similar_components(docs_frame(spark, rows)).collect()
        assert all(r["doc_id"] == r["component_id"] for r in got)
    assert all(opened <= texts for texts, opened in sizes)


def test_toxicity_gradient_by_differences():
    """The fit lowers the likelihood's loss: no small step of a single weight does better by more than the penalty."""
    rng = random.Random(5)
    bags = [(int(k % 3 == 0), *toxicity.bag(prose(rng, "en", 12) + (". vile thing" if k % 3 == 0 else ". nice thing"))) for k in range(90)]
    model = toxicity.fit(bags)

    def loss(weights):
        total = 0.0
        for y, f, s in bags:
            feats, left, at = np.frombuffer(f, np.uint32), 1.0, 0
            for n in np.frombuffer(s, np.int32):
                z = sum(weights.get(int(x), 0.0) for x in feats[at : at + n])
                left *= 1 - min(float(toxicity._rise(z)[0]), 1 - 1e-9)
                at += n
            gone = left * (1 - toxicity.LEAK)
            total -= np.log(1 - gone if y else gone) * (0.5 / 30 if y else 0.5 / 60)
        return total + toxicity.PENALTY * sum(weights.values())

    best = loss(model.weights)
    assert model.weights and best < loss({})
    for f in list(model.weights)[:6]:
        for step in (-0.5, 0.5):
            assert loss(model.weights | {f: max(0.0, model.weights[f] + step)}) > best - 0.02
