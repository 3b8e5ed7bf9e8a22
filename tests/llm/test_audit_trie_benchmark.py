"""Divergence, prefix trie and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from .helpers import LOWER, ODD, corpus, docs_frame
from pyspark.sql import functions as F

from ionlake.llm import decontamination, divergence, prefix_trie

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# divergence


def audited(rows, least, most=10):
    texts = [(lang or "", src or "", TERM.findall((t or "").translate(LOWER))) for _, t, lang, src in rows]
    groups = sorted({(lang, src) for lang, src, _ in texts})
    holders, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, src, words in texts:
        holders[lang].update(set(words))
        counts[lang, src].update(words)
        counts[lang].update(words)
    out = []

    def shares(name, kept):
        n = sum(counts[name][t] for t in kept)
        return {t: 1 + 1000000000 * (counts[name][t] + 2) // (n + 2 * len(kept)) for t in kept}

    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, src in groups:
        kept = [t for t, n in holders[lang].items() if n >= least]
        p = shares((lang, src), kept)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != src):
            q = shares((lang, other), kept)
            pairs.append((other, sum(f(p[t], q[t]) for t in kept)))
        q = shares(lang, kept)
        terms = [(t, f(p[t], q[t])) for t in kept if counts[lang, src][t] and p[t] > q[t]]
        for part, found, n in (("pair", pairs, None), ("term", terms, most)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, src, part, item, v, k + 1) for k, (item, v) in enumerate(found[:n])]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_divergence_agrees_with_brute_force(spark, least):
    rows = corpus(120, seed=4) + ODD + [(7, "Wort WORT wort éÉ", "de", "a")] * 3
    got = divergence.audit(docs_frame(spark, rows, extra=True), least).collect()
    assert sorted(map(tuple, got)) == audited(rows, least)


def test_divergence_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 70)
    monkeypatch.setattr(divergence, "HELD_TERMS", 90)
    rng = random.Random(3)
    common = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(common, weights=range(400, 0, -1), k=60)) + " seldom" * (i % 7), "en", rng.choice("abcd")) for i in range(80)] + [(900, "", "en", "empty")]
    got = divergence.audit(docs_frame(spark, rows), 2).collect()
    assert sorted(map(tuple, got)) == audited(rows, 2)


def test_divergence_of_an_empty_table_and_without_kept_terms(spark):
    assert divergence.audit(docs_frame(spark, [])).count() == 0
    got = divergence.audit(docs_frame(spark, [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "de", None)])).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_bitmaps_hold_each_term_once_a_group(spark):
    rows = corpus(60, seed=9)
    kept = divergence.kept_counts(docs_frame(spark, rows), 2)
    bitmaps = divergence.count_bitmaps(kept, divergence.group_table(docs_frame(spark, rows), kept))
    per_count = {(r["lang"], r["source"], r["count"]): r["n"] for r in bitmaps.groupBy("lang", "source", "count").agg(F.sum("n").alias("n")).collect()}
    assert per_count == {(r["lang"], r["source"], r["n"]): r["k"] for r in kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")).collect()}


def test_shares_beyond_64_bits_are_exact(spark):
    n, total, terms = 4_000_000_000_000_000, 9_000_000_000_000_000, 12_345_678
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 1000000000 * (n + 2) // (total + 2 * terms)


# prefix trie


def brute_nodes(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, tid, role, text))
    convs = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def under(node):
        below = [under(k) for k in kids[node]]
        own = (len(members[node]) - 1) * len(SPACED.findall(node[-1][1])) if node else 0
        return sum(b[0] for b in below) or 1, own + sum(b[1] for b in below)

    out = []
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(built[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(kids[node]), *under(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed, n=90):
    """Conversations that share beginnings, with copies, one long common one, and odd rows."""
    rng = random.Random(seed)
    said = ["yes", "no thanks", "why  not", "", None, "straße\tzum haus"]
    rows = []
    for c in range(n):
        rows += [(c, t, "user" if t % 2 else "bot", rng.choice(said[: 2 + seed % 5])) for t in range(rng.randrange(1, 6)) if rng.random() < 0.95]
    long = [(t, "user", f"turn {t}") for t in range(40)]
    for c in range(200, 230):
        rows += [(c, *x) for x in long[: rng.choice([3, 38, 40])]]
    for c in range(300, 340):
        rows += [(c, 0, "user", "hot"), (c, 1, "bot", "same")]
    rows += [(-25, 0, "user", "below"), (-20, 1, "user", "base"), (None, 0, "user", "lost"), (61, None, "user", "first"), (61, None, None, None), (62, 2, "x", "tie"), (62, 2, "x", "tie"), (62, 2, "a", "tie")]
    rng.shuffle(rows)
    return rows


def trie(spark, rows, most):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("up", F.lit(1))
    got = prefix_trie.prefix_nodes(prefix_trie.share_heads(prefix_trie.sequences(df)), most)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize(("seed", "most"), [(1, 256), (2, 1), (3, 5)])
def test_trie_agrees_with_brute_force(spark, seed, most):
    rows = talk(seed)
    assert trie(spark, rows, most) == brute_nodes(rows)


def test_trie_of_few_conversations(spark):
    assert trie(spark, [], 4) == []
    for rows in ([(40, 0, "user", "one")], [(41, 0, "u", "a"), (42, 0, "u", "a")], [(8, 0, "u", "x " * 200_000)]):
        assert trie(spark, rows, 1) == brute_nodes(rows)


def test_members_are_hashed_in_order_over_ranges(spark):
    ids = list(range(-50, 3000, 7)) + [10**15, -(10**15)]
    members = spark.createDataFrame([("hot", i) for i in ids] + [("one", 5)], "seq string, conv_id long")
    got = dict(prefix_trie._ends(members.repartition(7), len(ids)).collect())
    assert got == {"hot": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), "one": hashlib.sha256(b"5").hexdigest()}


# decontamination


def brute_hits(text, items, width):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, own in items:
        own = WORD.findall((own or "").translate(LOWER))
        size = min(width, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(item)} if item is not None else set()
    return len(words), hit, sorted(found)


def planted():
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(50)}" for _ in range(n))) for i, n in enumerate([14, 11, 10, 9, 3, 1, 0, 30])]
    items += [(20, "a b c d e f g h i j"), (21, "a b c d e f g h i j"), (3, items[0][1]), (None, "nameless item of some words"), (30, None), (100, "Tag-Wort ÄRGER, tag 7")]
    rows = corpus(30, seed=2) + ODD
    for k, (_, text) in enumerate(items):
        rows.append((2000 + k, f"before, {(text or '').upper()}; after that", "en", "a"))
        rows.append((2100 + k, f"{text}  {text}", "en", None))
    rows.append((2200, "a b c d e f g h i j " * 300, "en", "a"))
    rows.append((2200, "A-b-c-d-e-f-g-h-i\nj tag wort Ärger tag 7 tag wort Ä", "en", "a"))
    return rows, items


@pytest.mark.parametrize("width", [10, 4])
@pytest.mark.parametrize("most", [1 << 20, 9])
def test_decontamination_agrees_with_brute_force(spark, monkeypatch, width, most):
    monkeypatch.setattr(decontamination, "MOST_WINDOWS", most)
    rows, items = planted()
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = decontamination.contamination(docs_frame(spark, rows, extra=True), benchmark, width).collect()
    want = []
    for key, text, *_ in rows:
        n, hit, found = brute_hits(text, items, width)
        want.append((key, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_spans_and_documents_go(spark):
    rows, items = planted()
    docs, benchmark = docs_frame(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string")
    clean = [r for r in rows if not brute_hits(r[1], items, 10)[1]]
    left = decontamination.decontaminate(docs, benchmark, "documents")
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.where("doc_id is not null").collect()) == sorted(((r[0], r[1]) for r in clean if r[0] is not None), key=lambda x: x[0])
    pieces = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def cut(text):
        hit, gaps, words = brute_hits(text, items, 10)[1], pieces.split(text or ""), pieces.findall(text or "")
        return text if not hit else gaps[0] + "".join(w + g for i, (w, g) in enumerate(zip(words, gaps[1:], strict=True)) if i not in hit)

    got = decontamination.decontaminate(docs, benchmark, "spans").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], cut(r[1])) for r in rows), key=str)
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, benchmark, "words")


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(docs_frame(spark, [(1, "some words", "en", "a")]), none).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontamination.contamination(docs_frame(spark, []), none).count() == 0


def test_decontamination_runs_no_python(spark):
    rows, items = planted()
    df = decontamination.contamination(docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
