import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
VOCABULARY = {
    "en": "the of and to in that is was for with house water people small river".split(),
    "de": "der die und nicht das ist für über schön straße haus wasser menschen klein fluß".split(),
}


def docs_frame(spark, rows, extra=False):
    """Documents from (doc_id, text, lang, source); extra adds columns whose names operators might use."""
    full = [(i, t, lang, src, len(t or "")) for i, t, lang, src in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for c in ("id", "score", "k", "ids", "row", "bucket"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
    return df


def prose(rng, lang="en", n=40):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(f"{w}{rng.randrange(999)}" if rng.random() < 0.3 else w for w in prose(rng, lang, rng.randrange(5, 80)).split()), lang, rng.choice(["a", "b", "c", None])))
    return rows


ODD = [(1000, None, None, None), (1001, "", "en", "a"), (1002, " \n\t ", "de", "b"), (1003, "x", "en", "a"), (1004, "\U0001f600 ééé <|endoftext|> 中文", "de", None), (None, "text without a key", "en", "a")]


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows):
    """doc_id to the smallest doc_id reachable by links, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    best = {i: i for i, _ in sets}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while True:
        before = dict(best)
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
        if best == before:
            return best
