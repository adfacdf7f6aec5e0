"""Language ID: held-out accuracy, word scores against a plain version, and odd rows."""

import math
import re
import zlib
from collections import Counter

from holdfast.llm import langid as L
from tests.oracle import folder


def plain_scores(training, word):
    """(lang -> log score) of one word, from all words and n-grams of (lang, text)."""
    counts = {lang: [Counter() for _ in range(L.LONGEST + 1)] for lang, _ in training}
    for lang, text in training:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[lang][0][w] += 1
            for n in range(1, L.LONGEST + 1):
                counts[lang][n].update(f" {w} "[k:k + n] for k in range(len(w) + 3 - n))

    def log(lang, n, x):
        c = counts[lang][n]
        return math.log(c[x] / c.total()) if c[x] else L.PENALTY
    if any(c[0][word] for c in counts.values()):
        return {lang: log(lang, 0, word) for lang in counts}
    for n in range(L.LONGEST, 0, -1):
        grams = [f" {word} "[k:k + n] for k in range(len(word) + 3 - n)]
        known = [g for g in grams if any(c[n][g] for c in counts.values())]
        if known:
            return {lang: sum(log(lang, n, g) for g in known) / len(known) for lang in counts}
    return dict.fromkeys(counts, 0.0)


def test_word_scores(spark):
    training = [("de", "das Haus ist größer, das Haus"), ("en", "the house is bigger"), ("en", "houses"), ("fr", "la maison")]
    model = L.fit(spark.createDataFrame(training, "lang string, text string"))
    assert model.languages == ["de", "en", "fr"]
    for word in ("das", "house", "houses", "hauses", "maisonette", "ist", "zzz", "é", "字"):
        got = L.word_scores(model, L.Spelled([word]))[0]
        want = plain_scores(training, word)
        assert all(abs(g - want[lang]) < 1e-4 for g, lang in zip(got, model.languages)), word


def test_held_out(spark):
    docs = spark.read.parquet(f"{folder('/root/testdata/sf0.01')}/documents.parquet")
    rows = docs.collect()
    held = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    model = L.fit(L.training_texts(docs.filter(~docs["doc_id"].isin(list(held))), "doc_id", "text", "lang"))
    found = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, model, ["doc_id"]).collect()}
    right = [found[r["doc_id"]] == r["lang"] for r in rows if r["doc_id"] in held]
    assert sum(right) >= 0.97 * len(right)


def test_odd_rows(spark):
    rows = [(1, "hello there", "en", "a"), (2, "guten tag", "de", "b"), (2, "guten tag", "de", "b"), (3, None, "en", "c"),
            (4, "", "fr", "d"), (5, "12 + 3 ...", "fr", "e"), (None, "tag hello hello", None, None), (6, "tag " * 300_000, "de", "f"),
            (7, "字", None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = L.fit(L.training_texts(docs, "doc_id", "text", "lang"))
    out = L.identify(docs, model, ["doc_id", "lang_pred"]).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in out) == [
        ("1", "en"), ("2", "de"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und"), ("6", "de"), ("7", "de"), ("None", "en")]
    assert all(0 <= r["score"] <= 1 for r in out)
    assert L.identify(docs.limit(0), model, ["doc_id"]).count() == 0
    nothing = L.fit(L.training_texts(docs.limit(0), "doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in L.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
