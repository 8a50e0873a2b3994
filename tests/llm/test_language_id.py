from collections import Counter

import pytest
from pyspark.sql import functions as F
from sqlquarry.llm import language_id, queries


def brute_ngrams(text):
    out = Counter()
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = " " + " ".join(low) + " " if low else ""
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if gram != " ":
                out[gram] += 1
    return out


def code(gram):
    n = 0
    for c in gram:
        n = (n << 21) | ord(c)
    return n


@pytest.mark.parametrize("text", ["Hello, hello world", "é!à b", "x", "", "123 !!", "  lead", "日本語 text ßß", "end"])
def test_ngrams(text):
    texts = ["other words", text, "more"]
    grams, count = list(language_id.text_ngrams(texts))[1]
    got = dict(zip(grams.tolist(), count.tolist(), strict=True))
    want = {code(g): n for g, n in brute_ngrams(text).items()}
    # a text that doesn't end in a blank gets none at its end
    if text and text[-1].isalpha():
        assert {g: n for g, n in got.items()} == want
    else:
        assert got == want


def test_out_of_place_against_brute_force():
    texts = {"a": "the cat and the dog and the bird", "b": "der hund und die katze und der vogel"}
    ranked = {}
    for lang, t in texts.items():
        c = brute_ngrams(t)
        ranked[lang] = [code(g) for g in sorted(c, key=lambda g: (-c[g], code(g)))][:50]
    p = language_id.Profiles(ranked, 50)
    for text in ["the bird", "und die", "xyz", "the katze"]:
        c = brute_ngrams(text)
        top = [code(g) for g in sorted(c, key=lambda g: (-c[g], code(g)))][:50]
        away = {lang: sum(abs(i - r.index(g)) if g in r else 50 for i, g in enumerate(top)) for lang, r in ranked.items()}
        best = min(sorted(away), key=away.get)
        got, score = p.predict([text])
        assert got == [best] and abs(score[0] - (1 - away[best] / (len(top) * 50))) < 1e-12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_edges(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 34 !!", "fr", 1), (4, "the the and", "en", 1), (4, "the the and", "en", 1), (None, "le la les", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = language_id.identify(docs, language_id.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_score"]
    got = out.collect()
    assert len(got) == 6 and [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    none = docs.where("false")
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    blank = language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}
