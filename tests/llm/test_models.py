"""Language ID and the quality classifier: held-out accuracy, exact parses, odd inputs."""

from __future__ import annotations

import zlib
from math import log2

import numpy as np
from pyspark.sql import functions as F

from glyphlake.llm import catalog, langid, quality, textvec
from tests.conftest import SF

ODD = [(1, None), (2, ""), (3, "123 !!\n"), (4, "the cat of the house"), (4, "the cat of the house"), (None, "the cat of the house"), (5, "x" * 50_000), (6, " Le CHAT, de la maison?")]


def phrases(sample: str, text: str) -> int:
    """A greedy parse, window by window, by substring search."""
    n = 0
    for a in range(0, len(text), langid.WINDOW):
        window, at = text[a : a + langid.WINDOW], 0
        while at < len(window):
            size = 0
            while at + size < len(window) and window[at : at + size + 1] in sample:
                size += 1
            at += max(size, 1)
            n += 1
    return n


def test_parse_equals_substring_search():
    samples = {"a": "abracadabra abba cab", "b": "the quick brown fox the lazy dog"}
    model = langid.build(samples)
    texts = ["abra the fox", "zzz abba zz", "quick cab", "ab" * 700, "éé abba", "q"]
    got, _ = langid.entropies(model, texts)
    for i, name in enumerate(model.languages):
        for j, text in enumerate(texts):
            # A text of one window ends with a phrase; an unknown character is a phrase of its own.
            want = phrases(samples[name], text) * log2(len(samples[name])) / len(text)
            slack = (2 + len(text) // langid.WINDOW) * log2(len(samples[name])) / len(text)
            assert abs(got[i, j] - want) <= slack, (name, text)
    assert langid.predict(model, ["abracadabra", "brown fox"])[0] == ["a", "b"]


def test_languages_of_many_scripts():
    """Each language keeps all letters of its sample, however many the others have; parses stay exact."""
    rng = np.random.default_rng(4)
    alphabets = {"han": range(0x4E00, 0x5600), "ko": range(0xAC00, 0xB000), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "th": range(0xE01, 0xE2F), "en": range(97, 123)}
    common = {x: ["".join(chr(rng.choice(a)) for _ in range(4)) for _ in range(60)] for x, a in alphabets.items()}
    text = lambda x, n: " ".join(rng.choice(common[x], n))
    samples = {x: text(x, 30 if x in ("el", "th") else 600) for x in alphabets}
    model = langid.build(samples)
    texts = [text(x, 12) for x in alphabets]
    assert langid.predict(model, texts)[0] == list(alphabets)
    got, _ = langid.entropies(model, texts)
    for i, name in enumerate(model.languages):
        bits = log2(len(samples[name]))
        assert all(abs(got[i, j] * len(t) / bits - phrases(samples[name], t)) <= 2 for j, t in enumerate(texts))


def test_language_of_held_out_documents(spark):
    rows = catalog.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in ODD], "doc_id long, text string, lang_pred string, extra int")
    model = langid.build({"en": "the house of the cat and the dog in the garden " * 9, "fr": "la maison de la reine et le chat dans le jardin " * 9})
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "extra", "lang_pred", "score", "lang_bits"] or set(got.columns) == {"doc_id", "text", "extra", "lang_pred", "score", "lang_bits"}
    answers = [(r["text"], r["lang_pred"], r["score"]) for r in got.collect()]
    assert len(answers) == len(ODD)
    for text, lang, score in answers:
        assert 0 <= score <= 1
        assert (lang == "und") == (not any(c.isalpha() for c in text or ""))
        if text and "cat" in text:
            assert lang == "en"
        if text and "CHAT" in text:
            assert lang == "fr"
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    rows = catalog.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in ODD], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 0), (3, 1, 0), (None, 0, 0), (5, None, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0)), quality.fit(docs.limit(0), labels)):
        rows = quality.classify(docs, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.classify(docs.limit(0), model).count() == 0


def test_descent_separates():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 4]), np.array([3, 5])]
    weight, bias = quality.descend(rows, [np.ones(2)] * 4, np.array([1.0, 1.0, -1.0, -1.0]))
    margins = [weight[r].sum() + bias for r in rows]
    assert margins[0] >= 0.99 and margins[1] >= 0.99 and margins[2] <= -0.99 and margins[3] <= -0.99


def test_indicators_are_distinct_ngrams():
    row, feature = quality.indicators(["abab", "", "abab", "zq"])
    own = [set(feature[row == i]) for i in range(4)]
    assert own[0] == own[2] and not own[1] and len(own[0]) == 2 + 2 + 2 and len(own[3]) == 3


def test_shingles_of_cut_texts_are_complete():
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole = sorted(textvec.shingles([text])[1].tolist())
    cut = [h for piece in textvec.pieces(text, 500) for h in textvec.shingles([piece])[1].tolist()]
    assert sorted(cut) == whole and len(whole) == 2996
    rows, hashes = textvec.words(["Ab cd", "", "!!", "ab-CD éa"])
    assert rows.tolist() == [0, 0, 3, 3, 3] and hashes[0] == hashes[2] and hashes[1] == hashes[3]


def test_null_and_repeated_keys_when_fitting(spark):
    """Hot keys are learnt from once, so what reaches the driver stays small."""
    rows = [(None, f"der hund und die katze {chr(97 + i % 20)}", "de") for i in range(3000)] + [(7, "the dog and the cat", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.predict(model, ["the cat"])[0] == ["en"]
    texts = spark.createDataFrame([(1, "good words here")] * 500 + [(2, "x" * 30_000)] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.scores(quality.fit(texts, labels), ["good words here", "x" * 30_000])
    assert got[0] > got[1]
