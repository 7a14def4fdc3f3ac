import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm.language import Model, identify, train, viterbi
from platewise.llm.queries_language import fold, fitted, op10_language_id


def test_viterbi_is_the_plain_one():
    rng = np.random.default_rng(4)
    for k in (1, 4):
        for penalty in (10.0, 0.0):
            counts = np.array([1, 40, 7, 300, 2, 41, 80])
            scores = -rng.integers(0, 12, (int(counts.sum()), k)).astype(np.float32)
            ends = np.cumsum(counts)
            want = sum((brute.viterbi(scores[e - n : e].tolist(), penalty) for n, e in zip(counts, ends)), [])
            for stretch in (4096, 40, 8, 1):  # whole, and in stretches, with many ties
                assert viterbi(scores, counts, penalty, stretch, stretch).tolist() == want


def test_whole_query_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    labelled = [(r["text"], r["lang"]) for r in docs if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = dict(zip([r["doc_id"] for r in docs], brute.languages(labelled, [r["text"] for r in docs])))
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in op10_language_id(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (held, label, score) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and label == want[i][0] and abs(score - want[i][1]) < 1e-9


def test_mixed_texts_and_scripts_are_the_plain_ones(spark):
    labelled = [("the lazy dog sleeps and the quick fox jumps", "en"), ("der faule Hund schläft und der Fuchs springt", "de"), ("ленивая собака спит", "ru"), ("懒狗在睡觉", "zh")] * 3
    texts = ["the lazy dog der faule Hund schläft ленивая", "собака the fox", "懒狗 the dog sleeps", "ελληνικά", "ελληνικά the dog", "123 ...", "", None, "Ǆ İstanbul", "dog" * 50]
    model = train(spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "doc_id long, text string, lang string"))
    got = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, switch_penalty=3.0).orderBy("doc_id").collect()
    for r, (label, score) in zip(got, brute.languages(labelled, texts, penalty=3.0)):
        assert (r["lang_pred"], round(r["score"], 9)) == (label, round(score, 9)), r


def test_labels_are_bounded_and_columns_may_not_clash(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the lazy dog", "en")] * 5 + [("der faule Hund", "de")] * 4 + [("dirt", "x"), (None, "y"), ("le chien", "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert train(docs, languages=2).languages == ["de", "en"] and train(docs, languages=3).languages == ["de", "en", "fr"]
    with pytest.raises(ValueError, match="score"):
        identify(docs.withColumn("Score", F.lit(1)), train(docs), keep=("doc_id", "Score"))


def test_held_out_accuracy(spark):
    found = op10_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = found.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND text IS NOT NULL").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert r["n"] > 100 and r["right"] > 0.98


def test_rare_languages_are_learned(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(3000)] + [(5000 + i, "przykładowy tekst źródłowy", "pl") for i in range(3)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40)
    got = identify(spark.createDataFrame([(1, "tekst źródłowy"), (None, "lazy dog")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["pl", "en"]


def test_long_texts_and_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the lazy dog", "en"), ("der faule Hund", "de")] * 40)], "doc_id long, text string, lang string")
    model = fitted(docs)
    texts = ["the lazy dog " * 60_000 + "der faule Hund " * 5_000, "dog" * 400_000, "der faule Hund"]
    got = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["en", "en", "de"]
    assert [(s["lang"]) for s in got[0]["spans"]] == ["en", "de"] and got[0]["spans"][1]["end"] == len(texts[0]) - 1


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in df.select(fold() == 0).collect()] == [False, False]
    assert isinstance(fitted(df.selectExpr("doc_id", "cast(null AS string) AS text", "cast(null AS string) AS lang")), Model)
