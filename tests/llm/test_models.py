"""Language ID and toxicity: held-out accuracy, exactness of the path, odd inputs; and the pipeline."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures
from weirgate.llm import langid, queries, toxicity, urlfilter

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")

EN = "the house and the water with another thing that they would have done there when it was about time".split()
DE = "das haus und der wagen mit einer sache die sie dort gemacht haben als es ungefähr zeit für uns war".split()


def text(words, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def corpus():
    rows = [(i, text(EN, i, 30), "en") for i in range(40)] + [(100 + i, text(DE, i, 30), "de") for i in range(40)]
    return rows + [(200 + i, "дом и вода с другой вещью", "ru") for i in range(10)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"), F.lit(True))


def test_mixed_text_gets_spans(model):
    a, b = text(EN, 7, 25), text(DE, 8, 25)
    lang, score, spans = next(langid.label([f"{a}. {b}"], model))
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["end"] - len(a)) < 25
    assert lang in ("en", "de") and 0 < score < 0.9
    lang, score, spans = next(langid.label(["вода и дом"], model))
    assert (lang, len(spans)) == ("ru", 1) and score > 0.4


def test_texts_without_letters_are_und(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the water")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(docs.withColumn("score", F.lit("clash")), model)
    assert [r.doc_id for r in kept.collect()] == [4] and kept.columns == ["doc_id", "text", "score"]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    for _ in range(60):
        scores = -r.exponential(6, (6, 3)).astype(np.float32)
        value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - 4.0 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert value(langid.viterbi(scores, 4.0).tolist()) == pytest.approx(best, abs=1e-4)


def test_odd_tables(spark):
    docs = fixtures.documents(spark)
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    assert langid.identify(docs, model).count() == docs.count()
    nothing = langid.fit(fixtures.empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    untaught = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, untaught).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_isotonic_and_trees():
    x, y = np.arange(200.0), (np.arange(200) > 120).astype(float)
    knots, means = toxicity.isotonic(x, y)
    assert (np.diff(means) >= 0).all() and np.interp(10, knots, means) < 0.1 < 0.9 < np.interp(190, knots, means)
    f = np.stack([x % 7, x], 1)
    raw = toxicity.Trees(rounds=30).fit(f, y).raw(f)
    assert ((raw > 0) == (y > 0)).mean() > 0.98
    assert (toxicity.isotonic(np.array([1.0, 1.0, 2.0]), np.array([1.0, 0.0, 0.5]))[1] == 0.5).all()


def test_obfuscated_and_aimed_insults_show_in_the_features():
    names = toxicity.NAMES
    plain, aimed, masked = (dict(zip(names, toxicity.features(t, {}), strict=True)) for t in ("a fine day", "you are an idiot", "what an id1ot"))
    assert plain["fixed"] == 0 and aimed["fixed"] > 0 and aimed["near_second"] > 0 and masked["obfuscated"] > 0


def test_words_masked_by_runs_of_signs_show_in_the_features():
    at = toxicity.NAMES.index("obfuscated")
    for text in ("what an id10t", "tr@$h", "id10t", "1 !! tr@$h !!", "(i.d..i--o..t)", "é id10t."):
        assert toxicity.features(text, {})[at] > 0, text
    for text in ("", "1", "1a", "a1", "a fine day...", "10 days (or 3-4)", "well-known"):
        assert toxicity.features(text, {})[at] == 0, text
    r = np.random.default_rng(3)
    for _ in range(3000):  # the gate never shuts where the pattern matches
        text = "".join(r.choice(list("aZé10@$-. ;8_中"), r.integers(1, 12)))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert toxicity._between_letters(toxicity._SIGN[raw], toxicity._KIND[raw]) or not toxicity._MASKED.search(text), text


@needs_data
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else DATA
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = queries.op1_language_id(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    scored = queries.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks = scored["score"].rank()
    bad = scored["toxic"] == 1
    auc = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.8


@needs_data
def test_the_pipeline_applies_its_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) <= left.count()
        left = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in left.select("doc_id").collect()}


def test_empty_tables_of_models(spark, model, tmp_path):
    empty = fixtures.empty(spark)
    assert langid.identify(empty, model).collect() == langid.keep_identified(empty, model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels, F.lit(True))).collect() == []
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), [("block", "com", "/")], spark.createDataFrame([], "url string")).collect() == []
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_without_letters_go_whatever_the_columns_are_called(spark, model):
    rows = [(1, "the house is on the hill and we walk there", 5, "x"), (2, None, 6, "y"), (3, "123 !!", 7, "z"), (4, "", 8, None)]
    table = spark.createDataFrame(rows, "doc_id int, text string, score int, lang_pred string")
    assert [tuple(r) for r in langid.keep_identified(table, model).collect()] == rows[:1]
