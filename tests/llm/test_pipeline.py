"""The pipeline's stages against brute force, and as a whole."""

import math
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from basalt.llm import mixing, toxicity

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage got, and what the last one gave."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
    return [*out, docs]


def test_columns_stay(kept):
    assert all(d.columns == COLUMNS for d in kept[:-1])


def test_toxic_documents_go(spark, kept):
    model = toxicity.learn(kept[0], spark.read.parquet(f"{SF}/labels.parquet"), "toxic")
    good = {r.doc_id for r in toxicity.score(kept[0], model).filter("score < 0.3").collect()}
    assert good == {r.doc_id for r in kept[1].select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept[1].join(labels.filter("toxic = 1"), "doc_id").count() <= 5
    assert kept[1].join(labels.filter("toxic = 0"), "doc_id").count() >= 0.95 * labels.filter("toxic = 0").count()


def test_one_of_equal_texts_stays(kept):
    want = {}
    for r in kept[1].collect():
        key = brute.lower(r.text)
        want[key] = max(want.get(key, -1), r.doc_id)
    assert sorted(want.values()) == sorted(r.doc_id for r in kept[2].select("doc_id").collect())


def test_one_of_near_copies_stays(kept):
    found = brute.near([(r.doc_id, r.text) for r in kept[2].collect()], 5, 80, 100)
    assert sorted({c for _, c in found.values()}) == sorted(r.doc_id for r in kept[3].select("doc_id").collect())


def test_mixture_follows_the_rates(spark, kept):
    rates, domains = mixing.mix_rates(kept[3], spark.read.parquet(f"{SF}/labels.parquet"), pipeline.TARGETS, "concat('q', quality)", total="cover")
    rate = {r.doc_id: r for r in rates.collect()}
    got = Counter(r.doc_id for r in kept[4].select("doc_id").collect())
    assert all(math.floor(rate[d].rate) <= got[d] <= math.ceil(rate[d].rate) for d in rate) and set(got) <= set(rate)
    tokens = {d: sum(r.n_tokens * r.rate * r.posterior[k] for r in rate.values()) for k, d in enumerate(domains)}
    assert tokens["q1"] / sum(tokens.values()) == pytest.approx(pipeline.TARGETS["q1"], abs=0.002)
    assert set(got) == set(rate)


def test_ids_are_the_library_s(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=pipeline.PIECES)
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    assert kept[5].count() == kept[4].count()
    assert all(list(r.ids) == library.encode(texts[r.doc_id]) and r.n_ids == len(r.ids) for r in kept[5].collect())


def test_run(spark, kept):
    got = pipeline.run(spark, SF)
    assert got.columns == kept[5].columns
    assert got.exceptAll(kept[5]).count() == 0 and got.count() == kept[5].count()


def test_empty_corpus(spark, kept):
    docs = kept[0].filter("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some text here", "en", "s", 1), (4, "word " * 20000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rank", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*COLUMNS, "rank"] and docs.filter("doc_id = 4").count() >= 1
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
