"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from basalt.llm import chat_format, exact_dedup, language_id, lm_score, mixing, neighbours, ngram_join, sentencepieces, suffix_dedup, toxicity
from basalt.llm.queries import TOKENIZERS

LONG = "word " * 30000 + "end"
TEXTS = [None, "", "  \t\n", "One two THREE four five six", "one two three four five six", "\x00é漢😀", LONG, LONG + " more", "a", "..!!", "same text here to hold", "same text here to hold"]
CLASH = ["rank", "kind", "bucket", "data", "component", "node", "salt", "h", "score", "norm", "parts", "doc", "b", "id", "label", "lang", "n", "low"]


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id at all"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)).cache()


@pytest.fixture(scope="module")
def none(messy):
    return messy.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i in (8, 9))) for i in range(len(TEXTS))] + [(None, 1, None), (4, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_exact_dedup(messy, none):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(messy).collect()}
    assert got[(3, got[(4, exact(got, 4))].text_sha256)].keep_id == 4
    assert got[(4, exact(got, 4))].group_size == 3 and got[(4, exact(got, 4))].kept
    assert got[(0, exact(got, 0))].keep_id == 1
    assert exact_dedup.exact_dedup(messy).count() == messy.count()
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_one(messy).columns == messy.columns


def exact(got, doc_id):
    return next(h for d, h in got if d == doc_id)


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "hi & <bye>"), (1, 1, None, ""), (1, 1, "assistant", "hi & <bye>"), (None, None, "assistant", "x" * 100000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("formatted", F.lit(2))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chat(chat_format.canonical_turns(turns))).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 20 and got[None].loss_chars == 100000
    assert chat_format.digests(chat_format.format_chat(chat_format.canonical_turns(turns.filter("false")))).count() == 0


def test_ngram_join(messy, none):
    got = {r.doc_id: r for r in ngram_join.near_components(messy, 3, 90, 100).collect()}
    assert got[4].component_id == 3 and got[3].component_id == 3 and got[11].component_id == 10
    assert got[0].n_shingles == 0 and got[0].component_id == 0 and got[8].n_shingles == 1
    assert ngram_join.near_components(none).count() == 0
    kept = ngram_join.keep_one(messy, 3, 90, 100)
    assert kept.columns == messy.columns and kept.filter("doc_id is null").count() == 2


def test_ngram_join_of_rows_without_id(messy):
    rows = ngram_join.near_components(messy, 3, 90, 100).collect()
    assert len(rows) == len(TEXTS) + 2  # an id that is repeated stands for one document
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id is None) == [(0, None), (2, None)]


def test_suffix(messy, none):
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(messy).collect()}
    assert got[(0, 0)].n_removed == 0 and got[(6, 150003)].n_removed > 149000
    assert got[(7, 150008)].n_bytes - got[(7, 150008)].n_removed < 200
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_pieces(messy, none):
    model = sentencepieces.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    got = sentencepieces.round_trip(messy, model)
    assert got.filter("not same").count() == 0 and got.count() == messy.count()
    encoded = sentencepieces.encode(messy, model)
    back = sentencepieces.decode(encoded, model).join(messy.select("doc_id", F.coalesce("text", F.lit("")).alias("want")), "doc_id")
    assert back.filter("text <> want").count() == 0
    assert sentencepieces.round_trip(none, model).count() == 0


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"), (5, [float("nan"), 1.0], "x"), (6, [0.5, 0.5], "x"), (7, [], "x"), (8, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (9, [0.0, 3.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string").withColumn("id", F.lit(1)).withColumn("raw", F.lit(1))
    got = neighbours.Graph(table).search(spark.createDataFrame([(1,), (3,), (6,)], "query_id long")).collect()
    found = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 3, 6)}
    assert found[1] == [(2, 1.0), (6, 0.5), (9, 0.0)] and found[3] == []
    assert found[6] == [(9, 1.5), (1, 0.5), (2, 0.5)]
    assert neighbours.Graph(table.filter("false")).search(spark.createDataFrame([(1,)], "query_id long")).count() == 0


def test_many_copies_of_a_vector(spark):
    table = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 200, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.cos("id"), F.sin("id"))).alias("embedding"))
    got = neighbours.Graph(table).search(spark.createDataFrame([(150,), (5,)], "query_id long")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 150] == list(range(20))
    assert [r.vec_id for r in got if r.query_id == 5] == [k for k in range(21) if k != 5]


def _found(table, spark, query, top=20):
    got = neighbours.Graph(table).search(spark.createDataFrame([(query,)], "query_id long"), top=top).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    return [r.vec_id for r in got]


def test_one_vector(spark):
    table = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert _found(table, spark, 5) == []


def test_all_copies_of_one_vector(spark):
    table = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    assert _found(table, spark, 150) == list(range(20))
    assert _found(table, spark, 7, top=50) == [k for k in range(51) if k != 7]
    assert _found(table, spark, 7, top=500) == [k for k in range(200) if k != 7]


def test_more_answers_than_are_usual(spark):
    table = spark.range(202).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 200, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.5), F.col("id") / 400)).alias("embedding"))
    assert _found(table, spark, 200, top=60) == [201, *range(59)]


def test_language(messy, none):
    docs = messy.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") == 3, "de"))
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert got[0].lang_pred == "und" and got[9].lang_pred == "und" and got[1].score == 0 and got[3].lang_pred in ("en", "de")
    assert language_id.identify(docs, language_id.learn(none)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, language_id.learn(docs)).count() == 0


def test_toxicity(messy, none, labels):
    for model in (toxicity.learn(messy, labels), toxicity.learn(none, labels), toxicity.learn(messy, labels.filter("toxic = 0"))):
        got = toxicity.score(messy, model)
        assert got.count() == messy.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.score(none, model).count() == 0
        assert toxicity.drop_toxic(messy, model).columns == messy.columns


def test_mixing(messy, none, labels):
    targets = {"q0": 0.5, "q1": 0.5, "q9": 3.0}
    got, domains = mixing.mix_rates(messy, labels, targets, "concat('q', quality)")
    assert domains == ["q0", "q1"] and got.count() == messy.count() and got.filter("rate is null or rate < 0").count() == 0
    assert mixing.take(messy, labels, targets, "concat('q', quality)").columns == messy.columns
    assert mixing.mix_rates(none, labels, targets, "concat('q', quality)")[0].count() == 0
    assert mixing.mix_rates(messy, labels.filter("false"), targets, "concat('q', quality)")[0].filter("rate <> 1").count() == 0


def test_an_id_that_repeats_is_learned_once(spark):
    """A third of all rows may share an id: what is learned doesn't change, and the driver gets one of them."""
    rows = [(k, f"good plain words number {k}" if k % 2 else f"vile nasty words number {k}", "en" if k % 2 else "de") for k in range(80)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = few.unionByName(spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit("good plain words number 1").alias("text"), F.lit("en").alias("lang")))
    labels = few.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"), (F.col("doc_id") % 2).alias("quality"))
    assert all(len(toxicity.labelled_sample(d, labels, "toxic", 6000, mod=None)[0]) == 80 for d in (few, many))
    one, other = (mixing.learn(d, labels, "concat('q', quality)") for d in (few, many))
    assert one.domains == other.domains == ["q0", "q1"] and (one.weights == other.weights).all() and (one.evidence == other.evidence).all()
    told = [language_id.identify(few, language_id.learn(d)).orderBy("doc_id").collect() for d in (few, many)]
    assert told[0] == told[1]


def test_lm(messy, none):
    ranks = lm_score.load_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    got = lm_score.score_documents(messy, ranks, steps=5).collect()
    assert len(got) == messy.count() and all(r.score < 0 and r.base_score < 0 for r in got)
    empty = next(r for r in got if r.doc_id == 0)
    assert empty.n_tokens == 1
    assert lm_score.score_documents(none, ranks, steps=5).count() == 0
