"""The registered queries of this subpackage and, where SQL can say the same, their oracles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import chat_format as _chat
from basalt.llm import exact_dedup as _exact
from basalt.llm import language_id as _language
from basalt.llm import lm_score as _lm
from basalt.llm import mixing as _mixing
from basalt.llm import neighbours as _neighbours
from basalt.llm import ngram_join as _ngrams
from basalt.llm import sentencepieces as _sentencepieces
from basalt.llm import suffix_dedup as _suffixes
from basalt.llm import toxicity as _toxicity
from basalt.llm._spark import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the vocabulary files of public tokenizers lie; read on the driver alone.
TOKENIZERS = os.environ.get("BASALT_TOKENIZERS", "/opt/tokenizers")
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(read(spark, sf_dir, "documents"))


QUERIES["op2_exact_dedup"] = op2_exact_dedup
ORACLES["op2_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {LOWER_SQL} AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


PLANTED = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text")
    )
    turns = _chat.canonical_turns(read(spark, sf_dir, "conversations")).unionByName(_chat.canonical_turns(planted))
    return _chat.digests(_chat.format_chat(turns))


QUERIES["op3_chat_format"] = op3_chat_format
ORACLES["op3_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
     e AS (SELECT *, length(replace(replace(t, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(r, '&', '&amp;'), '<', '&lt;')) + 21 AS written FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(written) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = _toxicity.learn(docs, read(spark, sf_dir, "labels"), "toxic")
    scored = _toxicity.score(docs, model)
    return scored.select(
        "doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


QUERIES["op9_toxicity"] = op9_toxicity


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    named = _language.identify(docs, _language.learn(docs))
    return named.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES["op10_language_id"] = op10_language_id


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return _sentencepieces.round_trip(read(spark, sf_dir, "documents"), _sentencepieces.load(model))


QUERIES["op5_sentencepiece"] = op5_sentencepiece


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


QUERIES["op6_suffix_dedup"] = op6_suffix_dedup


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngrams.near_components(read(spark, sf_dir, "documents"), size=3, num=90, den=100)


QUERIES["op4_ngram_jaccard"] = op4_ngram_jaccard


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    return _neighbours.Graph(vectors).search(queries)


QUERIES["op7_nearest_neighbours"] = op7_nearest_neighbours


def op8_lm_score(spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return _lm.score_documents(read(spark, sf_dir, "documents"), _lm.load_ranks(ranks))


QUERIES["op8_lm_score"] = op8_lm_score


#: A domain is a quality and a toxicity of the labelled table.
DOMAIN = "concat('q', quality, 't', toxic)"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"q1t0": 0.7, "q0t0": 0.18, "q1t1": 0.08, "q0t1": 0.04}
    found, domains = _mixing.mix_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), targets, DOMAIN)
    likeliest = F.element_at(F.array(*map(F.lit, domains)), F.array_position("posterior", F.array_max("posterior")).cast("int")) if domains else F.lit(None).cast("string")
    return found.select("doc_id", "n_tokens", likeliest.alias("domain"), "posterior", "rate")


QUERIES["op1_mixing"] = op1_mixing

WORDS_SQL = rf"regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+')"
ORACLES["op4_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE [array_to_string(words[i : i + 2], ' ') FOR i IN range(1, len(words) - 1)] END) AS shingle FROM w),
     n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
     i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
     r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(r.reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
#: Bytes as two hexadecimal digits each; a window of 100 bytes is 200 digits.
ORACLES["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     p AS (SELECT doc_id, h, unnest(range(1, CAST(len(h) / 2 AS BIGINT) + 1)) AS pos FROM d),
     w AS (SELECT doc_id, pos, CASE WHEN 2 * pos + 198 <= len(h) THEN substr(h, 2 * pos - 1, 200) END AS s, substr(h, 2 * pos - 1, 2) AS byte FROM p),
     m AS (SELECT doc_id, pos, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1 AS again FROM w),
     c AS (SELECT doc_id, pos, byte, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM m),
     e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c),
     f AS (SELECT doc_id, count(*) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans,
             sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)
"""
