"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents go, of equal texts one stays, of near copies one stays, what is left is
mixed to target weights, and the mixture is encoded. All but the last stage return the
columns of ``documents``.

Defined cases: rows without an id, or whose text is null or empty, pass the first stage (an
empty text is scored as any other) and are told apart by their text alone; rows that repeat
an id stay or go together; labels of ids that aren't there don't matter; without labels
nothing is toxic and every rate is 1; an empty table gives an empty result; other columns
pass all stages but the last.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import exact_dedup, mixing, ngram_join, sentencepieces, toxicity
from basalt.llm._spark import remove, shared_folder
from basalt.llm.queries import TOKENIZERS

#: Token shares of the labelled qualities. The total is such that no share has to shrink.
TARGETS = {"q1": 0.9, "q0": 0.1}
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    return toxicity.drop_toxic(docs, model, 0.3)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five words, the smallest id stays."""
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rates say; those of rates under 1, which soft posteriors cause, come once, so none goes."""
    return mixing.take(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, "concat('q', quality)", total="cover", least=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids and ids."""
    model = sentencepieces.load(PIECES)
    return sentencepieces.encode_with(docs, model, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_equal),
    ("n-gram Jaccard join", drop_near),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: Toxicity, mixing and encoding have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages between are written to the shared folder, and each goes when the next is there."""
    at = f"{shared_folder(spark).rstrip('/')}/corpus-{os.getpid()}-{uuid.uuid4().hex[:8]}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
