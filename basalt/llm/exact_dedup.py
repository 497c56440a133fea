"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A chunk ends after a word where the hash of the last two words meets a mask, so cuts depend
on the words near them alone, and a text with something put in has all its other chunks as
before. Chunks are cut once; recipes and dictionary read the same table. Distinct chunks go through the dictionary, which proves that an identifier (the 64-bit hash of the chunk) stands for one
chunk text only. Documents are then compared by their ordered lists of identifiers, some
eight bytes for a thousand characters, so that long documents do not move again and again.
Documents that hold a chunk whose identifier is shared by two chunk texts also compare
their texts, so that the result is exact whatever the hash does.

Chunks cross the network once, combined on the map side, so a chunk that millions of
documents share is sent once for each map task. Groups of equal documents are counted by
(recipe, salt) before they meet.

What is longer than ``MOST`` characters between two cuts, such as text without blanks, is cut
into pieces of that length; only there an insertion moves the cuts up to the next one.

Defined cases: null counts as empty; all empty texts are one group; ids that are null never
stay unless the whole group has none; rows repeated with the same id count in ``group_size``
and share one decision; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import cut, stored

#: Words of a chunk in the mean; characters of a chunk at most.
MEAN, MOST = 128, 8192
#: The mark of a cut; a first character of it that stands in a text is followed by another one.
MARK, OWN = "\x01\x02", "\x01\x03"
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Plain ASCII takes the fast built-in function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def identifier(part: Column) -> Column:
    return F.xxhash64(part)


def chunks(docs: DataFrame, text: str, out: str = "parts") -> DataFrame:
    """``docs`` with the chunks of ``text`` (never null) as ``out``; joined they are the text."""

    def word(w: Column, nth: Column) -> Column:
        before = F.coalesce(F.get("__words", nth - 1), F.lit(""))
        ends = (F.pmod(F.xxhash64(w), F.lit(8)) == 0) & (F.pmod(F.xxhash64(before, w), F.lit(MEAN // 8)) == 0) & (before != w)
        return F.when(ends, F.concat(w, F.lit(MARK))).otherwise(w)

    cut_up = docs.withColumn("__words", F.split(F.replace(F.col(text), F.lit("\x01"), F.lit(OWN)), " "))
    marked = F.split(F.array_join(F.transform("__words", word), " "), MARK)
    own = F.transform(F.filter(marked, lambda c: c != ""), lambda c: F.replace(c, F.lit(OWN), F.lit("\x01")))
    short = F.flatten(F.transform(own, lambda c: F.when(F.length(c) <= MOST, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{MOST}}}"), F.lit(0)))))
    return cut_up.withColumn(out, short).drop("__words")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_sha256, the chunks (parts) of the normalised text and its recipe: their identifiers in order."""
    cut_up = chunks(_texts(docs, doc_id, text).withColumn("text_sha256", F.sha2("norm", 256)), "norm")
    return cut_up.select("doc_id", "text_sha256", "parts", F.transform("parts", identifier).alias("recipe"))


def ambiguous_identifiers(made: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk text: none, but for a collision of hashes."""
    dictionary = made.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("uses")).select(identifier(F.col("part")).alias("ident"))
    return dictionary.groupBy("ident").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("ident")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after lower-casing A-Z) the row with the largest id stays.
    """
    with stored(recipes(docs, doc_id, text)) as made:
        unsure = cut(ambiguous_identifiers(made))
        keyed = made.select("doc_id", "text_sha256", "recipe", F.lit(None).cast("string").alias("proof"))
        if not unsure.isEmpty():
            lists = made.select("recipe").distinct()
            doubtful = lists.select("recipe", F.explode("recipe").alias("ident")).join(unsure, "ident", "left_semi").select("recipe").distinct().withColumn("doubt", F.lit(True))
            keyed = made.join(doubtful, "recipe", "left").select("doc_id", "text_sha256", "recipe", F.when(F.col("doubt"), F.array_join("parts", "")).alias("proof"))
        keyed = cut(keyed)
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    key = ["recipe", "proof"]
    some = keyed.groupBy(*key, "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    whole = some.groupBy(*key).agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    a, b = some.select(*key, "salt").alias("a"), whole.alias("b")
    same = (F.col("a.recipe") == F.col("b.recipe")) & F.col("a.proof").eqNullSafe(F.col("b.proof"))
    found = a.join(b, same).select("a.recipe", "a.proof", "a.salt", "keep_id", "group_size").alias("f")
    k = keyed.alias("k")
    same = (F.col("k.recipe") == F.col("f.recipe")) & (F.col("k.salt") == F.col("f.salt")) & F.col("k.proof").eqNullSafe(F.col("f.proof"))
    return k.join(found, same).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_dedup(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias("__stay_id")).distinct()
    return docs.join(stay, F.col(doc_id).eqNullSafe(F.col("__stay_id")), "left_semi")
