"""Language identification by the nearest of several centroids per language.

A text is the vector of its letter trigrams (words in lower case, parted by blanks), hashed
into a fixed number of places, with 1 + log of the count times the inverse document
frequency, of length one. Spherical k-means gives each language several centroids. The
nearest by cosine names the language. A text further from its centroid than nearly all the
rows that it was learned from is marked as rejected.

All of the model comes from a bounded sample of labelled rows: ``sample_rows``, and ``least`` of
each of the ``LANGS`` commonest languages, so that a rare one is learned as the table grows.
Applying it is one pass without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the
language first in order, then to its first centroid; rows that repeat are treated alike,
and of an id that repeats with one language the least text is learned from; with
nothing to learn from every text is ``und``; other columns are not read and don't come back; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import fold, pieces, release, short_batches, text_bytes
from basalt.llm._tokens import LOWER, OTHER

UND = "und"
PLACES = 4096
BLANK = 32
#: Languages that are sure of a place in the sample.
LANGS = 1000
_NONLETTER = OTHER.copy()
_NONLETTER[48:58] = True


def counts(data: np.ndarray, offsets: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Trigram counts, a row for each text."""
    n, rows = len(data), len(offsets) - 1
    low = np.where(_NONLETTER[data], np.uint8(BLANK), LOWER[data])
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    if n < 3:
        return np.zeros((rows, places), np.float32)
    a = low.astype(np.uint32)
    code = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0x2545F491) ^ (a[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x6C8E9CF5)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x846CA68B)
    place = (code >> np.uint32(8)) % np.uint32(places)
    good = (row[2:] == row[:-2]) & ~((low[:-2] == BLANK) & (low[1:-1] == BLANK)) & ~((low[1:-1] == BLANK) & (low[2:] == BLANK))
    flat = np.bincount(row[2:][good] * places + place[good], minlength=rows * places)
    return flat.reshape(rows, places).astype(np.float32)


class Model:
    def __init__(self, clusters: int = 3, rounds: int = 15, reject: float = 0.002) -> None:
        self.clusters, self.rounds, self.reject = clusters, rounds, reject
        self.idf = np.ones(PLACES, np.float32)
        self.centroids = np.zeros((0, PLACES), np.float32)
        self.langs: list[str] = []
        self.of: np.ndarray = np.zeros(0, int)
        self.floor: np.ndarray = np.zeros(0)

    def vectors(self, texts: pa.Array) -> np.ndarray:
        v = counts(*text_bytes(texts))
        np.log1p(v, out=v)
        v *= self.idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return v

    def fit(self, texts: pa.Array, langs: list[str]) -> "Model":
        batch, found, seen = pa.record_batch([texts], ["text"]), [], np.zeros(PLACES)
        for piece in pieces(iter([batch]), 0):
            v = counts(*text_bytes(piece.column(0)))
            seen += (v > 0).sum(0)
            found.append(np.log1p(v).astype(np.float16))
        self.idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
        v = np.concatenate(found).astype(np.float32) if found else np.zeros((0, PLACES), np.float32)
        v *= self.idf
        size = np.linalg.norm(v, axis=1)
        v /= np.maximum(size, 1e-9)[:, None]
        langs_of = np.asarray(langs, dtype=object)
        kept, of, floor = [], [], []
        for lang in sorted(set(langs)):
            rows = v[(langs_of == lang) & (size > 0)]
            if not len(rows):
                continue
            made = _spherical(rows, min(self.clusters, len(rows)), self.rounds)
            near = (rows @ made.T).max(1)
            self.langs.append(lang)
            kept.append(made)
            of += [len(self.langs) - 1] * len(made)
            floor += [float(np.quantile(near, self.reject)) - 0.05] * len(made)
        if kept:
            self.centroids, self.of, self.floor = np.concatenate(kept), np.asarray(of), np.asarray(floor)
        return self

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and rejection of each text."""
        n = len(texts)
        if not self.langs:
            return [UND] * n, np.zeros(n), np.ones(n, bool)
        cosine = self.vectors(texts) @ self.centroids.T
        best = cosine.argmax(1)
        near = np.clip(cosine[np.arange(n), best], 0, 1).astype(float)
        letters = has_letters(texts)
        lang = [self.langs[self.of[b]] if ok else UND for b, ok in zip(best, letters, strict=True)]
        return lang, np.where(letters, near, 0.0), ~letters | (near < self.floor[best])


def _spherical(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means by cosine. Starts: the row nearest the mean, then the row furthest from those chosen."""
    mean = rows.mean(0)
    chosen = [int((rows @ mean).argmax())]
    far = rows @ rows[chosen[0]]
    while len(chosen) < k:
        chosen.append(int(far.argmin()))
        far = np.maximum(far, rows @ rows[chosen[-1]])
    made = rows[chosen].copy()
    for _ in range(rounds):
        at = (rows @ made.T).argmax(1)
        for c in range(k):
            if (at == c).any():
                made[c] = rows[at == c].mean(0)
                made[c] /= max(np.linalg.norm(made[c]), 1e-9)
    return made


def has_letters(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    ascii_letter = np.concatenate([[0], np.cumsum(~_NONLETTER[data] & (data < 128), dtype=np.int64)])
    long = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
    has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for row in np.flatnonzero(~has & (long[offsets[1:]] > long[offsets[:-1]])):
        has[row] = any(c.isalpha() for c in texts[int(row)].as_py())
    return has


def learn(docs: DataFrame, lang: str = "lang", sample_rows: int = 6000, least: int = 50, doc_id: str = "doc_id", text: str = "text", mod: int | None = 4, rest: int = 2, **options) -> Model:
    """Fit on rows with a language, outside the fold held out, chosen by a hash of the id: about ``sample_rows``, and about ``least`` of a language that has fewer among these."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    if mod:
        rows = rows.filter(~fold("doc_id", mod, rest))
    there = rows.drop("text").count()
    if there > sample_rows:
        share = sample_rows / there
        many = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
        wanted = many.select("lang", F.greatest(F.lit(share), F.lit(float(least)) / F.col("n")).alias("share"))
        place = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20))
        rows = rows.join(F.broadcast(wanted), "lang", "left").filter(place < (F.coalesce("share", F.lit(share)) * (1 << 20)).cast("long")).select("doc_id", "lang", "text")
    # of an id that repeats with one language the least text, so that no id brings many rows
    got = rows.filter("text IS NOT NULL").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", "text").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if got.num_rows else got
    texts = pa.chunked_array(got.column("text")).combine_chunks() if got.num_rows else pa.array([], pa.string())
    model = Model(**options).fit(texts, got.column("lang").to_pylist())
    del got, texts
    release()
    return model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # places x clusters x languages, bounded by sample_rows
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1, 1 << 20):
            for at in range(0, piece.num_rows, 2048):
                part = piece.slice(at, 2048)
                lang, near, far = sent.value.predict(part.column(1))
                yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(near), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
