"""Toxicity by maximum-scoring segments of token log-odds.

Tokens get log-odds between toxic and other texts under an informative Dirichlet prior,
lowered by their standard error and a constant, so that chance text has a negative drift.
Words too rare to be known take the score of a known beginning of 4 to 6 bytes. A linear
scan (all maximal scoring subsequences, after Ruzzo and Tompa) finds every toxic passage of
a text. Under chance the best of n tokens follows an extreme-value law (Karlin and
Altschul): E = K n exp(-lambda s). The sum of 1 / E over all passages of a text is mapped
to a probability by a logistic curve.

What is learned comes from a bounded sample of labelled rows (``sample_rows``), counted by
distinct contexts: a word counts once for each different word before it, a beginning once
for each different word that it begins, so copies of a text don't count again and again. Scoring goes through the texts once, without a shuffle.

Defined cases: null text counts as empty and has no passage; rows that repeat or tie are
scored alike, and of a labelled id that repeats the least text is learned from; without labelled rows of both kinds every text gets the share of the label 1
(0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import fold, pieces, release, short_batches, text_bytes
from basalt.llm._tokens import OTHER, Tokens, U, mix

BEGINNINGS = (6, 5, 4)
KNOWN, DRIFT, LEAST = 3, 0.7, -2.0


class Model:
    """Token scores, the extreme-value law and the logistic curve."""

    def __init__(self, sample_rows: int = 6000) -> None:
        self.sample_rows = sample_rows
        self.known = np.zeros(0, U)
        self.scores = np.zeros(0)
        self.starts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.law, self.curve = (1.0, 0.1), (-30.0, 0.0)

    # learning

    def fit(self, texts: pa.Array, labels: np.ndarray) -> "Model":
        labels = np.asarray(labels, bool)
        if not labels.any() or labels.all():
            share = labels.mean() if len(labels) else 0.0
            self.curve = (math.log(max(share, 1e-13) / max(1 - share, 1e-13)), 0.0)
            return self
        half = mix(np.arange(len(labels), dtype=U)) % U(2) == 0
        parts = [half, ~half, np.ones(len(labels), bool)]
        tables = {k: self._tables(texts, labels, k, parts) for k in (0, *BEGINNINGS)}
        stats, sizes, tops = np.zeros(len(labels)), np.zeros(len(labels)), np.zeros(len(labels))
        null: list[np.ndarray] = []
        for n, part in enumerate(parts[:2]):
            self._use(tables, n)
            for rows, tokens, s in self._read(texts, np.flatnonzero(~part)):
                null.append(s[~labels[rows][tokens.row]])
                sizes[rows] = tokens.per_row()
                for row, _, _, score in segments(tokens.row, s):
                    tops[rows[row]] = max(tops[rows[row]], score)
        lam = _decay(np.concatenate(null) if null else np.zeros(0))
        clean = ~labels & (sizes > 0)
        spread = (sizes[clean] * np.exp(-lam * tops[clean])).sum()
        self.law = (lam, float(np.clip(clean.sum() / spread if spread else 0.1, 1e-4, 1.0)))
        for n, part in enumerate(parts[:2]):
            self._use(tables, n)
            for rows, tokens, s in self._read(texts, np.flatnonzero(~part)):
                stats[rows] = self._evidence(tokens, s)[0]
        self.curve = _logistic(stats, labels)
        self._use(tables, 2)
        return self

    def _read(self, texts: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, Tokens, np.ndarray]]:
        batch = pa.record_batch([texts.take(pa.array(rows)), pa.array(rows)], ["text", "row"])
        for piece in pieces(iter([batch]), 0, 1 << 19):
            tokens = Tokens(*text_bytes(piece.column(0)), OTHER, latin=True)
            yield piece.column(1).to_numpy(), tokens, self.score_tokens(tokens)

    def _tables(self, texts: pa.Array, labels: np.ndarray, k: int, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores of words (0) or of beginnings of ``k`` bytes, learned from each of the parts.

        A word's context is its neighbour, a beginning's the word that it begins.
        """
        token, context, rows = [], [], []
        batch = pa.record_batch([texts, pa.array(np.arange(len(texts)))], ["text", "row"])
        for piece in pieces(iter([batch]), 0, 1 << 19):
            tokens = Tokens(*text_bytes(piece.column(0)), OTHER, latin=True)
            row, words = piece.column(1).to_numpy()[tokens.row].astype(np.int32), tokens.words()
            if k:
                long = tokens.end - tokens.start >= k
                token.append(tokens.hashes(tokens.start[long], tokens.start[long] + k))
                context.append(words[long])
                rows.append(row[long])
            else:
                before = np.zeros(len(words), U)
                before[1:] = np.where(row[1:] == row[:-1], words[:-1], U(0))
                token.append(words)
                context.append(mix(words + before * U(0x9E3779B97F4A7C15)))
                rows.append(row)
        if not token:
            return [(np.zeros(0, U), np.zeros(0))] * len(parts)
        rows = np.concatenate(rows)
        token, context, out = np.concatenate(token), np.concatenate(context), []
        share = (token >> U(8)) % U(8)  # an eighth of the tokens at a time
        for part in parts:
            names, bad, both = [], [], []
            for n in range(8):
                chosen = np.flatnonzero(part[rows] & (share == n))
                t, toxic = token[chosen], labels[rows[chosen]]
                one = np.unique(context[chosen] ^ (t << U(1)) ^ toxic.astype(U), return_index=True)[1]
                found, at = np.unique(t[one], return_inverse=True)
                names.append(found)
                bad.append(np.bincount(at, toxic[one], len(found)))
                both.append(np.bincount(at, minlength=len(found)))
            names, bad, both = np.concatenate(names), np.concatenate(bad), np.concatenate(both)
            score, enough = log_odds(bad, both - bad), both >= KNOWN
            if k:
                enough &= score > 0
            names, score = names[enough], score[enough]
            by = np.argsort(names)
            out.append((names[by], score[by]))
        return out

    def _use(self, tables: dict[int, list[tuple[np.ndarray, np.ndarray]]], n: int) -> None:
        self.known, self.scores = tables[0][n]
        self.starts = {k: tables[k][n] for k in BEGINNINGS}

    # scoring

    def score_tokens(self, tokens: Tokens) -> np.ndarray:
        words = tokens.words()
        score, known = _look(self.known, self.scores, words, -DRIFT)
        left = np.flatnonzero(~known)
        for k in BEGINNINGS:
            left = left[tokens.end[left] - tokens.start[left] >= k]
            found, has = _look(*self.starts.get(k, (np.zeros(0, U), np.zeros(0))), tokens.hashes(tokens.start[left], tokens.start[left] + k), -DRIFT)
            score[left[has]] = found[has]
            left = left[~has]
        return score

    def _evidence(self, tokens: Tokens, s: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
        lam, k = self.law
        sizes, found = tokens.per_row(), []
        total = np.zeros(tokens.rows)
        for row, first, last, score in segments(tokens.row, s):
            expect = k * sizes[row] * math.exp(-min(lam * score, 600.0))
            total[row] += 1.0 / max(expect, 1e-200)
            found.append((row, first, last, score, expect))
        return np.log1p(total), found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a + b * evidence, -60, 60)))

    def passages(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
        """The score of each text, and its passages: start and end in bytes, score, E-value."""
        data, offsets = text_bytes(texts)
        tokens = Tokens(data, offsets, OTHER, latin=True)
        evidence, found = self._evidence(tokens, self.score_tokens(tokens))
        spans: list[list[tuple[int, int, float, float]]] = [[] for _ in range(tokens.rows)]
        for row, first, last, score, expect in found:
            spans[row].append((int(tokens.start[first] - offsets[row]), int(tokens.end[last] - offsets[row]), score, expect))
        return self.probability(evidence), spans


def log_odds(bad: np.ndarray, good: np.ndarray, prior: float = 0.5) -> np.ndarray:
    """Log-odds under a Dirichlet prior in proportion to the whole, less two standard errors towards nought, less the drift."""
    both = bad + good
    whole = max(both.sum(), 1.0)
    a = prior + both / whole
    nb, ng = bad.sum() + a.sum(), good.sum() + a.sum()
    delta = np.log((bad + a) / np.maximum(nb - bad - a, 1e-9)) - np.log((good + a) / np.maximum(ng - good - a, 1e-9))
    error = 2 * np.sqrt(1 / (bad + a) + 1 / (good + a))
    return np.maximum(np.sign(delta) * np.maximum(np.abs(delta) - error, 0) - DRIFT, LEAST)


def _look(names: np.ndarray, values: np.ndarray, keys: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
    if not len(names):
        return np.full(len(keys), other), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    has = names[at] == keys
    return np.where(has, values[at], other), has


def segments(row: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """All maximal scoring subsequences of each row: row, first and last token, score.

    Linear: every token above nought opens a candidate, which merges to the left while the
    nearest candidate with a lower start has a lower top.
    """
    sums = np.concatenate([[0.0], np.cumsum(score)])
    up = np.flatnonzero(score > 0)
    open_row, stack = -1, []  # (first, last, sum before, sum after)
    for r, i, before, after in zip(row[up].tolist(), up.tolist(), sums[up].tolist(), sums[up + 1].tolist(), strict=True):
        if r != open_row:
            yield from ((open_row, a, b, top - low) for a, b, low, top in stack)
            open_row, stack = r, []
        first, low, top = i, before, after
        links = []
        while True:
            while stack and stack[-1][2] >= low:
                links.append(stack.pop())
            if not stack or stack[-1][3] >= top:
                break
            first, _, low, _ = stack.pop()
            links.clear()
        stack.extend(reversed(links))
        stack.append((first, i, low, top))
    yield from ((open_row, a, b, top - low) for a, b, low, top in stack)


def _decay(null: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda s) = 1 over chance tokens."""
    if not len(null) or null.max() <= 0 or null.mean() >= 0:
        return 1.0
    values, counts = np.unique(np.round(null, 2), return_counts=True)
    p, low, high = counts / counts.sum(), 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * values, 600))).sum() < 1 else (low, mid)
    return float(np.clip(low, 0.2, 3.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a light prior on the slope, which isn't negative."""
    w, design = np.array([0.0, 0.1]), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + np.array([1e-3, 1e-2]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-2])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, doc_id: str = "doc_id", text: str = "text", mod: int | None = 4, rest: int = 2) -> tuple[pa.Array, np.ndarray]:
    """About ``sample_rows`` labelled texts at most, chosen by a hash of the id, outside the fold held out."""
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    if mod:
        chosen = chosen.filter(~fold("doc_id", mod, rest))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    there = chosen.count()
    if there > sample_rows:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(sample_rows / there * (1 << 20)))
    # at most about sample_rows rows of two numbers; of an id that repeats the least text, so that no id brings many rows
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label").toArrow()
    got = got.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")]) if got.num_rows else got
    texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts), np.asarray(got.column("label").to_pylist())


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 6000, mod: int | None = 4, rest: int = 2) -> Model:
    texts, marks = labelled_sample(docs, labels, label, sample_rows, mod=mod, rest=rest)
    model = Model(sample_rows).fit(texts, marks.astype(float) > 0)
    del texts
    release()
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and passages (start, end in bytes of UTF-8, score, expect) of each row."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by sample_rows
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, score double, passages array<struct<start:long,end:long,score:double,expect:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expect", pa.float64())])
        for piece in pieces(batches, 1):
            scores, spans = sent.value.passages(piece.column(1))
            lists = [[{"start": a, "end": b, "score": s, "expect": e} for a, b, s, e in row] for row in spans]
            yield pa.record_batch([piece.column(0), pa.array(scores), pa.array(lists, pa.list_(item))], ["doc_id", "score", "passages"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, out)


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``least``, all columns as they are, in one pass."""
    short_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, at):
            scores, _ = sent.value.passages(piece.column(at))
            yield piece.filter(pa.array(scores < least))

    return docs.mapInArrow(run, docs.schema)
