"""Mixing to target weights by soft membership.

A classifier learned from a labelled table gives every document a probability for each
domain. Rates, nought or more, say how often a document is wanted. They minimise the
squared distance between the expected tokens of each domain, the sum over documents of
rate * tokens * probability, and the target, starting from rate 1: projected gradient
steps, each one pass over the small table of probabilities that sends one number per domain
to the driver. Steps are taken in the metric of tokens, so a rate depends on what a document
is, not on its length, and with momentum. A rate is a function of the gradients so far;
nothing but the table of probabilities is kept, so a lost executor costs one recomputed
partition.

The classifier: naive-Bayes evidence of hashed words per domain and a few shares (words
that repeat, capitals, marks), brought to probabilities by softmax regression fitted on
texts whose evidence comes from the other half of a bounded sample (``sample_rows``).

Defined cases: null counts as empty, has no tokens and any rate; a domain of the targets
that no labelled row has is left out and the others' weights scaled up; domains without a
target have target 0; without any labelled row all rates are 1; ids that repeat or are null
are rows like others, but of a labelled id that repeats only the least text is learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import cut, pieces, release, short_batches, text_bytes
from basalt.llm._tokens import OTHER, Tokens, U

PLACES, SHARES = 1 << 16, 5


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens, their places in the table, and the shares of each text."""
    t = Tokens(data, offsets, OTHER, latin=True)
    words = t.words()
    place = (words % U(PLACES)).astype(np.int64)
    n = np.maximum(t.per_row(), 1)
    again = np.zeros(t.rows)
    if len(words) > 1:
        again = np.bincount(t.row[1:], (words[1:] == words[:-1]) & (t.row[1:] == t.row[:-1]), t.rows)
    size = np.maximum(np.diff(offsets), 1)
    upto = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
    caps = upto((data >= 65) & (data <= 90))
    marks = upto(OTHER[data] & (data > 32))
    shares = np.stack([np.ones(t.rows), np.log1p(n) / 10, again / n, caps / size, marks / size], 1)
    return t, place, shares


class Model:
    def __init__(self) -> None:
        self.domains: list[str] = []
        self.evidence = np.zeros((PLACES, 0), np.float32)
        self.weights = np.zeros((SHARES, 0))

    def fit(self, texts: pa.Array, labels: list[str], rounds: int = 300) -> "Model":
        self.domains = sorted(set(labels))
        d = len(self.domains)
        if d == 0:
            return self
        goal = np.searchsorted(self.domains, labels)
        half, counts, parts = np.arange(len(goal)) % 2, np.zeros((2, PLACES, d)), []
        batch = pa.record_batch([texts, pa.array(np.arange(len(texts)))], ["text", "row"])
        for piece in pieces(iter([batch]), 0, 1 << 19):
            t, place, shares = _features(*text_bytes(piece.column(0)))
            rows = piece.column(1).to_numpy()
            key = np.unique(t.row * np.int64(PLACES) + place)  # once for each text
            row, at = rows[key // PLACES], key % PLACES
            for h in (0, 1):
                mine = half[row] == h
                np.add.at(counts[h], (at[mine], goal[row[mine]]), 1)
            parts.append((rows, t.row, t.rows, place, shares))
        x = np.zeros((len(goal), d + SHARES))
        for h in (0, 1):
            table = _log_ratio(counts[1 - h])
            for rows, row, n, place, shares in parts:
                seen = _gather(table, row, n, place, shares)
                mine = half[rows] == h
                x[rows[mine]] = seen[mine]
        self.evidence = _log_ratio(counts.sum(0))
        self.weights = _softmax_fit(x, goal, d, rounds)
        return self

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and probabilities of each domain, of each text."""
        t, place, shares = _features(*text_bytes(texts))
        return t.per_row(), _softmax(_gather(self.evidence, t.row, t.rows, place, shares) @ self.weights)


def _log_ratio(counts: np.ndarray) -> np.ndarray:
    """Evidence of a word for each domain, against all domains, with a prior of one text."""
    share = counts.sum(0) / max(counts.sum(), 1)
    p = (counts + share + 1e-9) / (counts.sum(1, keepdims=True) + 1)
    return np.log(p / np.maximum(share, 1e-9)).astype(np.float32)


def _gather(table: np.ndarray, row: np.ndarray, rows: int, place: np.ndarray, shares: np.ndarray) -> np.ndarray:
    d = table.shape[1]
    sums = np.stack([np.bincount(row, table[place, k], rows) for k in range(d)], 1) if d else np.zeros((rows, 0))
    n = np.maximum(np.bincount(row, minlength=rows), 1)[:, None]
    return np.concatenate([sums / np.sqrt(n), shares], 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    if not z.shape[1]:
        return z
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _softmax_fit(x: np.ndarray, goal: np.ndarray, d: int, rounds: int) -> np.ndarray:
    """Accelerated gradient descent on the penalised log loss, features brought to one scale."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    y, w = x / scale, np.zeros((x.shape[1], d))
    one, last = np.eye(d)[goal], w
    rate = 4.0 / max(np.linalg.norm(y, 2) ** 2 / len(y), 1e-9) / 2
    for t in range(rounds):
        ahead = w + t / (t + 3) * (w - last)
        last, w = w, ahead - rate * (y.T @ (_softmax(y @ ahead) - one) / len(y) + 1e-4 * ahead)
    return w / scale[:, None]


def learn(docs: DataFrame, labels: DataFrame, domain: str, sample_rows: int = 6000, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on about ``sample_rows`` labelled rows at most, chosen by a hash of the id. ``domain``: SQL text over ``labels``."""
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.expr(domain).cast("string").alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")
    chosen = chosen.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    there = chosen.count()
    if there > sample_rows:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(sample_rows / there * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.groupBy("doc_id", "domain").agg(F.min("text").alias("text")).toArrow()  # about sample_rows rows, however often an id repeats
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if got.num_rows else got
    texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    model = Model().fit(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, got.column("domain").to_pylist())
    del got, texts
    release()
    return model


def posteriors(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and posterior (an array over ``model.domains``) of each row."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # PLACES x domains
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):
            n, p = sent.value.posteriors(piece.column(1))
            yield pa.record_batch([piece.column(0), pa.array(n), _lists(p)], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, posterior array<double>")


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


def _rates(p: np.ndarray, gradients: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps so far, and the point at which the next gradient is taken."""
    rate = ahead = np.ones(len(p))
    for g, beta in gradients:
        new = np.maximum(ahead - p @ g, 0)
        rate, ahead = new, new + beta * (new - rate)
    return rate, ahead


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float], total: float | str | None = None, tolerance: float = 1e-4, steps: int = 120) -> list[tuple[np.ndarray, float]]:
    """The gradient steps that bring expected tokens to the targets.

    total: the tokens wanted over all domains; None: as many as there are; "cover": so many
    that no domain has to shrink.
    """
    d = len(domains)
    weights = np.array([max(float(targets.get(k, 0.0)), 0.0) for k in domains])
    if d == 0 or weights.sum() == 0:
        return []

    def sums(gradients: list[tuple[np.ndarray, float]] | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros(d * d + d if gradients is None else 2 * d)
            for batch in batches:
                n, p = batch.column(0).to_numpy().astype(float), batch.column(1).flatten().to_numpy().reshape(-1, d)
                if gradients is None:
                    whole += np.concatenate([((p * n[:, None]).T @ p).ravel(), n @ p])
                else:
                    rate, ahead = _rates(p, gradients)
                    whole += np.concatenate([(n * ahead) @ p, (n * rate) @ p])
            yield pa.record_batch([_lists(whole[None])], ["s"])

        rows = soft.select("n_tokens", "posterior").mapInArrow(run, "s array<double>").select(F.posexplode("s"))
        got = {r["pos"]: r["v"] for r in rows.groupBy("pos").agg(F.sum("col").alias("v")).collect()}  # one number per domain
        return np.array([got[k] for k in sorted(got)]) if got else np.zeros(d * d + d if gradients is None else 2 * d)

    first = sums(None)
    square, there = first[: d * d].reshape(d, d), first[d * d :]
    if there.sum() == 0:
        return []
    share = weights / weights.sum()
    if total == "cover":
        total = float((there[share > 0] / share[share > 0]).max())
    goal = share * (there.sum() if total is None else float(total)) / there.sum()
    step = 1.0 / max(np.linalg.eigvalsh(square / there.sum())[-1], 1e-9)
    gradients: list[tuple[np.ndarray, float]] = []
    point, t, off = there / there.sum(), 1.0, [np.inf] * 10
    for _ in range(steps):
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        gradients.append((step * (point - goal), (was - 1) / t))
        both = sums(gradients) / there.sum()
        point = both[:d]
        off.append(float(np.abs(both[d:] - goal).max()))
        if off[-1] <= tolerance * goal.max() or min(off[-10:]) > 0.99 * min(off[:-10]):
            break  # at the target, or, where no rates can meet it, as near as it gets
    return gradients


def rates(soft: DataFrame, gradients: list[tuple[np.ndarray, float]]) -> DataFrame:
    """``soft`` with the rate of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior")
            d = len(p.values) // max(batch.num_rows, 1)
            rate = _rates(p.flatten().to_numpy().reshape(batch.num_rows, d), gradients)[0] if batch.num_rows else np.zeros(0)
            yield batch.append_column("rate", pa.array(rate, pa.float64()))

    return soft.mapInArrow(run, f"doc_id {soft.schema['doc_id'].dataType.simpleString()}, n_tokens long, posterior array<double>, rate double")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str, total: float | str | None = None, sample_rows: int = 6000) -> tuple[DataFrame, list[str]]:
    """doc_id, n_tokens, posterior and rate of each row, and the domains in the order of the posteriors."""
    model = learn(docs, labels, domain, sample_rows)
    soft = cut(posteriors(docs, model))
    return rates(soft, fit_rates(soft, model.domains, targets, total)), model.domains


def take(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str, total: float | str | None = None, doc_id: str = "doc_id", least: int = 0) -> DataFrame:
    """Rows of ``docs`` as often as their rates say: the whole part of the rate, and one more if a hash of the id falls under the rest, but ``least`` times at least."""
    wanted, _ = mix_rates(docs, labels, targets, domain, total)
    u = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = wanted.groupBy("doc_id").agg(F.max("rate").alias("rate")).select(
        F.col("doc_id").alias("__taken_id"), F.greatest(F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long"), F.lit(least)).cast("int").alias("__copies")
    )
    met = docs.join(copies.filter("__copies > 0"), F.col(doc_id).eqNullSafe(F.col("__taken_id")))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
