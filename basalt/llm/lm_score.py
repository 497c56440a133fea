"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

Subwords are the first ids of a public byte-pair vocabulary, applied word by word; words are
parted by single blanks and every text closes with one end. A layer of causal self-attention
over a window of subwords, with learned biases for distance, meets the last subword's own
vector, and a tree of three softmax layers gives the next subword's probability. Windows
overlap: each scores its last ``STEP`` subwords with at least ``WIDE`` - ``STEP`` before
them, so each subword is scored once, in batches, the mask hiding later subwords and other
texts. The attention model is interpolated with pair counts of all training texts, which
are its zeroth layer and grow with the corpus.

The corpus is counted whole: words by 64-bit hash for the base score, pairs of subwords for
the model. The attention weights start from a fit on a bounded sample of training texts
(``sample_rows``), drawn by a hash of the id; from there each partition, as it counts, goes
on with windows that cover all its texts, and the weights of the partitions are averaged by
windows. One training text in ``share_part``, drawn by hash too, waits: with the averaged weights
and with pair counts that leave out the run of texts it comes with, its places tell the weight of the
interpolation; then the weights go on over it as well. So each place of all training texts is learned
from and counted. The commonest words (``HEAD`` at most)
and the pair table (vocabulary squared) are broadcast; the many rare words of each text
meet their counts in buckets.

Defined cases: null counts as empty: one token, the end; rows that repeat an id are scored
each and come back each; null ids are in no fold, so they are scored but not learned from;
with nothing to learn from, N and V are 0 and all words are unknown; where no text is apart, the
two models count alike; other columns are not read and don't come back; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import cut, fold, parallelism, pieces, short_batches, text_bytes
from basalt.llm._tokens import Tokens, U, mix

WIDE, STEP, EMBED, SIZE = 32, 24, 48, 32
BRANCH, VOCAB = 16, 4096
END = VOCAB - 1
HEAD = 400_000
MEMO = 150_000
#: Windows of a step over the texts of a partition, and its rate.
BATCH, RATE = 640, 0.006
#: A word with the blank before it, which is where pieces that open with a blank stand.
PATTERN = r" [^ ]+"
SCHEMA, NAMES = "kind int, bucket long, data binary", ["kind", "bucket", "data"]
COUNTS, PAIRS, TAIL, DOC, WEIGHTS, RATIOS = range(6)
#: Bins of the natural log of the attention model's probability over that of the pair counts, and how many make a nat.
BINS, FINE = 4096, 64


class Subwords:
    """Words as subword ids: the first ids of a ranked vocabulary, in alphabetical order, so that like pieces share branches of the tree."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = {k: v for k, v in ranks.items() if v < END}
        order = sorted(self.ranks, key=lambda k: (k[:1] == b" ", k))
        self.place = np.zeros(END, np.uint16)
        self.place[[self.ranks[k] for k in order]] = np.arange(len(order))
        self.memo: dict[bytes, bytes] = {}
        self.coder = self.opens = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "place": self.place, "memo": {}, "coder": None, "opens": None}

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The subwords of each word, two bytes each. Words that the memo lacks are coded together."""
        get = self.memo.get
        found = [get(w) for w in words]
        missed = [k for k, f in enumerate(found) if f is None]
        if missed:
            if self.coder is None:
                self.coder = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
                self.opens = np.zeros(END, bool)
                self.opens[[v for k, v in self.ranks.items() if k[:1] == b" "]] = True
            made = np.array(self.coder.encode_ordinary((b" " + b" ".join(words[k] for k in missed)).decode()))
            starts = np.append(np.flatnonzero(self.opens[made]), len(made)) * 2
            flat = self.place[made].tobytes()
            if len(self.memo) + len(missed) > MEMO:
                self.memo.clear()
            for k, a, b in zip(missed, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                found[k] = self.memo[words[k]] = flat[a:b]
        return found


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and which one every place holds."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.append(True, held[1:] != held[:-1])[: len(held)]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return held[new], order[new], at


class Stream:
    """The words of many texts and their subwords: x (before) and y (next) of every place, and its row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, subwords: Subwords) -> None:
        t = Tokens(data, offsets)
        self.tokens, self.rows = t, t.rows
        self.names, first, self.at = _distinct(t.words())
        raw = t.low.tobytes()
        coded = subwords.ids([raw[a:b] for a, b in zip(t.start[first].tolist(), t.end[first].tolist(), strict=True)])
        size = np.array([len(c) // 2 for c in coded], np.int64)
        flat = np.frombuffer(b"".join(coded), np.uint16)
        begin = np.cumsum(size) - size
        # each row's words, then its end
        row = np.concatenate([t.row, np.arange(t.rows)])
        order = np.argsort(row, kind="stable")
        n = np.concatenate([size[self.at], np.ones(t.rows, np.int64)])[order]
        start = np.concatenate([begin[self.at], np.full(t.rows, len(flat))])[order]
        flat = np.append(flat, np.uint16(END))
        take = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        self.y = flat[take]
        self.row = np.repeat(row[order], n)
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[:1] = END  # a text begins as the one before it has ended


# the model


@contextlib.contextmanager
def one_thread() -> Iterator[None]:
    """Holds numpy's OpenBLAS to one thread, where it can be found: many small products lose time to more."""
    try:
        with open("/proc/self/maps") as f:
            path = next(line.split()[-1] for line in f if "openblas" in line)
        library = ctypes.CDLL(path)
        name = next(n for n in ("scipy_openblas_{}64_", "scipy_openblas_{}", "openblas_{}64_", "openblas_{}") if hasattr(library, n.format("set_num_threads")))
        put, was = getattr(library, name.format("set_num_threads")), getattr(library, name.format("get_num_threads"))()
    except (OSError, StopIteration):
        yield
        return
    put(1)
    try:
        yield
    finally:
        put(was)


def _squash(z: np.ndarray) -> np.ndarray:
    return z / (1 + np.abs(z))


def _windows(length: int) -> int:
    return -(-length // STEP)


class Adam:
    """Moments of the gradients of weights, which each step changes."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w, self.t = w, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.s = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, g: dict[str, np.ndarray], lr: float) -> None:
        self.t += 1
        for k in self.w:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.01 * (g[k] * g[k] - self.s[k])
            self.w[k] -= (lr / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-8)


class Attention:
    """The weights, their use and their training."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        s = lambda *shape: (r.normal(size=shape) * 0.1).astype(np.float32)
        self.w = {
            "emb": s(VOCAB, EMBED), "q": s(EMBED, SIZE), "k": s(EMBED, SIZE), "v": s(EMBED, SIZE), "e": s(EMBED, SIZE) * 3,
            "far": np.zeros(WIDE, np.float32), "c1": s(1, SIZE + 1, BRANCH), "c2": s(BRANCH, SIZE + 1, BRANCH), "c3": s(BRANCH**2, SIZE + 1, BRANCH),
        }
        self.tables: tuple | None = None

    def ready(self) -> None:
        emb = self.w["emb"]
        self.tables = tuple(np.ascontiguousarray(emb @ self.w[k]) for k in "qkve")

    def bias(self) -> np.ndarray:
        """The bias of each distance, and the mask of later subwords."""
        gap = (np.arange(STEP)[:, None] + WIDE - STEP) - np.arange(WIDE)[None, :]
        return np.where(gap >= 0, self.w["far"][np.maximum(gap, 0)], np.float32(-1e9)).astype(np.float32)

    def attend(self, x: np.ndarray, row: np.ndarray, windows: np.ndarray | None = None) -> tuple:
        """Attention output of each scored place of the windows over a stream padded in front by WIDE - STEP."""
        q, k, v, e = self.tables
        view = np.lib.stride_tricks.sliding_window_view
        keys, rows = view(x, WIDE)[::STEP], view(row, WIDE)[::STEP]
        if windows is not None:
            keys, rows = view(x, WIDE)[windows], view(row, WIDE)[windows]
        ask = keys[:, WIDE - STEP :]
        s = np.matmul(q[ask], k[keys].transpose(0, 2, 1))
        s *= np.float32(1 / math.sqrt(SIZE))
        s += self.bias()
        mixed = np.flatnonzero(rows[:, 0] != rows[:, -1])
        if len(mixed):
            r = rows[mixed]
            s[mixed] = np.where(r[:, WIDE - STEP :, None] == r[:, None, :], s[mixed], np.float32(-1e9))
        np.minimum(s, np.float32(40), out=s)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        seen = v[keys]
        h = _squash(e[ask] + np.matmul(s, seen))
        return keys, ask, s, seen, h.reshape(-1, SIZE)

    def states(self, px: np.ndarray, pr: np.ndarray, count: int) -> np.ndarray:
        """As ``attend``, for ``count`` windows in a row: their vectors are looked up once and windows are views."""
        q, k, v, e = self.tables
        head, at = WIDE - STEP, px.astype(np.intp)
        mid = at[head : head + count * STEP]
        view = lambda t: np.lib.stride_tricks.as_strided(t, (count, WIDE, SIZE), (STEP * SIZE * 4, SIZE * 4, 4))
        s = np.matmul(q[mid].reshape(count, STEP, SIZE), view(k[at]).transpose(0, 2, 1))
        s *= np.float32(1 / math.sqrt(SIZE))
        s += self.bias()
        rows = np.lib.stride_tricks.sliding_window_view(pr, WIDE)[::STEP][:count]
        mixed = np.flatnonzero(rows[:, 0] != rows[:, -1])
        if len(mixed):
            r = rows[mixed]
            s[mixed] = np.where(r[:, head:, None] == r[:, None, :], s[mixed], np.float32(-1e9))
        np.minimum(s, np.float32(40), out=s)
        np.exp(s, out=s)
        h = np.matmul(s, view(v[at]))
        h /= s.sum(2, keepdims=True)
        h = h.reshape(-1, SIZE)
        h += e[mid]
        return _squash(h)

    def next_log(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of y after states h."""
        order = np.argsort(y, kind="stable")
        hs, ys = np.empty((len(y), SIZE + 1), np.float32), y[order].astype(np.int64)
        hs[:, :SIZE], hs[:, SIZE] = h[order], 1
        total = np.zeros(len(y), np.float32)
        for weights, step in (("c1", BRANCH**3), ("c2", BRANCH**2), ("c3", BRANCH)):
            group, logits = ys // step, np.empty((len(y), BRANCH), np.float32)
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                np.matmul(hs[a:b], self.w[weights][group[a]], out=logits[a:b])
            np.minimum(logits, np.float32(60), out=logits)
            branch = ys // (step // BRANCH) % BRANCH
            chosen = logits[np.arange(len(y)), branch]
            np.exp(logits, out=logits)
            total += chosen - np.log(logits.sum(1))
        out = np.empty(len(y), np.float32)
        out[order] = total
        return out

    def score(self, x: np.ndarray, y: np.ndarray, row: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Natural log of the probability of each y."""
        n, head = len(y), WIDE - STEP
        count = _windows(n)
        tail = count * STEP - n
        px = np.concatenate([np.full(head, END, x.dtype), x, np.full(tail, END, x.dtype)])
        pr = np.concatenate([np.full(head, -1, np.int64), row, np.full(tail, -2, np.int64)])
        out = np.empty(n, np.float32)
        for at in range(0, count, batch):
            a, z = at * STEP, min(count, at + batch) * STEP
            h = self.states(px[a : z + head], pr[a : z + head], (z - a) // STEP)
            stop = min(z, n)
            out[a:stop] = self.next_log(h[: stop - a], y[a:stop])
        return out

    def train(self, x: np.ndarray, y: np.ndarray, row: np.ndarray, steps: int, batch: int = 160, rate: float = 0.01, seed: int = 3) -> "Attention":
        """Adam on the mean log loss of random windows."""
        r, head = np.random.default_rng(seed), WIDE - STEP
        if len(y) < WIDE:
            self.ready()
            return self
        px = np.concatenate([np.full(head, END, x.dtype), x])
        pr = np.concatenate([np.full(head, -1, np.int64), row])
        adam = Adam(self.w)
        for t in range(1, steps + 1):
            self.ready()
            windows = np.sort(r.integers(0, len(y) - STEP + 1, batch))
            g = self._gradient(px, pr, y, windows)
            adam.step(g, rate * min(1.0, t / 40) * (1 - t / (steps + 1)) ** 0.5)
        self.ready()
        return self

    def go_on(self, x: np.ndarray, y: np.ndarray, row: np.ndarray, adam: Adam, r: np.random.Generator) -> int:
        """Steps over windows that cover all places of a stream, in a drawn order; gives their number."""
        if not len(y):
            return 0
        if len(y) < STEP:
            times = -(-STEP // len(y))
            row = (row + (np.arange(times) * (row[-1] + 1))[:, None]).ravel()
            x, y = np.tile(x, times), np.tile(y, times)
        head = WIDE - STEP
        px = np.concatenate([np.full(head, END, x.dtype), x])
        pr = np.concatenate([np.full(head, -1, np.int64), row])
        windows = r.permutation(np.unique(np.clip(np.arange(-r.integers(0, STEP), len(y), STEP), 0, len(y) - STEP)))
        for part in np.array_split(windows, -(-len(windows) // BATCH)):
            self.ready()
            # a short batch is a noisy one, so it moves less
            adam.step(self._gradient(px, pr, y, np.sort(part)), RATE * min(1.0, (adam.t + 1) / 20) * min(1.0, len(part) / BATCH) ** 0.5)
        return len(windows)

    def _gradient(self, px: np.ndarray, pr: np.ndarray, y: np.ndarray, windows: np.ndarray) -> dict[str, np.ndarray]:
        w, (q, k, v, e) = self.w, self.tables
        keys, ask, a, seen, h = self.attend(px, pr, windows)
        goal = y[windows[:, None] + np.arange(STEP)].reshape(-1)
        n = len(goal)
        order = np.argsort(goal, kind="stable")
        hs, ys = np.concatenate([h[order], np.ones((n, 1), np.float32)], 1), goal[order].astype(np.int64)
        g = {key: np.zeros_like(x) for key, x in w.items()}
        dh = np.zeros((n, SIZE), np.float32)
        for name, step in (("c1", BRANCH**3), ("c2", BRANCH**2), ("c3", BRANCH)):
            group, c = ys // step, w[name]
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            spans = list(zip(group[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            p = np.empty((n, BRANCH), hs.dtype)
            for at, i, j in spans:
                np.matmul(hs[i:j], c[at], out=p[i:j])
            np.exp(np.minimum(p, 60, out=p), out=p)
            p *= 1 / (p @ np.full((BRANCH, 1), n, p.dtype))
            p[np.arange(n), ys // (step // BRANCH) % BRANCH] -= 1 / n
            for at, i, j in spans:
                np.matmul(hs[i:j].T, p[i:j], out=g[name][at])
                dh[i:j] += p[i:j] @ c[at, :SIZE].T
        back = np.empty_like(dh)
        back[order] = dh
        dz = (back * (1 - np.abs(h)) ** 2).reshape(len(windows), STEP, SIZE)
        da = np.matmul(dz, seen.transpose(0, 2, 1))
        dv = np.matmul(a.transpose(0, 2, 1), dz)
        ds = a * (da - (da * a).sum(2, keepdims=True))
        gap = (np.arange(STEP)[:, None] + WIDE - STEP) - np.arange(WIDE)[None, :]
        g["far"] = np.bincount(np.maximum(gap, 0).ravel(), np.where(gap >= 0, ds.sum(0), 0).ravel(), WIDE).astype(np.float32)
        ds *= np.float32(1 / math.sqrt(SIZE))
        dq, dk = np.matmul(ds, k[keys]), np.matmul(ds.transpose(0, 2, 1), q[ask])
        for names, at, pair in (("qe", ask, (dq, dz)), ("kv", keys, (dk, dv))):
            flat, d = at.ravel(), np.concatenate(pair, 2).reshape(-1, 2 * SIZE)
            by = np.argsort(flat, kind="stable")
            held, d = flat[by], d[by]
            edges = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1], [True]]))
            ids, ones = held[edges[:-1]], np.ones((1, len(held)), d.dtype)
            whole = np.empty((len(ids), 2 * SIZE), d.dtype)
            for m, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                np.matmul(ones[:, i:j], d[i:j], out=whole[m : m + 1])
            both = w["emb"][ids].T @ whole
            g[names[0]], g[names[1]] = both[:, :SIZE], both[:, SIZE:]
            g["emb"][ids] += whole @ np.concatenate([w[names[0]], w[names[1]]], 1).T
        return g


class Scorer:
    """The attention model and the pair counts, interpolated."""

    def __init__(self, subwords: Subwords, attention: Attention, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.subwords, self.attention, self.pairs, self.counts = subwords, attention, pairs, counts
        self.share, self.table, self.margins = 0.5, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "margins": None}

    def pair_probability(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.table is None:
            one = np.bincount(self.pairs % VOCAB, self.counts, VOCAB) + 0.5
            one = one / one.sum()
            before = np.bincount(self.pairs // VOCAB, self.counts, VOCAB)
            kinds = np.bincount(self.pairs // VOCAB, minlength=VOCAB) + 1.0
            # Witten and Bell: as much room for what was not seen as there were different successors
            room = (kinds / (before + kinds)).astype(np.float32)
            table = (room[:, None] * one.astype(np.float32)[None, :]).ravel()
            table[self.pairs] += (self.counts / (before + kinds)[self.pairs // VOCAB]).astype(np.float32)
            self.table = table
        return self.table[x.astype(np.int64) * VOCAB + y]

    def left_out(self, stream: Stream) -> np.ndarray:
        """As ``pair_probability`` of a stream's places, with counts that hold the stream and leave it out here."""
        mine, at, n = np.unique(stream.x.astype(np.int64) * VOCAB + stream.y, return_inverse=True, return_counts=True)
        if self.margins is None:
            x = self.pairs // VOCAB
            self.margins = np.bincount(self.pairs % VOCAB, self.counts, VOCAB), np.bincount(x, self.counts, VOCAB), np.bincount(x, minlength=VOCAB)
        one, before, kinds = self.margins
        x, y = mine // VOCAB, mine % VOCAB
        rest = self.counts[np.searchsorted(self.pairs, mine)] - n
        one, before = one - np.bincount(y, n, VOCAB) + 0.5, before - np.bincount(x, n, VOCAB)
        kinds = kinds - np.bincount(x[rest == 0], minlength=VOCAB) + 1.0
        return ((kinds[x] * one[y] / one.sum() + rest) / (before + kinds)[x])[at]

    def ratios(self, stream: Stream) -> np.ndarray:
        """How many places of texts, that the attention model wasn't fitted on, have which ratio of the two probabilities."""
        log = self.attention.score(stream.x, stream.y, stream.row) - np.log(self.left_out(stream))
        return np.bincount(np.clip(np.rint(log * FINE) + BINS // 2, 0, BINS - 1).astype(np.int64), minlength=BINS)

    def settle(self, ratios: np.ndarray) -> "Scorer":
        """The likeliest share of the attention model."""
        r = np.exp((np.arange(BINS) - BINS // 2) / FINE)
        for _ in range(30 if ratios.sum() else 0):
            self.share = float(np.clip(np.average(self.share * r / (self.share * r + 1 - self.share), weights=ratios), 0.02, 0.98))
        return self

    def fit_share(self, stream: Stream) -> "Scorer":
        """The share of the attention model, by places of texts that it wasn't fitted on; the pair counts hold them and leave them out here."""
        return self.settle(self.ratios(stream))

    def score(self, stream: Stream) -> np.ndarray:
        """log10 of the probability of each text."""
        p = np.exp(self.attention.score(stream.x, stream.y, stream.row))
        p *= np.float32(self.share)
        p += np.float32(1 - self.share) * self.pair_probability(stream.x, stream.y)
        return np.bincount(stream.row, np.log10(np.maximum(p, 1e-37)), stream.rows)


# the corpus


def _blob(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], NAMES)


def _deal(kind: int, home: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    by = np.argsort(home, kind="stable")
    home = home[by]
    edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(home) else np.zeros(1, int)
    return [(kind, int(home[a]), pickle.dumps([x[by[a:e]] for x in arrays], 5)) for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _add(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    return names, np.bincount(at, np.concatenate(values), len(names)).astype(np.int64)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> U(20)) % U(buckets)).astype(np.int64)


def _count(sent, buckets: int, fan: int, flush: int = 1_500_000) -> Callable:
    """Counts of words and pairs; and the attention weights after the partition's windows, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, start = sent.value
        attention, part = Attention(), TaskContext.get().partitionId() if TaskContext.get() else 0
        attention.w = {k: v.copy() for k, v in start.items()}
        adam, drawn, seen = Adam(attention.w), np.random.default_rng([17, part]), 0
        words, pairs, held = ([], []), ([], []), 0

        def merge() -> None:
            nonlocal words, pairs, held
            w, p = _add(*words), _add(*pairs)
            words, pairs, held = ([w[0]], [w[1]]), ([p[0]], [p[1]]), len(w[0]) + len(p[0])

        def send() -> list[tuple[int, int, bytes]]:
            return _deal(COUNTS, _bucket(words[0][0], buckets), words[0][0], words[1][0]) + _deal(PAIRS, pairs[0][0] // VOCAB % buckets, pairs[0][0], pairs[1][0])

        for piece in pieces(batches, 0):
            s = Stream(*text_bytes(piece.column(0)), subwords)
            fit = ~np.asarray(piece.column(1))[s.row]
            with one_thread():
                seen += attention.go_on(s.x[fit], s.y[fit], s.row[fit], adam, drawn)
            words[0].append(s.names)
            words[1].append(np.bincount(s.at, minlength=len(s.names)))
            pair, n = np.unique(s.x.astype(np.int32) * np.int32(VOCAB) + s.y, return_counts=True)
            pair = pair.astype(np.int64)
            pairs[0].append(pair)
            pairs[1].append(n)
            held += len(s.names) + len(pair)
            if held > flush:
                merge()
                if held > flush // 2:
                    yield _blob(send())
                    words, pairs, held = ([], []), ([], []), 0
        if held:
            merge()
            yield _blob(send())
        if seen:
            yield _blob([(WEIGHTS, part % fan, pickle.dumps([seen, attention.w], 5))])

    return run


def _settle(sent, fan: int) -> Callable:
    """Ratios of the places of texts that waited; and the attention weights after the partition's windows of them, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        walk, part = Attention(), TaskContext.get().partitionId() if TaskContext.get() else 0
        walk.w = {k: v.copy() for k, v in scorer.attention.w.items()}
        adam, drawn, seen, ratios = Adam(walk.w), np.random.default_rng([19, part]), 0, np.zeros(BINS, np.int64)
        for piece in pieces(batches, 0):
            s = Stream(*text_bytes(piece.column(0)), scorer.subwords)
            with one_thread():
                ratios += scorer.ratios(s)
                seen += walk.go_on(s.x, s.y, s.row, adam, drawn)
        if seen:
            yield _blob([(RATIOS, part % fan, pickle.dumps(ratios, 5)), (WEIGHTS, part % fan, pickle.dumps([seen, walk.w], 5))])

    return run


def _whole(got: list) -> tuple[int, dict[str, np.ndarray]]:
    """Windows, and the mean of the weights by them."""
    windows = sum(g[0] for g in got)
    return windows, {k: sum(w[k] * np.float64(n / windows) for n, w in got).astype(np.float32) for k in got[0][1]}


def _sum(table: pa.Table) -> pa.Table:
    """The counts of a bucket, and for words how many there are of each size of count."""
    got = [pickle.loads(x.as_py()) for x in table.column("data")]
    kind, b = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    if kind in (WEIGHTS, RATIOS):
        names, counts = _whole(got) if kind == WEIGHTS else (int(sum(g.sum() for g in got)), sum(got))
        many, total, sizes = 0, names, np.zeros(64, int)
    else:
        names, counts = _add([g[0] for g in got], [g[1] for g in got])
        many, total, sizes = len(names), int(counts.sum()), np.bincount(np.frexp(counts.astype(float))[1], minlength=64)
    return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([b], pa.int64()), "data": pa.array([pickle.dumps([names, counts], 5)], pa.binary()),
                     "distinct": pa.array([many]), "total": pa.array([total]), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64()))})


def _above(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(0):
                names, counts = pickle.loads(data.as_py())
                out.append(pickle.dumps([names[counts >= least], counts[counts >= least]], 5))
            yield pa.record_batch([pa.array(out, pa.binary())], ["data"])

    return run


def _gather(df: DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    got = [pickle.loads(bytes(r[0])) for r in df.collect()]
    names = np.concatenate([g[0] for g in got]) if got else np.zeros(0, kind)
    counts = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
    by = np.argsort(names)
    return names[by], counts[by]


class Places:
    """Numbers for the rows of a partition: they follow from what rows hold, not from the order they come in.

    Rows that hold the same are told apart by how many came before; their scores are equal, so it
    doesn't matter which is which. A number that another row has already moves on by one.
    """

    BITS, STRIDE = 40, 0x9E3779B97F

    def __init__(self, partition: int) -> None:
        self.base, self.times, self.used = partition << self.BITS, {}, set()

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out, mask = np.empty(len(hashes), U), (1 << self.BITS) - 1
        for k, h in enumerate((hashes.view(U) & U(mask)).tolist()):
            n = self.times[h] = self.times.get(h, -1) + 1
            place = (h + n * self.STRIDE) & mask
            while place in self.used:
                place = (place + 1) & mask
            self.used.add(place)
            out[k] = self.base + place
        return mix(out)


def _score(sent, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, head, counts, ends, learned = sent.value
        places = Places(TaskContext.get().partitionId())
        for piece in pieces(batches, 1, 1 << 20):
            s = Stream(*text_bytes(piece.column(1)), scorer.subwords)
            score = scorer.score(s)
            at = np.minimum(np.searchsorted(head, s.names), max(len(head) - 1, 0))
            known = head[at] == s.names if len(head) else np.zeros(len(s.names), bool)
            logs = np.where(known, np.log10(counts[at] + 1.0) if len(head) else 0.0, 0.0)
            row = s.tokens.row
            mine = np.bincount(row, logs[s.at], s.rows) + math.log10(ends + 1)
            hits = np.bincount(row, known[s.at], s.rows).astype(np.int64) + (ends > 0)
            key = places.of(piece.column(2).to_numpy())
            home = (key % U(buckets)).astype(np.int64)
            doc = piece.column(0).cast(pa.int64())
            rows = _deal(DOC, home, key, np.asarray(doc.fill_null(0)), np.asarray(doc.is_valid()), s.tokens.per_row() + 1, hits, mine, score)
            if learned:
                tail = ~known[s.at]
                pair, times = np.unique(row[tail] * np.int64(len(s.names)) + s.at[tail], return_counts=True)
                names, owner = s.names[pair % len(s.names)], key[pair // len(s.names)]
                rows += _deal(TAIL, _bucket(names, buckets), names, owner, times.astype(np.uint32))
            yield _blob(rows)

    return run


def _meet(buckets: int) -> Callable:
    """The rare words of a bucket meet their counts; sums go to the rows' places."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        data = table.column("data")
        passed = table.filter(pa.compute.equal(table.column("kind"), DOC)).select(NAMES)
        tails = [pickle.loads(data[k].as_py()) for k, kind in enumerate(kinds) if kind == TAIL]
        counted = [pickle.loads(data[k].as_py()) for k, kind in enumerate(kinds) if kind == COUNTS]
        if not tails or not counted:
            return passed
        names, counts = counted[0]
        word, owner, times = (np.concatenate([t[k] for t in tails]) for k in range(3))
        at = np.minimum(np.searchsorted(names, word), len(names) - 1)
        has = names[at] == word
        owner, c, times = owner[has], counts[at][has], times[has].astype(np.int64)
        who, place = np.unique(owner, return_inverse=True)
        hits, logs = np.bincount(place, times, len(who)).astype(np.int64), np.bincount(place, times * np.log10(c + 1.0), len(who))
        return pa.concat_tables([passed, pa.Table.from_batches([_blob(_deal(TAIL, (who % U(buckets)).astype(np.int64), who, hits, logs))])])

    return run


def _finish(total: int, distinct: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data")
        docs = [pickle.loads(data[k].as_py()) for k, kind in enumerate(kinds) if kind == DOC]
        tails = [pickle.loads(data[k].as_py()) for k, kind in enumerate(kinds) if kind == TAIL]
        key, doc, valid, tokens, hits, logs, score = (np.concatenate([d[k] for d in docs]) for k in range(7))
        by = np.argsort(key)
        key, doc, valid, tokens, hits, logs, score = (x[by] for x in (key, doc, valid, tokens, hits, logs, score))
        if tails:
            who, more, sums = (np.concatenate([t[k] for t in tails]) for k in range(3))
            by = np.argsort(who, kind="stable")
            at = np.searchsorted(key, who[by])
            hits = hits + np.bincount(at, more[by], len(key)).astype(np.int64)
            logs = logs + np.bincount(at, sums[by], len(key))
        base = logs - tokens * math.log10(total + distinct + 1)
        ids = pa.array(doc, pa.int64(), mask=~valid)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(hits), "base_score": pa.array(base), "score": pa.array(score.astype(float))})

    return run


def score_documents(docs: DataFrame, ranks: dict[bytes, int], mod: int = 7, rest: int = 2, sample_rows: int = 1500, steps: int = 1400, share_part: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    short_batches(spark)
    buckets = 2 * parallelism(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learn = rows.filter(~fold("doc_id", mod, rest) & F.col("doc_id").isNotNull())
    subwords = Subwords(ranks)
    ends = learn.count()
    drawn = lambda key, share: F.pmod(key, F.lit(1 << 24)) < int(min(1.0, share) * (1 << 24))
    learn = learn.select("doc_id", "text", drawn(F.xxhash64("doc_id", "text", F.lit(9)), 1 / share_part).alias("apart"))

    def streamed(some: DataFrame, most: int) -> Stream:
        found = some.orderBy("doc_id", F.xxhash64("text")).limit(most).select("text").toArrow()
        texts = found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string())
        return Stream(*text_bytes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts), subwords)

    stream = streamed(learn.filter(~F.col("apart") & drawn(F.xxhash64("doc_id", F.lit(8)), sample_rows / max(ends, 1))), 2 * sample_rows)
    with one_thread():
        attention = Attention().train(stream.x, stream.y, stream.row, steps)
    fit = spark.sparkContext.broadcast((subwords, attention.w))
    fan = max(1, math.isqrt(learn.rdd.getNumPartitions()))
    counted = cut(
        learn.select("text", "apart").mapInArrow(_count(fit, buckets, fan), SCHEMA).groupBy("kind", "bucket")
        .applyInArrow(_sum, f"{SCHEMA}, distinct long, total long, sizes array<long>")
    )
    said = counted.filter(F.col("kind") == COUNTS)
    sizes = said.select(F.posexplode("sizes").alias("size", "n"), "distinct", "total")
    sizes = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # 64 numbers
    whole = said.agg(F.sum("distinct"), F.sum("total")).first()
    distinct, total = (whole[0] or 0) + (ends > 0), (whole[1] or 0) + ends
    size, many = 63, 0
    while size > 0 and many + sizes.get(size, 0) <= HEAD:
        many += sizes.get(size, 0)
        size -= 1
    head, counts = _gather(said.select("data").mapInArrow(_above(1 << size if size else 1), "data binary"), U)  # HEAD words at most
    pairs, times = _gather(counted.filter(F.col("kind") == PAIRS).select("data"), np.int64)  # VOCAB squared at most
    def walked(df: DataFrame) -> None:
        got = [pickle.loads(bytes(r[0])) for r in df.filter(F.col("kind") == WEIGHTS).select("data").collect()]  # the root of the partitions at most
        if got:
            attention.w = _whole(got)[1]
        attention.ready()

    walked(counted)
    scorer = Scorer(subwords, attention, pairs, times)
    waiting = spark.sparkContext.broadcast(scorer)
    settled = cut(learn.filter("apart").select("text").mapInArrow(_settle(waiting, fan), SCHEMA).groupBy("kind", "bucket").applyInArrow(_sum, f"{SCHEMA}, distinct long, total long, sizes array<long>"))
    waiting.destroy()
    scorer.settle(sum((pickle.loads(bytes(r[0]))[1] for r in settled.filter(F.col("kind") == RATIOS).select("data").collect()), np.zeros(BINS, np.int64)))
    walked(settled)
    sent = spark.sparkContext.broadcast((scorer, head, counts, ends, total > 0))
    first = rows.withColumn("hash", F.xxhash64("doc_id", "text")).mapInArrow(_score(sent, buckets), SCHEMA).unionByName(said.select(NAMES))
    met = first.groupBy("bucket").applyInArrow(_meet(buckets), SCHEMA)
    done = met.groupBy("bucket").applyInArrow(_finish(total, distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    kind = docs.schema[doc_id].dataType
    return done.select(
        F.col("doc_id").cast(kind).alias("doc_id"), fold("doc_id", mod, rest).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )
