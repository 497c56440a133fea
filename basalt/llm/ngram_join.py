"""Jaccard self-join of documents on word n-grams with adaptive multi-match prefixes.

Two documents link when ``den`` * intersection >= ``num`` * union of their sets of shingles.
In any common order of shingles, sets that link share at least l of their first
n - ceil(t n) + l shingles (AdaptJoin). The join uses this twice:

1. Each text gives its first shingles in the order of their hashes, with l a tenth of the
   set or more (short sets give all): a sample in which linked sets share as many. The shingles meet in buckets, which
   count in how many documents each occurs. A document that shares fewer than it must is
   done: nothing links with it.
2. What is left is ordered by that count, and every document picks its own l: a longer prefix
   costs more postings, but asks for more shared shingles and so leaves fewer candidates; both
   are estimated from the counts of its rarest shingles. Sizes are cut into classes, in which
   the largest set is at most den / num times the smallest, so that only sets of one class or
   of two neighbouring ones can link. In each window of two classes, documents that share a
   prefix shingle form candidate components.
3. Samples, not texts, of a component meet: small components in shared tasks, large ones in
   pairs of blocks. A pair is a candidate if the prefixes share the smaller l of the two, and
   if the samples share so many that the whole sets may link, as all of the sample with the
   smaller last hash is known of both. All candidates are proposed where they are few for
   their documents, else a spanning forest of them.
4. Proposed pairs, each on its own, meet with their texts and are verified on the whole sets.
   Where some of a forest fail, its task proposes again among documents not connected yet,
   four times as many forests in each round, until no candidate is left untested that could
   connect two.

Equal sets are one candidate, however many documents have them. Hashes have 64 bits.

Defined cases: texts without words, or null, have no shingles and link with nothing; texts
of fewer words than n have one shingle, the whole; rows that repeat an id stand for one
document, that of the least fingerprint if their texts differ; null ids come back with their
size and no component; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm._graph import components
from basalt.llm._spark import cut, parallelism, pieces, short_batches, sweep, text_bytes, trim
from basalt.llm._tokens import Tokens, U, mix

#: The part of a set by which its first prefix is longer than one shared shingle needs.
SHARE = 10
#: Sets of up to so many shingles are sampled whole, so that samples decide; of others this many at least are.
WHOLE = 128
#: Documents of a block; two blocks, or small components of as many, meet in one task. Shingles verified in one.
BLOCK, VERIFY = 512, 1 << 19
#: Documents that share a shingle, up to which their pairs are listed; beyond, matrices count.
FEW = 16
#: Candidates of a document, in the mean of its task, up to which all are proposed at once.
EACH = 8
INFO, POST = 0, 1
POSTING = np.dtype([("doc", "<i8"), ("token", "<u8")])
SHARED = np.dtype([("doc", "<i8"), ("token", "<u8"), ("df", "<u4")])
ABOUT = np.dtype([("doc", "<i8"), ("n", "<u4"), ("x", "<u4"), ("f", "<u8"), ("g", "<u8"), ("last", "<u8")])
SCHEMA, NAMES = "kind int, bucket long, data binary", ["kind", "bucket", "data"]


def shingle_sets(tokens: Tokens, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words = tokens.words()
    s = words[: max(len(words) - size + 1, 0)].copy()
    for k in range(1, size):
        s = mix(s * U(0x9E3779B97F4A7C15) + words[k : k + len(s)])
    edges = np.searchsorted(tokens.row, np.arange(tokens.rows + 1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, U)
            for k in range(a, b):
                whole = mix(whole * U(0x9E3779B97F4A7C15) + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def _least(n: np.ndarray | int, num: int, den: int):
    """ceil(n num / den)."""
    return -(-n * num // den)


def _longer(n):
    return -(-n // SHARE)


def sample_size(n, num: int, den: int):
    """A tenth of the set more than what sets that link may lack of each other; ``WHOLE`` at least, or all."""
    return np.minimum(n, np.maximum(WHOLE, n - _least(n, num, den) + np.maximum(1, _longer(n))))


def must_share(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles that a set of n shares at least with a set it links with, both samples.

    All of the sample with the smaller last hash is known of both, and lacks at most what the
    whole set may lack: the least of this over all sizes that can link. Sizes past ``edge``
    have it at the smallest of them.
    """

    def known(m: np.ndarray) -> np.ndarray:
        return np.maximum(1, sample_size(m, num, den) - m + _least(m, num, den))

    if not len(n):
        return n
    edge = 2 * SHARE * WHOLE
    out = np.where(_least(n, num, den) >= edge, known(_least(n, num, den)), 1)
    near = np.flatnonzero(_least(n, num, den) < edge)
    sizes = np.unique(n[near])
    table = {int(m): int(known(np.arange(_least(int(m), num, den), int(m) * den // num + 1)).min()) if m else 1 for m in sizes}
    out[near] = [table[int(m)] for m in n[near]]
    return out


def pack(array: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(array[f]).tobytes() for f in array.dtype.names)


def unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for f in kind.names:
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += kind[f].itemsize * n
    return out


def _blobs(array: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    by = np.lexsort((array["doc"], bucket))
    array, bucket = array[by], bucket[by]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(array) else np.zeros(1, int)
    return [(kind, int(bucket[a]), pack(array[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _rows(rows: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    return [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]


def _home(doc: np.ndarray, homes: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U)) % U(homes)).astype(np.int64)


def _prefixes(size: int, num: int, den: int, buckets: int, flush: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, posts, count = [], [], 0

        def send() -> pa.RecordBatch:
            info = np.array(about, ABOUT)
            doc, token = np.concatenate([p[0] for p in posts]), np.concatenate([p[1] for p in posts])
            post = np.empty(len(doc), POSTING)
            post["doc"], post["token"] = doc, token
            rows = _blobs(info, _home(info["doc"], buckets), INFO) + _blobs(post, ((post["token"] >> U(20)) % U(buckets)).astype(np.int64), POST)
            return pa.record_batch(_rows(rows), NAMES)

        for piece in pieces(batches, 1):
            ids = piece.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for doc, found in zip(ids.tolist(), shingle_sets(Tokens(*text_bytes(piece.column(1))), size), strict=True):
                n = len(found)
                x = int(sample_size(n, num, den))
                about.append((doc, n, x, *_fingerprint(found), int(found[x - 1]) if x < n else (1 << 64) - 1))
                posts.append((np.full(x, doc, np.int64), found[:x]))
                count += x + 4
            if count >= flush:
                yield send()
                about, posts, count = [], [], 0
        if about:
            yield send()

    return run


def _count(homes: int):
    """Shingles of a bucket that more than one document has, sent to the documents' homes."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == INFO:
            return table.select(NAMES)
        post = np.concatenate([unpack(x.as_py(), POSTING) for x in table.column("data")])
        post = post[np.lexsort((post["doc"], post["token"]))]
        new = np.concatenate([[True], (post["token"][1:] != post["token"][:-1]) | (post["doc"][1:] != post["doc"][:-1])])
        post = post[new]
        edges = np.flatnonzero(np.concatenate([[True], post["token"][1:] != post["token"][:-1], [True]]))
        df = np.repeat(np.diff(edges), np.diff(edges))
        out = np.empty(int((df > 1).sum()), SHARED)
        out["doc"], out["token"], out["df"] = post["doc"][df > 1], post["token"][df > 1], df[df > 1]
        return pa.Table.from_arrays(_rows(_blobs(out, _home(out["doc"], homes), POST)), NAMES)

    return run


def choose_level(df: np.ndarray, need: int) -> tuple[int, int]:
    """The l of a document and its prefix length, from the counts of its shared shingles, rarest first.

    l takes the value of least estimated cost: postings scanned, and eight times as much for
    each candidate that remains to be verified, postings over l times l being its estimate.
    """
    tries = np.arange(1, need + 1)
    postings = np.cumsum(df.astype(np.int64) - 1)[len(df) - need + tries - 1]
    level = int(tries[int((postings + 8.0 * postings / (tries * tries)).argmin())])
    return level, len(df) - need + level


def _judge(num: int, den: int):
    """Per document: size, fingerprint, whether it may link, its sample's extent, its l, its prefix and all shared shingles, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        blobs = table.column("data")
        info = np.concatenate([unpack(blobs[k].as_py(), ABOUT) for k in np.flatnonzero(kinds == INFO)] or [np.zeros(0, ABOUT)])
        post = np.concatenate([unpack(blobs[k].as_py(), SHARED) for k in np.flatnonzero(kinds == POST)] or [np.zeros(0, SHARED)])
        info = info[np.lexsort((info["g"], info["f"], info["doc"]))]
        info = info[np.unique(info["doc"], return_index=True)[1]]
        post = post[np.lexsort((post["token"], post["df"], post["doc"]))]
        first = np.searchsorted(post["doc"], info["doc"])
        shared = np.searchsorted(post["doc"], info["doc"], side="right") - first
        need = must_share(info["n"].astype(np.int64), num, den)
        may = (info["n"] > 0) & (shared >= need)
        level, prefix = np.zeros(len(info), np.int64), np.zeros(len(info), np.int64)
        for k in np.flatnonzero(may).tolist():
            level[k], prefix[k] = choose_level(post["df"][first[k] : first[k] + shared[k]], int(need[k]))
        take = np.where(may, shared, 0)
        tokens = post["token"].view(np.int64)
        flat = np.concatenate([tokens[a : a + k] for a, k in zip(first.tolist(), take.tolist(), strict=True) if k] or [np.zeros(0, np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(flat))
        numbers = [info["doc"], info["n"].astype(np.int64), info["f"].view(np.int64), info["g"].view(np.int64), may, info["x"].astype(np.int64), info["last"].view(np.int64), level, prefix]
        return pa.Table.from_arrays([*map(pa.array, numbers), lists], JUDGED)

    return run


JUDGED = ["doc_id", "n_shingles", "f", "g", "may", "x", "last", "level", "prefix", "shared"]
JUDGED_SCHEMA = "doc_id long, n_shingles long, f long, g long, may boolean, x long, last long, level long, prefix long, shared array<long>"


# candidates of a task


def shared_counts(token: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """How many tokens each two of m owners share."""
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    out = np.zeros((m, m), np.float32)
    if len(token) < 2:
        return out
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(starts, len(token)))
    small = np.repeat(sizes <= FEW, sizes)
    few, own = token[small], owner[small]
    for d in range(1, min(FEW, len(few))):
        same = np.flatnonzero(few[d:] == few[:-d])
        if not len(same):
            break
        out += np.bincount(own[same] * m + own[same + d], minlength=m * m).reshape(m, m).astype(np.float32)
    out += out.T
    group = np.cumsum(np.append(True, token[1:] != token[:-1]))[~small]
    many = owner[~small]
    names, group = np.unique(group, return_inverse=True)
    for a in range(0, len(names), 4096):
        mine = (group >= a) & (group < a + 4096)
        has = np.zeros((m, min(4096, len(names) - a)), np.float32)
        has[many[mine], group[mine] - a] = 1
        out += has @ has.T
    return out


def candidates(n: np.ndarray, x: np.ndarray, last: np.ndarray, level: np.ndarray, prefix: np.ndarray, shared: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, ...]:
    """Pairs of places that may link, and the share of the sample that they have in common."""
    m, sizes = len(n), np.array([len(s) for s in shared], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    token = np.concatenate(shared) if m else np.zeros(0, np.int64)
    in_prefix = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(prefix, sizes)
    matched = shared_counts(token[in_prefix], owner[in_prefix], m)
    a, b = np.nonzero(np.triu(matched >= np.minimum.outer(level, level), 1))
    good = np.minimum(n[a], n[b]) * den >= num * np.maximum(n[a], n[b])
    a, b = a[good], b[good]
    both = shared_counts(token, owner, m)[a, b].astype(np.int64)
    less = np.where(last[a] <= last[b], a, b)  # all of its sample is known of the other, too
    good = (both + n[less] - x[less]) * (den + num) >= num * (n[a] + n[b])
    return a[good], b[good], both[good] / np.maximum(x[less][good], 1)


def forests(a: np.ndarray, b: np.ndarray, share: np.ndarray, label: np.ndarray, most: int) -> np.ndarray:
    """Which pairs make up to ``most`` spanning forests, one after another, over groups of equal label; likely pairs first."""
    taken = np.zeros(len(a), bool)
    left = np.argsort(-share, kind="stable")
    for _ in range(most):
        if not len(left):
            break
        parent = {k: k for k in np.unique(label[np.concatenate([a[left], b[left]])]).tolist()}

        def root(k: int) -> int:
            while parent[k] != k:  # noqa: B023
                parent[k] = parent[parent[k]]  # noqa: B023
                k = parent[k]  # noqa: B023
            return k

        chosen = []
        for place, p, q in zip(range(len(left)), label[a[left]].tolist(), label[b[left]].tolist(), strict=True):
            u, v = root(p), root(q)
            if u != v:
                parent[max(u, v)] = min(u, v)
                chosen.append(place)
        taken[left[chosen]] = True
        left = np.delete(left, chosen)
    return taken


def _propose(num: int, den: int, most: int):
    """Pairs to verify among the documents of a task: not connected, not tested before, and not of one block if there are two.

    more: whether the task has other candidates.
    """

    def run(table: pa.Table, failed: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, component, block, label, n, x, level, prefix = (table.column(c).to_numpy() for c in ("doc_id", "component", "block", "label", "n_shingles", "x", "level", "prefix"))
        upper = table.column("upper").to_numpy()
        last = table.column("last").to_numpy().view(U)
        lists = table.column("shared").combine_chunks()
        shared = [v.values.to_numpy(zero_copy_only=False) for v in lists]
        by = np.lexsort((doc, component))
        two = table.num_rows > 0 and len(np.unique(block)) > 1
        tested = set(zip(failed.column("a").to_pylist(), failed.column("b").to_pylist(), strict=True))
        out, more = [np.zeros((0, 3), np.int64)], False
        edges = np.flatnonzero(np.append(True, np.diff(component[by]) != 0)) if len(by) else np.zeros(0, int)
        cuts, held = [], 0
        for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True):  # whole components, as many as a block holds
            if not cuts or stop - cuts[-1] > BLOCK:
                cuts.append(start)
            held = stop
        for start, stop in zip(cuts, [*cuts[1:], held], strict=True):
            k = by[start:stop]
            a, b, share = candidates(n[k], x[k], last[k], level[k], prefix[k], [shared[i] for i in k], num, den)
            good = (label[k][a] != label[k][b]) & ~(upper[k][a] & upper[k][b])  # two of the upper class have a window of their own
            if two:
                good &= block[k][a] != block[k][b]
            if tested:
                ids = doc[k]
                good &= np.array([(min(p, q), max(p, q)) not in tested for p, q in zip(ids[a].tolist(), ids[b].tolist(), strict=True)], bool)
            a, b, share = a[good], b[good], share[good]
            taken = np.ones(len(a), bool) if len(a) <= EACH * len(k) else forests(a, b, share, label[k], most)
            more |= not taken.all()
            p, q = doc[k][a[taken]], doc[k][b[taken]]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q), n[k][a[taken]] + n[k][b[taken]]], 1))
        found = np.concatenate(out)
        task = (table if table.num_rows else failed).column("task")[0].as_py()
        return pa.table({"task": pa.array([task] * len(found), pa.string()), "a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "size": pa.array(found[:, 2]), "more": pa.array([more] * len(found), pa.bool_())})

    return run


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Exclusive or of the hashes, and the sum of other hashes: what tells sets apart."""
    return (int(np.bitwise_xor.reduce(found)), int(mix(found * U(0xC2B2AE3D27D4EB4F) + U(1)).sum(dtype=U))) if len(found) else (0, 0)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _verify(size: int, num: int, den: int):
    """Proposed pairs decided on the whole sets of their texts."""

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for batch in texts.to_batches():
            for piece in pieces(iter([batch]), batch.schema.get_field_index("text")):
                for doc, found in zip(piece.column("doc_id").to_pylist(), shingle_sets(Tokens(*text_bytes(piece.column("text"))), size), strict=True):
                    if doc not in sets or _fingerprint(found) < _fingerprint(sets[doc]):
                        sets[doc] = found
        linked = []
        for p, q in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = sets[p], sets[q]
            both = _overlap(x, y)
            linked.append(den * both >= num * (len(x) + len(y) - both))
        trim()
        return pa.table({"task": pairs.column("task"), "a": pairs.column("a"), "b": pairs.column("b"), "linked": pa.array(linked, pa.bool_()), "more": pairs.column("more")})

    return run


def _sizes(size: int):
    """Sizes of the sets of rows that have no id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 0):
            n = [len(s) for s in shingle_sets(Tokens(*text_bytes(piece.column(0))), size)]
            yield pa.record_batch([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return run


def near_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each document."""
    spark = docs.sparkSession
    short_batches(spark)
    buckets = parallelism(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nameless = rows.filter("doc_id IS NULL").select("text").mapInArrow(_sizes(size), "doc_id long, n_shingles long, component_id long")
    rows = rows.filter("doc_id IS NOT NULL")
    sent = rows.mapInArrow(_prefixes(size, num, den, buckets), SCHEMA)
    counted = cut(sent.groupBy("kind", "bucket").applyInArrow(_count(buckets), SCHEMA))
    about = cut(counted.groupBy("bucket").applyInArrow(_judge(num, den), JUDGED_SCHEMA))
    del sent, counted
    sweep(spark)
    alike = about.filter("may").groupBy("n_shingles", "f", "g").agg(F.min("doc_id").alias("rep"))
    reps = about.join(alike.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    known = reps.drop("f", "g", "may").withColumn("class", _class(F.col("n_shingles"), num, den))
    token = F.explode(F.slice("shared", F.lit(1), F.col("prefix").cast("int"))).alias("token")
    posted = cut(known.select("doc_id", "class", token)).withColumn("window", F.explode(F.array(F.col("class") - 1, F.col("class"))))
    least = posted.groupBy("window", "token").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.min("class").alias("lowest"))
    least = least.filter((F.col("n") > 1) & (F.col("lowest") == F.col("window"))).select("window", "token", "low")
    pairs = posted.join(least, ["window", "token"]).filter("doc_id <> low").select(F.struct("window", "doc_id").alias("a"), F.struct("window", F.col("low").alias("doc_id")).alias("b"))
    guess = components(pairs).select(F.col("node.window").alias("window"), F.col("node.doc_id").alias("doc_id"), F.xxhash64("component").alias("component"))
    members = guess.join(known, "doc_id").withColumn("upper", F.col("class") > F.col("window")).drop("class", "window")
    placed = cut(_tasks(members, buckets))
    del posted, least, pairs, guess, members
    sweep(spark)
    linked_to = _connect(rows, placed, size, num, den)
    member = about.filter("may").join(alike, ["n_shingles", "f", "g"]).select("doc_id", "rep")
    named = member.join(linked_to.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    got = about.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return got.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(nameless)


def _connect(rows: DataFrame, placed: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """node and component of all documents that verified pairs connect."""
    none = placed.sparkSession.createDataFrame([], "task string, a long, b long, linked boolean, more boolean")
    tested, due, linked_to, open_tasks, most = none, placed, None, None, 1
    while True:
        label = F.col("doc_id") if linked_to is None else F.coalesce("to", "doc_id")
        known = due if linked_to is None else due.join(linked_to.select(F.col("node").alias("doc_id"), F.col("component").alias("to")), "doc_id", "left")
        known = known.withColumn("label", label).drop("to")
        failed = tested.filter("NOT linked").select("task", "a", "b")
        failed = failed if open_tasks is None else failed.join(open_tasks, "task", "left_semi")
        found = known.groupBy("task").cogroup(failed.groupBy("task")).applyInArrow(_propose(num, den, most), "task string, a long, b long, size long, more boolean")
        proposed = cut(found)
        total = proposed.agg(F.sum("size")).first()[0]
        if total is None:
            return components(tested.filter("linked").select("a", "b")) if linked_to is None else linked_to
        parts = max(parallelism(rows.sparkSession), total // VERIFY)
        keyed = proposed.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts)))
        asked = keyed.select(F.col("part").alias("home"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        texts = rows.join(asked, "doc_id").select("home", "doc_id", "text")
        decided = cut(texts.groupBy("home").cogroup(keyed.groupBy("part")).applyInArrow(_verify(size, num, den), "task string, a long, b long, linked boolean, more boolean"))
        tested = decided if linked_to is None else tested.unionByName(decided)
        linked_to = components(tested.filter("linked").select("a", "b"))
        open_tasks = cut(decided.filter("NOT linked AND more").select("task").distinct())
        sweep(rows.sparkSession)
        if open_tasks.isEmpty():
            return linked_to
        due = placed.join(open_tasks, "task", "left_semi")
        most *= 4


def _class(n: Column, num: int, den: int) -> Column:
    """A class of sizes; sizes that can link are in one or in neighbours."""
    return (F.floor(F.log(n.cast("double")) / F.log(F.lit(den / num)) - 1e-9) if num < den else n).cast("long")


def _tasks(members: DataFrame, buckets: int) -> DataFrame:
    """``members`` with task and block: where the samples of a document meet those of others.

    Components of up to ``BLOCK`` members share tasks. Larger ones are cut by hash into
    blocks, which meet in pairs.
    """
    sizes = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    count = sizes.filter(F.col("n") <= BLOCK).agg(F.sum("n")).first()[0] or 0
    known = members.join(sizes.withColumn("parts", F.ceil(F.col("n") / F.lit(BLOCK))).drop("n"), "component")
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(max(buckets, 4 * count // BLOCK))))
    block = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    meet = lambda q: F.concat_ws("/", F.lit("l"), F.col("component"), F.least(block, q), F.greatest(block, q))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), meet)
    tasks = F.when(F.col("parts") == 1, F.array(shared)).otherwise(blocks)
    return known.withColumn("block", F.when(F.col("parts") == 1, 0).otherwise(block)).withColumn("task", F.explode(tasks)).drop("parts")


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; rows without an id stay."""
    gone = near_components(docs.filter(F.col(doc_id).isNotNull()), size, num, den, doc_id, text).filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, F.col(doc_id) == F.col("__gone_id"), "left_anti")
