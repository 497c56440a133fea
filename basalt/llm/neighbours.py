"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search.

Equal vectors are one node, so copies neither crowd lists nor meet in one task. Inner
product becomes distance by one more component, which gives every vector the length of the
longest. A tree of median cuts, fitted on a bounded sample (``SAMPLE`` vectors), places nodes
that lie near each other in one block of about ``BLOCK``; a node's number holds its block.

Graph. Lists start from the nearest in the own block and in the leaf of a second tree. Then,
in each round of NN-descent, every node joins its neighbours, in both directions, with each
other (pairs with a new edge only). Neighbours are joined as numbers; a block then fetches
one copy of the vectors of other blocks that its joins need, together with the worst score
of each one's list, and sends only pairs that improve a list. Each round is four exchanges of
packed arrays and ends in the shared folder. Rounds end when few edges change.

Search. A query starts from the list of its own node and, round by round, visits the
nearest nodes not yet visited; the members of their lists are scored where their vectors
lie, by inner products of the original vectors in double precision, and the nearest stay in
the query's beam, until the beam holds no node that is not visited. Vectors of nodes stay
where they are; only the query's vector travels.

Memory follows the block: its nodes times the members of a list; wider vectors make smaller
blocks. A block sends at most ``2 * k`` edges to one node that many have as neighbour.
Nothing is broadcast but the trees; the sample and counts go to the driver.

Defined cases: vectors that are null, empty, all nought or hold null or non-finite components
take no part; so do those of another length than the longest, and rows without an id; ties go
to the smaller id; a query never finds its own row, but does find copies; fewer candidates
than asked for are all given; a table of one distinct vector gives each query its copies; an
empty table gives an empty result; other columns of the table, whatever their names, don't
matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._spark import cut, sweep
from basalt.llm._tokens import U, mix

#: Nodes of a block of 64 components; vectors from which the trees are fitted.
BLOCK, SAMPLE = 4096, 1 << 15
#: A node's number: its block, then its place there.
SHIFT = 20
SCHEMA, NAMES = "b long, kind int, n long, data binary", ["b", "kind", "n", "data"]
VECTORS, STATE, REVERSE, MEMBERS, WANTED, SENT, FOUND, QUERY, VISIT, SCORE = range(10)
OLD, NEW, PICKED, FOUND_NOW = range(4)


# packed arrays between blocks


def _row(b: int, kind: int, n: int = 0, **arrays: np.ndarray) -> tuple[int, int, int, bytes]:
    return b, kind, n, pickle.dumps(arrays, 5)


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)


def _read(table: pa.Table) -> dict[int, list[dict[str, np.ndarray]]]:
    out: dict[int, list] = {}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
        out.setdefault(kind, []).append(pickle.loads(data.as_py()))
    return out


def _only(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pa.compute.is_in(table.column("kind"), pa.array(kinds, pa.int32()))).select(NAMES)


def _here(table: pa.Table) -> int:
    return int(table.column("b")[0].as_py())


def _starts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    edges = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1], [True]])).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _deal(kind: int, node: np.ndarray, **arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Arrays cut by the block of ``node``, which is sent as its place there."""
    home = node >> SHIFT
    by = np.argsort(home, kind="stable")
    home, at = home[by], (node[by] & ((1 << SHIFT) - 1)).astype(np.int32)
    return [_row(int(home[a]), kind, at=at[a:e], **{k: v[by[a:e]] for k, v in arrays.items()}) for a, e in _starts(home)]


def _joined(parts: list[dict[str, np.ndarray]], *names: str) -> list[np.ndarray]:
    return [np.concatenate([p[n] for p in parts]) for n in names]


def _rank(sorted_values: np.ndarray) -> np.ndarray:
    place = np.arange(len(sorted_values))
    new = np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(place)]
    return place - np.maximum.accumulate(np.where(new, place, 0))


def _grouped(at: np.ndarray) -> np.ndarray:
    """Stable order of small numbers: those of 16 bits are dealt, not compared."""
    return np.argsort(at.astype(np.uint16) if len(at) and at.max() < 1 << 16 else at, kind="stable")


def _ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order by two whole numbers, neither under 0; as one, where both fit into 63 bits, for that sorts much faster."""
    if not len(high):
        return np.zeros(0, np.int64)
    bits = int(low.max()).bit_length()
    if int(high.max()).bit_length() + bits > 63:
        return np.lexsort((low, high))
    return np.argsort((high.astype(np.int64) << bits) | low)


def _distinct(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places of the distinct pairs, in their order."""
    by = _ordered(high, low)
    return by[np.append(True, (np.diff(high[by]) != 0) | (np.diff(low[by]) != 0))[: len(by)]]


def _falling(score: np.ndarray) -> np.ndarray:
    """Stable order of scores, largest first."""
    if score.dtype != np.float32:
        return np.argsort(-score, kind="stable")
    bits = (score + np.float32(0)).view(np.int32).astype(np.int64)  # -0 is 0
    key = np.where(bits < 0, bits & 0x7FFFFFFF, -1 - bits) << 31
    return np.sort(key + np.arange(len(score))) & ((1 << 31) - 1)


def _nearest_first(at: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Stable order by owner, then the largest score."""
    by = _falling(score)
    return by[_grouped(at[by])]


def _best(at: np.ndarray, other: np.ndarray, score: np.ndarray, flag: np.ndarray, n: int, k: int, *more: np.ndarray) -> list[np.ndarray]:
    """The k nearest others of each of n nodes: ids (-1: none), scores and flags (the least of an edge given twice), and so on."""
    by = _ordered(other, flag)
    by = by[_grouped(at[by])]
    by = by[np.append(True, (np.diff(at[by]) != 0) | (np.diff(other[by]) != 0))[: len(by)]]
    by = by[_nearest_first(at[by], score[by])]
    rank = _rank(at[by])
    by, rank = by[rank < k], rank[rank < k]
    out = []
    for values, none in ((other, -1), (score, -np.inf), (flag, OLD), *((m, -1) for m in more)):
        table = np.full((n, k), none, values.dtype)
        table[at[by], rank] = values[by]
        out.append(table)
    return out


# trees


class Tree:
    """Median cuts of a sample, level by level; below its leaves, signs of random directions about each leaf's mean."""

    def __init__(self, x: np.ndarray, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.fitted = min(depth, max(0, int(np.log2(max(len(x), 1) / 32))))
        self.normals = np.zeros(((1 << self.fitted) - 1, x.shape[1]), np.float32)
        self.cuts = np.zeros(len(self.normals), np.float32)
        at = np.zeros(len(x), np.int64)
        for level in range(self.fitted):
            for node in range((1 << level) - 1, (2 << level) - 1):
                mine = np.flatnonzero(at == node)
                if len(mine) > 1:
                    a, b = x[rng.choice(mine, 2, replace=False)]
                    self.normals[node] = a - b
                    self.cuts[node] = np.median(x[mine] @ self.normals[node])
            at = self._down(x, at)
        leaves = at - len(self.normals)
        self.means = np.zeros((1 << self.fitted, x.shape[1]), np.float32)
        np.add.at(self.means, leaves, x)
        self.means /= np.maximum(np.bincount(leaves, minlength=len(self.means)), 1)[:, None]
        self.signs = rng.normal(size=(x.shape[1], depth - self.fitted)).astype(np.float32)

    def _down(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 2 * at + 1 + (np.einsum("ij,ij->i", x, self.normals[at]) > self.cuts[at])

    def codes(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.fitted):
            at = self._down(x, at)
        leaf = at - len(self.normals)
        bits = ((x - self.means[leaf]) @ self.signs > 0) @ (1 << np.arange(self.signs.shape[1]))
        return (leaf << self.signs.shape[1]) + bits


def _lift(raw: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled, with the component that makes all as long as the longest."""
    x = raw.astype(np.float64) / np.sqrt(longest)
    added = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.concatenate([x, added[:, None]], 1).astype(np.float32)


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k nearest others of each row; as many as there are."""
    n = min(k, len(x) - 1)
    ids, scores = np.zeros((len(x), n), np.int64), np.zeros((len(x), n), np.float32)
    for a in range(0, len(x) if n else 0, 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        ids[a : a + 512], scores[a : a + 512] = top, np.take_along_axis(near, top, 1)
    return ids, scores


def _leaf(k: int) -> Callable:
    """The nearest in a leaf of the second tree, sent to the nodes' blocks."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        node, x = node[order], np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(len(node), -1)[order]
        top, score = _nearest(x, k)
        return _table(_deal(FOUND, np.repeat(node, top.shape[1]), other=node[top].ravel(), score=score.ravel()))

    return run


# rounds of NN-descent


def _known(own: dict[str, np.ndarray] | None) -> list[np.ndarray]:
    """Owners' places, others, scores and flags of a state; edges of the last round are old now."""
    if own is None:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.float32, np.int8)]
    has = own["ids"] >= 0
    flag = own["flag"][has]
    return [np.repeat(np.arange(len(has)), has.sum(1)), own["ids"][has], own["scores"][has], np.where(flag == PICKED, OLD, flag).astype(np.int8)]


def _update(k: int, picks: int, longest: float) -> Callable:
    """Lists take in what was found and pick new edges for the next join; each edge then goes to the block of its other end."""

    def run(table: pa.Table) -> pa.Table:
        got, b = _read(table), _here(table)
        own = got[VECTORS][0]["raw"]
        lists = [_known(s) for s in got.get(STATE, [None])]
        if STATE not in got:  # the first lists are those of the block
            top, score = _nearest(_lift(own, longest), k)
            lists.append([np.repeat(np.arange(len(own)), top.shape[1]), (b << SHIFT) + top.ravel(), score.ravel(), np.full(top.size, FOUND_NOW, np.int8)])
        lists += [[f["at"].astype(np.int64), f["other"], f["score"], np.full(len(f["at"]), FOUND_NOW, np.int8)] for f in got.get(FOUND, [])]
        ids, scores, flag = _best(*(np.concatenate(v) for v in zip(*lists, strict=True)), len(own), k)
        fresh = int((flag == FOUND_NOW).sum())
        flag[flag == FOUND_NOW] = NEW
        new = flag == NEW
        # of the new edges, the nearest are picked; the others wait
        picked = new & (np.cumsum(new, 1) <= picks)
        flag[picked] = PICKED
        has = (ids >= 0) & (flag != NEW)
        here, there, on = np.repeat(np.arange(len(own)), has.sum(1)), ids[has], flag[has]
        by = _falling(scores[has])  # here ascends already
        by = by[_grouped((on == OLD)[by])]
        by = by[np.argsort(there[by], kind="stable")]
        by = by[_rank(there[by]) < 2 * k]  # for a node that very many have as neighbour
        back = _deal(REVERSE, there[by], member=here[by] + (b << SHIFT), flag=on[by])
        return _table([_row(b, STATE, fresh, ids=ids, scores=scores, flag=flag), *back])

    return run


def _both_ways(got: dict[int, list[dict[str, np.ndarray]]], new: int, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of each list, edges in both directions (-1: none), and which are picked: at most ``new`` and ``old`` of them."""
    state = got[STATE][0]
    has = (state["ids"] >= 0) & (state["flag"] != NEW)
    at, member, flag = np.repeat(np.arange(len(has)), has.sum(1)), state["ids"][has], state["flag"][has]
    if REVERSE in got:
        a, m, f = _joined(got[REVERSE], "at", "member", "flag")
        at, member, flag = np.concatenate([at, a]), np.concatenate([member, m]), np.concatenate([flag, f])
    by = _ordered(member, flag == OLD)
    by = by[_grouped(at[by])]
    by = by[np.append(True, (np.diff(at[by]) != 0) | (np.diff(member[by]) != 0))[: len(by)]]
    at, member, fresh = at[by], member[by], flag[by] == PICKED
    out = []
    for wanted, most in ((fresh, new), (~fresh, old)):
        a, m = at[wanted], member[wanted]
        by = np.argsort(mix(m.view(U) * U(31) + a.astype(U)))
        by = by[_grouped(a[by])]
        a, m = a[by], m[by]
        rank = _rank(a)
        table = np.full((len(has), most), -1, np.int64)
        table[a[rank < most], rank[rank < most]] = m[rank < most]
        out.append(table)
    return out[0], out[1]


def _members(k: int, picks: int) -> Callable:
    """Lists to join, and the numbers of the vectors that they need from other blocks."""

    def run(table: pa.Table) -> pa.Table:
        got, b = _read(table), _here(table)
        new, old = _both_ways(got, 2 * picks, k)
        good = (new >= 0).any(1)
        new, old = new[good], old[good]
        wanted = np.unique(np.concatenate([new.ravel(), old.ravel()]))
        wanted = wanted[(wanted >= 0) & (wanted >> SHIFT != b)]
        ask = _deal(WANTED, wanted, by=np.full(len(wanted), b))
        return pa.concat_tables([_only(table, STATE), _table([_row(b, MEMBERS, new=new, old=old), *ask])])

    return run


def _send(longest: float) -> Callable:
    """Vectors and the worst scores of their lists go to the blocks that asked."""

    def run(table: pa.Table) -> pa.Table:
        got, b = _read(table), _here(table)
        rows = []
        if WANTED in got:
            own, worst = got[VECTORS][0]["raw"], got[STATE][0]["scores"][:, -1]
            for w in got[WANTED]:
                rows.append(_row(int(w["by"][0]), SENT, ids=w["at"] + np.int64(b << SHIFT), x=_lift(own[w["at"]], longest), worst=worst[w["at"]]))
        return pa.concat_tables([_only(table, STATE, MEMBERS), _table(rows)])

    return run


def _first(k: int, held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of pairs of owner, other and score: the k best of each owner; no more can enter its list."""
    owner, other, score = (np.concatenate(v) for v in zip(*held, strict=True))
    by = _distinct(owner, other)
    by = by[_falling(score[by])]
    by = by[np.argsort(owner[by], kind="stable")]
    by = by[_rank(owner[by]) < k]
    return owner[by], other[by], score[by]


def _compare(k: int, longest: float) -> Callable:
    """Members of a list compared with each other, pairs with a new edge; what improves a list goes to its block."""

    def run(table: pa.Table) -> pa.Table:
        got, b = _read(table), _here(table)
        lists, own = got[MEMBERS][0], got[VECTORS][0]["raw"]
        local = np.arange(len(own)) + np.int64(b << SHIFT)
        ids, x, worst = (np.concatenate(v) for v in zip((local, _lift(own, longest), got[STATE][0]["scores"][:, -1]), *([s["ids"], s["x"], s["worst"]] for s in got.get(SENT, [])), strict=True))
        by = np.argsort(ids)
        # the last stands for no member: its products are no numbers, which exceed nothing
        ids, x, worst = ids[by], np.append(x[by], np.full((1, x.shape[1]), np.nan, x.dtype), 0), np.append(worst[by], np.float32(np.inf))
        n_new = lists["new"].shape[1]
        # members by their places, which are small numbers in the order of ids
        every = np.concatenate([lists["new"], lists["old"]], 1)
        every = np.where(every >= 0, np.searchsorted(ids, np.maximum(every, ids[0])), len(ids))
        held, count = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
        for a in range(0, len(every), 128):
            m = every[a : a + 128]
            y, least = x[m], worst[m]
            near = y[:, :n_new] @ y.transpose(0, 2, 1)  # new members by all members
            near[:, np.arange(n_new), np.arange(n_new)] = -np.inf
            at = np.flatnonzero(near > least[:, :n_new, None])
            line, j = np.divmod(at, m.shape[1])
            n, i = np.divmod(line, n_new)
            held.append((m[n, i], m[n, j], near.ravel()[at]))
            # two new members have met both ways
            line, j = np.divmod(np.flatnonzero(near[:, :, n_new:] > least[:, None, n_new:]), m.shape[1] - n_new)
            n, i = np.divmod(line, n_new)
            held.append((m[n, n_new + j], m[n, i], near[n, i, n_new + j]))
            count += len(held[-1][0]) + len(held[-2][0])
            if count > 1 << 20:
                held, count = [_first(k, held)], 0
        owner, other, score = _first(k, held)
        owner, other = ids[owner], ids[other]
        return pa.concat_tables([_only(table, STATE), _table(_deal(FOUND, owner, other=other, score=score))])

    return run


def usable(vector: Column) -> Column:
    number = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(number, lambda x: x != 0), F.lit(False))


def _numbers(lists: pa.Array, rows: int, single: bool) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64).reshape(rows, -1)


class Graph:
    """The nearest-neighbour graph of a table of vectors."""

    def __init__(self, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, picks: int = 20, rounds: int = 12) -> None:
        kind = vectors.schema[vector].dataType.elementType.simpleString()
        single = kind == "float"
        rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("raw")).filter(usable(F.col("raw")) & F.col("id").isNotNull())
        wide = rows.agg(F.max(F.size("raw"))).first()[0] or 1
        number = "float" if single else "double"
        rows = rows.filter(F.size("raw") == wide).withColumn("raw", F.transform("raw", lambda x: x.cast(number) + F.lit(0).cast(number)))
        self.k, self.picks = k, picks
        distinct = cut(rows.groupBy("raw").agg(F.min("id").alias("first")))
        length = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.count, longest = distinct.agg(F.count(F.lit(1)), F.max(length)).first()
        self.longest = float(longest or 1.0)
        #: Every row and the smallest id of its vector.
        self.rows = rows.join(distinct, "raw").select("id", "first")
        self._place(distinct, single, max(512, min(BLOCK, BLOCK * 64 // wide)))
        self._build(rounds)

    def _place(self, distinct: DataFrame, single: bool, block: int) -> None:
        """Nodes are cut into blocks, and into the leaves of the second tree."""
        longest, depth = self.longest, max(0, int(np.ceil(np.log2(max(self.count, 1) / block))))
        trees = []
        if depth:
            share = min(1.0, SAMPLE / self.count)
            some = distinct.filter(F.pmod(F.xxhash64("first"), F.lit(1 << 30)) < int(share * (1 << 30))).select("raw").toArrow()
            x = _lift(_numbers(some.column("raw").combine_chunks(), some.num_rows, single), longest)
            trees = [Tree(x[np.lexsort(x.T[:2])], depth, seed) for seed in (7, 11)]

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    piece = batch.slice(at, 4096)
                    x = _lift(_numbers(piece.column(1), piece.num_rows, single), longest)
                    found = [pa.array(t.codes(x)) for t in trees] or [pa.array(np.zeros(piece.num_rows, np.int64))] * 2
                    yield pa.record_batch([piece.column(0), piece.column(1), *found], ["first", "raw", "c0", "c1"])

        kind = "float" if single else "double"
        made = cut(distinct.select("first", "raw").mapInArrow(codes, f"first long, raw array<{kind}>, c0 long, c1 long"))
        for c in ("c0", "c1"):  # a leaf that is too large is cut by hash
            parts = made.groupBy(c).agg(F.ceil(F.count(F.lit(1)) / F.lit(1.5 * block)).alias("parts"))
            part = F.pmod(F.xxhash64("first", F.lit(c)), F.col("parts"))
            made = made.join(parts, c).withColumn(c, F.shiftleft(F.col(c), 16) + part).drop("parts")

        def pack(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            by = np.argsort(table.column("first").to_numpy())
            raw = _numbers(table.column("raw").chunk(0), table.num_rows, single)
            return _table([_row(int(table.column("c0")[0].as_py()), VECTORS, table.num_rows, raw=raw[by], first=table.column("first").to_numpy()[by], leaf=table.column("c1").to_numpy()[by])])

        self.vectors = cut(made.groupBy("c0").applyInArrow(pack, SCHEMA))
        self.depth = depth

    def _build(self, rounds: int) -> None:
        k, picks, longest, vectors = self.k, self.picks, self.longest, self.vectors

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                    own = pickle.loads(data.as_py())
                    x = _lift(own["raw"], longest)
                    node = np.arange(len(x)) + np.int64(b << SHIFT)
                    yield pa.record_batch([pa.array(own["leaf"]), pa.array(node), pa.array([r.tobytes() for r in x], pa.binary())], ["leaf", "node", "vec"])

        start = vectors
        if self.depth:
            start = vectors.unionByName(vectors.mapInArrow(leaves, "leaf long, node long, vec binary").groupBy("leaf").applyInArrow(_leaf(k), SCHEMA))
        now = cut(start.groupBy("b").applyInArrow(_update(k, picks, longest), SCHEMA))
        for _ in range(rounds if self.depth else 1):
            met = now.groupBy("b").applyInArrow(_members(k, picks), SCHEMA)
            sent = met.unionByName(vectors).groupBy("b").applyInArrow(_send(longest), SCHEMA)
            compared = sent.unionByName(vectors).groupBy("b").applyInArrow(_compare(k, longest), SCHEMA)
            now = cut(compared.unionByName(vectors).groupBy("b").applyInArrow(_update(k, picks, longest), SCHEMA))
            del met, sent, compared
            sweep(now.sparkSession)
            fresh = now.filter(F.col("kind") == STATE).agg(F.sum("n")).first()[0] or 0
            if fresh < 0.01 * k * self.count:
                break
        #: Lists to walk: edges in both directions.
        self.lists = cut(now.groupBy("b").applyInArrow(_walkable(k), SCHEMA))

    def search(self, queries: DataFrame, top: int = 20, beam: int = 160, visits: int = 64, rounds: int | None = None) -> DataFrame:
        """query_id, rank, vec_id and score of the ids in ``queries`` (column query_id) that name rows of the table.

        Without ``rounds`` search goes on until the beams hold no node that is not visited.
        """
        beam = max(beam, 2 * (top + 1))
        vectors, lists = self.vectors, self.lists
        asked = cut(queries.select(F.col("query_id").cast("long").alias("id")).distinct().join(self.rows, "id").withColumnRenamed("id", "query_id"))
        nodes = vectors.mapInArrow(_firsts, "first long, b long, place int")
        starts = asked.select("first").distinct().join(nodes, "first").groupBy("b").agg(F.collect_list("place").alias("places"))
        opened = starts.select("b", "places").mapInArrow(_open, SCHEMA)
        found = cut(opened.unionByName(lists).groupBy("b").applyInArrow(_begin(beam, self.count <= beam), SCHEMA))
        met = found.unionByName(vectors).groupBy("b").applyInArrow(_attach, SCHEMA)
        done = 0
        while True:
            scored = met.unionByName(vectors).groupBy("b").applyInArrow(_score, SCHEMA)
            last = done == rounds
            beams = cut(scored.unionByName(vectors).groupBy("b").applyInArrow(_keep(beam, 0 if last else visits), SCHEMA))
            del scored, met
            sweep(beams.sparkSession)
            if last or beams.filter(F.col("kind") == VISIT).isEmpty():
                break
            done += 1
            met = beams.unionByName(lists).groupBy("b").applyInArrow(_visit, SCHEMA)
        near = beams.filter(F.col("kind") == QUERY).mapInArrow(_answers(top + 1), "q long, first long, score double")
        nth = F.row_number().over(Window.partitionBy("first").orderBy("id"))
        copies = self.rows.withColumn("nth", nth).filter(F.col("nth") <= top + 1).select("first", F.col("id").alias("vec_id"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id"))
        listed = near.join(copies, "first").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top + 1)
        answers = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
        each = asked.join(answers, F.col("first") == F.col("q")).withColumn("found", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, top))
        return each.select("query_id", F.posexplode("found").alias("rank", "f")).select("query_id", (F.col("rank") + 1).alias("rank"), "f.vec_id", "f.score")


# search


def _walkable(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        got = _read(table)
        state = got[STATE][0]
        state["flag"] = np.zeros_like(state["flag"])
        for r in got.get(REVERSE, []):
            r["flag"] = np.zeros_like(r["flag"])
        return _table([_row(_here(table), MEMBERS, ids=_both_ways(got, 1, 2 * k)[1])])

    return run


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            first = pickle.loads(data.as_py())["first"]
            yield pa.record_batch([pa.array(first), pa.array(np.full(len(first), b)), pa.array(np.arange(len(first), dtype=np.int32))], ["first", "b", "place"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(b, QUERY, query=np.sort(np.array(places, np.int64))) for b, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield from _table(rows).to_batches()


def _begin(beam: int, all_of_them: bool) -> Callable:
    """A query begins with the list of its own node, or with all nodes if they are few, and with itself."""

    def run(table: pa.Table) -> pa.Table:
        got, b = _read(table), _here(table)
        if QUERY not in got:
            return _table([])
        query, lists = got[QUERY][0]["query"], got[MEMBERS][0]["ids"]
        start = np.broadcast_to(np.arange(len(lists)) + np.int64(b << SHIFT), (len(query), len(lists))) if all_of_them else np.concatenate([lists[query], query[:, None] + np.int64(b << SHIFT)], 1)
        shape = (len(query), beam)
        none = {"ids": np.full(shape, -1, np.int64), "scores": np.full(shape, -np.inf), "firsts": np.full(shape, -1, np.int64), "done": np.zeros(shape, bool)}
        row, _ = np.nonzero(start >= 0)
        return _table([_row(b, QUERY, query=query, start=start[start >= 0], row=row, **none)])

    return run


def _ask(kind: int, row: np.ndarray, node: np.ndarray, query: np.ndarray, x: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """For each block of ``node``: the queries that ask there, with their vectors, and which node each asks for."""
    home = node >> SHIFT
    by = np.argsort(home, kind="stable")
    row, node, home = row[by], node[by], home[by]
    out = []
    for a, e in _starts(home):
        who, at = np.unique(row[a:e], return_inverse=True)
        out.append(_row(int(home[a]), kind, query=query[who], x=x[who], least=least[who], row=at.astype(np.int32), place=(node[a:e] & ((1 << SHIFT) - 1)).astype(np.int32)))
    return out


def _attach(table: pa.Table) -> pa.Table:
    """The first candidates of the queries, with the queries' vectors, go where they are scored."""
    got, b = _read(table), _here(table)
    if QUERY not in got:
        return _table([])
    mine = got[QUERY][0]
    start, row = mine.pop("start"), mine.pop("row")
    x, mine["name"] = got[VECTORS][0]["raw"][mine["query"]], got[VECTORS][0]["first"][mine["query"]]
    asks = _ask(SCORE, row, start, mine["query"] + np.int64(b << SHIFT), x, mine["scores"][:, -1])
    return _table([_row(b, QUERY, **mine), *asks])


def _score(table: pa.Table) -> pa.Table:
    """Inner products in double precision, component by component; those that reach the beam go to the queries."""
    got = _read(table)
    rows = []
    if SCORE in got:
        own, first, b = got[VECTORS][0]["raw"], got[VECTORS][0]["first"], _here(table)
        columns = np.ascontiguousarray(own.T, np.float64)
        for ask in got[SCORE]:
            asking = np.ascontiguousarray(ask["x"].T, np.float64)
            score = np.empty(len(ask["row"]))
            for a in range(0, len(score), 8192):
                part = slice(a, a + 8192)
                score[part] = (asking[:, ask["row"][part]] * columns[:, ask["place"][part]]).sum(0)
            good = score >= ask["least"][ask["row"]]
            place = ask["place"][good]
            rows += _deal(FOUND, ask["query"][ask["row"][good]], other=place + np.int64(b << SHIFT), first=first[place], score=score[good])
    return pa.concat_tables([_only(table, QUERY), _table(rows)])


def _keep(beam: int, visits: int) -> Callable:
    """What was found joins the beams; the nearest stay and the next visits are chosen."""

    def run(table: pa.Table) -> pa.Table:
        got, b = _read(table), _here(table)
        if QUERY not in got:
            return _table([])
        old = got[QUERY][0]
        query, has = old["query"], old["ids"] >= 0
        parts = [[np.repeat(np.arange(len(query)), has.sum(1)), old["ids"][has], old["scores"][has], (~old["done"][has]).astype(np.int8), old["firsts"][has]]]
        parts += [[np.searchsorted(query, f["at"]), f["other"], f["score"], np.ones(len(f["at"]), np.int8), f["first"]] for f in got.get(FOUND, [])]
        at, other, score, open_, first = (np.concatenate(v) for v in zip(*parts, strict=True))
        ids, scores, open_, firsts = _best(at, other, score, open_, len(query), beam, first)
        todo = (open_ > 0) & (ids >= 0)
        todo &= np.cumsum(todo, 1) <= visits
        done = (open_ == 0) | todo
        row, _ = np.nonzero(todo)
        asks = _ask(VISIT, row, ids[todo], query + np.int64(b << SHIFT), got[VECTORS][0]["raw"][query], scores[:, -1])
        return _table([_row(b, QUERY, query=query, name=old["name"], ids=ids, scores=scores, firsts=firsts, done=done), *asks])

    return run


def _visit(table: pa.Table) -> pa.Table:
    """The members of the lists of the visited nodes are asked for."""
    got = _read(table)
    rows = []
    if VISIT in got:
        lists = got[MEMBERS][0]["ids"]
        for ask in got[VISIT]:
            met = lists[ask["place"]]
            row, member = np.repeat(ask["row"], met.shape[1])[met.ravel() >= 0], met[met >= 0]
            by = _distinct(row, member)
            rows += _ask(SCORE, row[by], member[by], ask["query"], ask["x"], ask["least"])
    return pa.concat_tables([_only(table, QUERY), _table(rows)])


def _answers(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3):
                found = pickle.loads(data.as_py())
                by = np.lexsort((found["firsts"], -found["scores"]))[:, :most]
                firsts, scores = (np.take_along_axis(found[x], by, 1) for x in ("firsts", "scores"))
                has = firsts >= 0
                yield pa.record_batch([pa.array(np.repeat(found["name"], has.sum(1))), pa.array(firsts[has]), pa.array(scores[has])], ["q", "first", "score"])

    return run
