"""Removal of repeated passages, exactly, with suffix arrays.

1. Shards. Each map task cuts its texts into shards of about a megabyte, sorts all suffixes
   of a shard (Larsson-Sadakane refinement in numpy), finds the common prefixes of
   neighbours (Kasai's order of work: a prefix is compared only where it isn't one less
   than the one before it) and so the classes of equal ``length``-byte strings. All but the
   earliest string of a class are repeats.
2. Anchors. Strings that are first in their shard may repeat one in another shard. The
   smallest hash of the 32-byte strings in a window chooses the window's anchor by content
   alone, so equal windows share it. For a run of windows with one anchor, the hashes of
   the anchor and of the whole run are sent to the bucket of the anchor: one anchor for
   some 34 bytes, combined within the task first.
3. Merging. A bucket holds sorted keys of all shards; each shard's keys are found in the
   merged order by binary search. Of equal runs all but the earliest are repeats. Runs that
   share an anchor but differ as a whole ask for their text.
4. Those runs' texts meet in the bucket of the anchor and form a shard there, whose suffix
   array decides window by window.
5. The removed byte ranges meet their texts, hashed to groups of bounded size.

Strings are compared byte by byte within shards; across shards equality of whole runs is
that of two independent 64-bit hashes. Memory follows the shard, bucket and group sizes; a
text over ``PART`` bytes is cut, its parts overlapping by one byte less than ``length``.
Nothing goes to the driver but one sum.

Defined cases: null counts as empty; texts under ``length`` bytes lose nothing; rows that
repeat an id and its text stand for one document and get its result; different texts of one
id, or without an id, are documents of their own, in the order of a hash of the text; a null
id comes before all others; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import cut, parallelism, pieces, short_batches, text_bytes, trim
from basalt.llm._tokens import U, mix, powers

SHARD, PART, GROUP, BUCKET, GRAM = 1 << 20, 4 << 20, 6 << 20, 8 << 20, 32
FLUSH = 600_000
RUN = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
NO_ID = -(1 << 63)


# suffix arrays


def words(b: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, big end first; noughts follow the end."""
    k = np.zeros(len(b) + 8, U)
    k[: len(b)] = b
    for s in (1, 2, 4):
        k = (k[:-s] << U(8 * s)) | k[s:]
    return k[: len(b)]


def suffix_array(b: np.ndarray) -> np.ndarray:
    """Suffixes in order. Groups that agree on h bytes are refined by the group h bytes further on, and h doubles."""
    n = len(b)
    key = words(b)
    sa = np.argsort(key)
    sorted_keys = key[sa]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(starts, sizes)
    rank[n] = -1
    # a suffix of under eight bytes comes before those that it agrees with through added noughts
    tail = np.arange(max(0, n - 7), n)
    open_at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    if len(tail) and len(open_at):
        short = np.isin(sa[open_at], tail)
        if short.any():
            h = 1
    while len(open_at):
        s = sa[open_at]
        key = rank[s] * (n + 2) + rank[np.minimum(s + h, n)] + 1
        order = np.argsort(key)
        key, s = key[order], s[order]
        sa[open_at] = s
        new = np.empty(len(s), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(s)))
        rank[s] = np.repeat(open_at[starts], sizes)
        open_at = open_at[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(b: np.ndarray, sa: np.ndarray, least: int = 0) -> np.ndarray:
    """Length of the common prefix of each suffix in order and the one before it (0 for the first).

    Lengths under ``least`` may be given short.
    """
    n = len(b)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    fresh = np.ones(n, bool)  # where the prefix isn't the last place's less one
    prior = before[1:] - 1
    fresh[1:] = (prior < 0) | (b[:-1] != b[np.maximum(prior, 0)])
    fresh[sa[0]] = True
    after = np.zeros(n, bool)
    after[1:] = before[:-1] < 0
    fresh |= after
    got = np.zeros(n, np.int64)
    i = np.flatnonzero(fresh & (before >= 0))
    j, key = before[i], words(b)
    limit = n - np.maximum(i, j)
    for step in range(0, 128, 8):
        inside = limit >= step + 8
        same = np.zeros(len(i), bool)
        same[inside] = key[i[inside] + step] == key[j[inside] + step]
        ended = ~same
        for k in range(8):  # fewer than eight bytes agree
            if step + 8 < least or not ended.any():
                break
            e = np.flatnonzero(ended)
            e = e[limit[e] > step + k]
            e = e[b[i[e] + step + k] == b[j[e] + step + k]]
            ended = np.zeros(len(i), bool)
            ended[e] = True
            got[i[e]] += 1
        i, j, limit = i[same], j[same], limit[same]
        got[i] += 8
        if not len(i):
            break
    for p, q, most in zip(i.tolist(), j.tolist(), limit.tolist(), strict=True):
        at, size = 128, 4096
        while at < most:
            end = min(at + size, most)
            differ = b[p + at : p + end] != b[q + at : q + end]
            if differ.any():
                at += int(differ.argmax())
                break
            at, size = end, size * 2
        got[p] = at
    place = np.arange(n)
    origin = np.maximum.accumulate(np.where(fresh, place, 0))
    whole = np.maximum(got[origin] - (place - origin), 0)
    whole[sa[0]] = 0
    return whole[sa]


def repeats(b: np.ndarray, valid: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which windows (places with ``valid``) equal one that comes before them in ``order``."""
    out = np.zeros(len(b), bool)
    if len(b) < 2:
        return out
    sa = suffix_array(b)
    joined = common_prefixes(b, sa, length) >= length
    member = joined.copy()
    member[:-1] |= joined[1:]
    at = np.flatnonzero(member)
    place, group = sa[at], np.cumsum(~joined[at])
    good = valid[place]
    place, group = place[good], group[good]
    if not len(place):
        return out
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(order[place], starts), np.diff(np.append(starts, len(place))))
    out[place] = order[place] > first
    return out


# texts as joined parts


class Joined:
    """Parts of documents, in order of document and place, with a byte between two of them."""

    def __init__(self, doc: np.ndarray, base: np.ndarray, parts: list[np.ndarray], length: int) -> None:
        by = np.lexsort((base, doc))
        doc, base, parts = doc[by], base[by], [parts[k] for k in by]
        gap = np.zeros(1, np.uint8)
        self.b = np.concatenate([x for p in parts for x in (p, gap)]) if parts else np.zeros(0, np.uint8)
        size = np.array([len(p) for p in parts], np.int64)
        start = np.cumsum(size + 1) - size - 1
        part = np.repeat(np.arange(len(parts)), size + 1)
        inside = np.arange(len(self.b)) - start[part] if len(parts) else np.zeros(0, np.int64)
        self.valid = inside + length <= size[part] if len(parts) else np.zeros(0, bool)
        self.part, self.doc, self.place = part, doc, inside + base[part] if len(parts) else inside
        _, rank = np.unique(doc, return_inverse=True)
        self.order = (rank[part].astype(np.int64) << 32) | self.place if len(parts) else inside

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each unbroken run of chosen windows."""
        at = np.flatnonzero(chosen)
        new = np.append(True, np.diff(at) != 1)[: len(at)]
        return at[new], at[np.append(new[1:], True)[: len(at)]]

    def spans(self, chosen: np.ndarray, length: int) -> np.ndarray:
        lo, hi = self.runs(chosen)
        out = np.empty(len(lo), SPAN)
        out["doc"], out["lo"], out["hi"] = self.doc[self.part[lo]], self.place[lo], self.place[hi] + length
        return out


def anchors(joined: Joined, wanted: np.ndarray, length: int) -> np.ndarray:
    """Runs of windows with one anchor that hold a wanted window."""
    b, n, wide = joined.b, len(joined.b), length - GRAM + 1
    if n < length:
        return np.zeros(0, RUN)
    key = words(b)
    m = n - GRAM + 1
    h = key[:m].copy()
    for k in (8, 16, 24):
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + key[k : k + m]
    h = mix(h)
    low, at, done = h, np.arange(m), 1
    while done < wide:  # the smallest hash in each window, the last of equals
        step = min(done, wide - done)
        right = low[step:] <= low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        done += step
    count = len(at)
    valid = joined.valid[:count]
    new = np.ones(count, bool)
    new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    end_of = np.ones(count, bool)
    end_of[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(end_of & valid)
    seen = np.concatenate([[0], np.cumsum(wanted[:count])])
    keep = seen[last + 1] > seen[first]
    first, last = first[keep], last[keep]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((mix(b.astype(U) + U(1))) * up[:n], out=sums[1:])
    end = last + length
    whole = mix((sums[end] - sums[first]) * down[first])
    out = np.empty(len(first), RUN)
    out["h"], out["lo"], out["n"], out["doc"] = h[at[first]], joined.place[first], last - first + 1, joined.doc[joined.part[first]]
    out["c"] = mix(whole ^ ((at[first] - first).astype(U) << U(32)) ^ (last - first).astype(U))
    return out


def merge(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of runs from many shards: those equal to an earlier run, and those that share an anchor with a different run."""
    runs = np.concatenate(shards)
    table = np.unique(runs["h"])
    place = np.concatenate([np.searchsorted(table, s["h"]) for s in shards])
    by = np.lexsort((runs["lo"], runs["doc"], runs["c"], place))
    runs, place = runs[by], place[by]
    same = np.zeros(len(runs), bool)
    same[1:] = (place[1:] == place[:-1]) & (runs["c"][1:] == runs["c"][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(runs))))
    own = (runs["doc"] == runs["doc"][head]) & (runs["lo"] == runs["lo"][head])
    distinct = np.bincount(place[~same], minlength=len(table))
    return runs[same & ~own], runs[~same & (distinct[place] > 1)]


def _blobs(array: np.ndarray, bucket: np.ndarray, kind: int, schema: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of kind, bucket and the packed entries of the bucket, columns one after another and places as differences."""
    if not len(array):
        return
    by = np.lexsort((array["lo"], array["doc"], bucket))
    array, bucket = array[by], bucket[by]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    ends = np.append(starts[1:], len(bucket))
    rows = [pack(array[s:e]) for s, e in zip(starts, ends, strict=True)]
    yield pa.record_batch([pa.array(np.full(len(rows), kind, np.int32)), pa.array(bucket[starts].astype(np.int64)), pa.array(rows, pa.binary())], schema)


def pack(array: np.ndarray) -> bytes:
    steps = array.copy()
    steps["lo"][1:] -= array["lo"][:-1]
    return b"".join(steps[f].tobytes() for f in array.dtype.names)


def unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    n = len(raw) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for f in kind.names:
        size = kind[f].itemsize * n
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += size
    out["lo"] = np.cumsum(out["lo"], dtype=np.uint32)
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _home(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U)) % U(groups)).astype(np.int64)


NAMES = ["kind", "bucket", "data"]
SCHEMA = "kind int, bucket long, data binary"
SPANS, ASKED = 0, 1


def _local(length: int, buckets: int, groups: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Joined]:
        for piece in pieces(batches, 1, SHARD):
            ids = _ids(piece.column(0))
            data, offsets = text_bytes(piece.column(1))
            _, once = np.unique(ids, return_index=True)
            doc, base, parts, held = [], [], [], 0
            for row in once:
                for at in range(int(offsets[row]), int(offsets[row + 1]), PART):
                    end = min(at + PART + length - 1, int(offsets[row + 1]))
                    if end - at >= length:
                        doc.append(ids[row])
                        base.append(at - offsets[row])
                        parts.append(data[at:end])
                        held += end - at
                        if held >= PART:
                            yield Joined(np.array(doc, np.int64), np.array(base, np.int64), parts, length)
                            doc, base, parts, held = [], [], [], 0
            if parts:
                yield Joined(np.array(doc, np.int64), np.array(base, np.int64), parts, length)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        runs = np.concatenate(held)
        by = np.lexsort((runs["lo"], runs["doc"], runs["c"], runs["h"]))
        runs = runs[by]
        same = np.zeros(len(runs), bool)
        same[1:] = (runs["h"][1:] == runs["h"][:-1]) & (runs["c"][1:] == runs["c"][:-1])
        yield from _blobs(runs[~same], (runs["h"][~same] >> U(20)) % U(buckets), ASKED, NAMES)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(runs))))
        again = runs[same & ((runs["doc"] != runs["doc"][head]) | (runs["lo"] != runs["lo"][head]))]
        yield from _blobs(ranges(again, length), _home(again["doc"], groups), SPANS, NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for joined in shards(batches):
            again = repeats(joined.b, joined.valid, joined.order, length)
            found = joined.spans(again, length)
            yield from _blobs(found, _home(found["doc"], groups), SPANS, NAMES)
            held.append(anchors(joined, joined.valid & ~again, length))
            count += len(held[-1])
            if count >= FLUSH:
                yield from send(held)
                held, count = [], 0
        if count:
            yield from send(held)

    return run


def ranges(runs: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(runs), SPAN)
    out["doc"], out["lo"], out["hi"] = runs["doc"], runs["lo"], runs["lo"] + runs["n"] + (length - 1)
    return out


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary())]))


def _merge(length: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        runs = [unpack(x.as_py(), RUN) for x in table.column("data")]
        again, asked = merge(runs)
        out = [*_blobs(ranges(again, length), _home(again["doc"], groups), SPANS, NAMES), *_blobs(asked, _home(asked["doc"], groups), ASKED, NAMES)]
        return _table(out)

    return run


def _cut_out(length: int, buckets: int):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        rows = _lookup(texts)
        wanted = [unpack(x.as_py(), RUN) for x in asked.column("data")]
        wanted = np.concatenate(wanted) if wanted else np.zeros(0, RUN)
        bucket = (wanted["h"] >> U(20)) % U(buckets)
        by = np.lexsort((wanted["lo"], wanted["doc"], wanted["h"], bucket))
        wanted, bucket = wanted[by], bucket[by]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
        out = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = wanted[s:e]
            said = b"".join(rows[d][lo : lo + n + length - 1] for d, lo, n in zip(part["doc"].tolist(), part["lo"].tolist(), part["n"].tolist(), strict=True))
            head = np.int64(len(part)).tobytes() + b"".join(np.ascontiguousarray(part[f]).tobytes() for f in ("doc", "lo", "n"))
            out.append((int(bucket[s]), head + said))
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    return run


def _lookup(texts: pa.Table) -> dict[int, memoryview]:
    rows = {}
    for batch in texts.to_batches():
        data, offsets = text_bytes(batch.column("text"))
        view = memoryview(data)
        for k, doc in enumerate(_ids(batch.column("key")).tolist()):
            rows[doc] = view[offsets[k] : offsets[k + 1]]
    return rows


def _decide(length: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        docs, places, parts = [], [], []
        for x in table.column("data"):
            raw = x.as_py()
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            doc, lo = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)
            size = np.frombuffer(raw, "<u2", n, 8 + 12 * n).astype(np.int64) + length - 1
            said, at = np.frombuffer(raw, np.uint8, -1, 8 + 14 * n), np.cumsum(size) - size
            docs.append(doc)
            places.append(lo.astype(np.int64))
            parts += [said[a : a + s] for a, s in zip(at.tolist(), size.tolist(), strict=True)]
        joined = Joined(np.concatenate(docs), np.concatenate(places), parts, length)
        trim()
        found = joined.spans(repeats(joined.b, joined.valid, joined.order, length), length)
        return _table(list(_blobs(found, _home(found["doc"], groups), SPANS, NAMES)))

    return run


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under the ranges."""
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.append(True, lo[1:] > hi[:-1])[: len(lo)]
    return lo[new], hi[np.append(new[1:], True)[: len(lo)]]


def _finish(kind: pa.DataType):
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        found = [unpack(x.as_py(), SPAN) for x in spans.column("data")]
        found = np.concatenate(found) if found else np.zeros(0, SPAN)
        found = found[np.argsort(found["doc"], kind="stable")]
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for batch in texts.to_batches():
            data, offsets = text_bytes(batch.column("text"))
            ids = _ids(batch.column("key"))
            first, last = np.searchsorted(found["doc"], ids), np.searchsorted(found["doc"], ids, side="right")
            for k in range(len(ids)):
                mine = found[first[k] : last[k]]
                lo, hi = union(mine["lo"].astype(np.int64), mine["hi"].astype(np.int64))
                body, at, digest = memoryview(data[offsets[k] : offsets[k + 1]]), 0, hashlib.sha256()
                for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
                    digest.update(body[at:a])
                    at = z
                digest.update(body[at:])
                out["n_bytes"].append(len(body))
                out["n_removed"].append(int((hi - lo).sum()))
                out["n_spans"].append(len(lo))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append(np.stack([lo, hi], 1).tolist())
            out["doc_id"].append(batch.column("doc_id"))
        ids = pa.chunked_array(out.pop("doc_id"), kind) if texts.num_rows else pa.chunked_array([], kind)
        types = {"kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64()))}
        return pa.table({"doc_id": ids} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return run


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first byte, byte after the last) of each row."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    each = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes"), (F.min("hash") != F.max("hash")).alias("differ"))
    total, differ = each.agg(F.sum("bytes"), F.max("differ")).first()
    total = total or 0
    named = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    if differ:
        rows = rows.join(_numbered(rows), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")))
    else:
        rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = rows.select("key", "text", "doc_id")
    buckets, groups = max(parallelism(spark), total // BUCKET), max(1, total // GROUP + 1)
    first = rows.mapInArrow(_local(length, buckets, groups), SCHEMA)
    asked = F.col("kind") == ASKED
    both = first.withColumn("spread", F.when(asked, F.col("bucket")).otherwise(-1 - F.col("bucket")))

    def merged(table: pa.Table) -> pa.Table:
        """Runs are merged; ranges that shards have found pass."""
        return _merge(length, groups)(table) if table.column("kind")[0].as_py() == ASKED else table.select(NAMES)

    second = cut(both.groupBy("spread").applyInArrow(merged, SCHEMA))
    homed = rows.mapInArrow(_homes(groups), f"bucket long, key long, text string, {named}")
    asks = second.filter(asked).select("bucket", "data")
    parts = homed.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_cut_out(length, buckets), "bucket long, data binary")
    third = parts.groupBy("bucket").applyInArrow(_decide(length, groups), SCHEMA)
    spans = second.filter(~asked).select("bucket", "data").unionByName(third.select("bucket", "data"))
    kind = rows.limit(0).toArrow().schema.field("doc_id").type
    out = f"{named}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    return homed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_finish(kind), out)


def _numbered(rows: DataFrame) -> DataFrame:
    """A number for every id and hash of a text, in their order."""
    pairs = rows.select(F.col("doc_id").cast("long").alias("place"), F.col("doc_id").alias("of_id"), F.col("hash").alias("of_hash")).distinct()
    ordered = pairs.repartitionByRange(parallelism(rows.sparkSession), "place", "of_hash").sortWithinPartitions("place", "of_hash")
    return cut(ordered.select("of_id", "of_hash", F.monotonically_increasing_id().alias("key")))


def _homes(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1, 8 << 20):
            yield pa.record_batch([pa.array(_home(_ids(piece.column(0)), groups)), *piece.columns], ["bucket", "key", "text", "doc_id"])

    return run
