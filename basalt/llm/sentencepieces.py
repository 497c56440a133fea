"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for each boundary in a window of the longest piece, the best way to get
there (score and backpointer). Whenever all surviving backpointer paths pass through one
boundary, the ids up to it are committed and forgotten, so memory is bounded by the longest
piece, not by the text. For unigram models the best path is the one of the highest sum of
scores. For merge (BPE) models a path is allowed only if every two neighbours are what the
merges make of their joined text; exactly one path to each boundary is then allowed, and it
is the one that the merges give, so ids equal those of the usual library.

No piece of the vocabulary holds a blank mark after another character. So all paths converge
before each such mark, whatever follows, and what lies between two marks may be remembered:
a bounded memo maps it to its ids.

Defined cases: null and empty texts have no ids; characters outside the vocabulary become
their UTF-8 bytes where the model has byte pieces, else the unknown id; a text that holds
the blank mark U+2581 itself decodes to a blank there, as with the usual library; very long
words go through the window like all else; rows that repeat get the same ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._spark import pieces, short_batches

MARK = "▁"
MEMO, MEMO_CHARS, PAIRS = 250_000, 48, 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number, and integer or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Vocabulary:
    """What a model file says: pieces, scores, kinds and how texts are prepared."""

    def __init__(self, raw: bytes) -> None:
        self.names: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix = self.squeeze = self.charsmap = False
        self.merges, self.bytes_too = False, False
        squeeze = prefix = True
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.names.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, 1))
            elif field == 2:
                spec = dict(_fields(value))
                self.merges, self.bytes_too = spec.get(3, 1) == 2, bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                prefix, squeeze, self.charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(2, b""))
        self.prefix, self.squeeze = prefix, squeeze
        if self.charsmap or squeeze:
            raise ValueError("models that rewrite characters or blanks are not supported")
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k in (1, 4)}
        self.byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == 6}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == 2), 0)
        self.longest = max(map(len, self.ids), default=1)
        #: Ids of pieces; -1 for what only ends a piece.
        self.tails = {n[i:]: -1 for n in self.ids for i in range(1, len(n))} | self.ids
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.converges = not any(MARK in n.lstrip(MARK) for n in self.ids)
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((-self.scores[self.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def allowed(self, left: int, right: int) -> bool:
        """Whether two pieces can be neighbours (left -1: nothing or an unknown character)."""
        wanted = [self.names[i] for i in (left, right) if i >= 0]
        known = self.merged("".join(wanted)) == wanted
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = known
        return known


class Viterbi:
    """The search over one stream of characters."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.start()

    def start(self) -> None:
        """Everything so far is committed."""
        self.text, self.back, self.piece, self.best = "", [0], [-1], [0.0]

    def push(self, text: str) -> None:
        """Extend the search to the boundaries of ``text``."""
        v, first = self.v, len(self.text)
        self.text += text
        whole, back, piece, best = self.text, self.back, self.piece, self.best
        tails, pairs, merges, scores = v.tails.get, v.pairs.get, v.merges, v.scores
        for i in range(first + 1, len(whole) + 1):
            top, size, chosen = -1e300, 0, -1
            start = i - 1
            while start >= 0 and (found := tails(whole[start:i])) is not None:
                if found >= 0 and (was := best[start]) > -1e300:
                    if merges:
                        left = piece[start]
                        known = pairs(left << 32 | found)
                        if known or known is None and v.allowed(left, found):
                            top, size, chosen = 0.0, i - start, found
                            break
                    elif was + scores[found] > top:
                        top, size, chosen = was + scores[found], i - start, found
                start -= 1
            if size == 0 and (not merges or whole[i - 1] not in v.ids):
                top, size, chosen = best[i - 1] + v.low, 1, -1
            back.append(size)
            piece.append(chosen)
            best.append(top if size else -1e300)

    def _read(self, end: int) -> list[int]:
        out, v = [], self.v
        while end > 0:
            size, found = self.back[end], self.piece[end]
            if found >= 0:
                out.append(found)
            elif v.bytes_too:
                out += [v.byte_ids[b] for b in reversed(self.text[end - 1].encode())]
            elif not out or out[-1] != v.unknown or v.merges:
                out.append(v.unknown)
            end -= size
        return out[::-1]

    def converged(self) -> int:
        """The last boundary that every surviving path passes."""
        n = len(self.text)
        alive = {i for i in range(max(0, n - self.v.longest + 1), n + 1) if i == 0 or self.back[i]}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - self.back[last])
        return alive.pop() if alive else 0

    def commit(self) -> list[int]:
        """The ids that no later character can change. They leave the window."""
        at = self.converged()
        if at == 0:
            return []
        out, keep = self._read(at), self.piece[at]
        self.text = self.text[at:]
        self.back, self.best = [0, *self.back[at + 1 :]], [0.0, *(b if b <= -1e300 else b - self.best[at] for b in self.best[at + 1 :])]
        self.piece = [keep, *self.piece[at + 1 :]]
        return out

    def finish(self) -> list[int]:
        out = self._read(len(self.text))
        self.start()
        return out


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, raw: bytes) -> None:
        self.v = Vocabulary(raw)
        self.search = Viterbi(self.v)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        shown = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else (" ⁇ " if k == 2 else n.replace(MARK, " ")).encode() for n, k in zip(self.v.names, self.v.kinds, strict=True)]
        self._bytes = np.frombuffer(b"".join(shown), np.uint8)
        self._size = np.array([len(s) for s in shown], np.int64)
        self._at = np.cumsum(self._size) - self._size

    def _stream(self, text: str, step: int = 64) -> bytes:
        out: list[int] = []
        self.search.start()
        for i in range(0, len(text), step):
            self.search.push(text[i : i + step])
            if i + step < len(text):
                out += self.search.commit()
        out += self.search.finish()
        return np.array(out, "<i4").tobytes()

    def _part(self, part: str) -> bytes:
        made = self.older.get(part) or self._stream(part)
        if len(part) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[part] = made
        return made

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        text = text.replace(" ", MARK)
        if self.v.prefix:
            text = MARK + text
        if not self.v.converges:
            return np.frombuffer(self._stream(text), "<i4")
        out, lead = [], ""
        parts = text.split(MARK)
        if parts[0]:
            out.append(self.memo.get(parts[0]) or self._part(parts[0]))
        for part in parts[1:]:
            lead += MARK
            if part:
                key = lead + part
                out.append(self.memo.get(key) or self._part(key))
                lead = ""
        if lead:
            out.append(self.memo.get(lead) or self._part(lead))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        size = self._size[ids]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._at[ids] - (ends - size), size)
        raw = self._bytes[take].tobytes()
        if self.v.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_made: dict[bytes, Codec] = {}


def _codec(raw: bytes) -> Codec:
    """One codec for each worker, with what it remembers."""
    key = hashlib.sha256(raw).digest()
    if key not in _made:
        _made.clear()
        _made[key] = Codec(raw)
    return _made[key]


def encode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row. ``model``: the bytes of a model file."""
    return encode_with(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, ["doc_id"])


def encode_with(docs: DataFrame, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, and its ids."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep, F.col(text).alias("__said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for piece in pieces(batches, len(keep), 2 << 20):
            yield pa.record_batch([*(piece.column(k) for k in range(len(keep))), _encoded(codec, piece.column(len(keep)))], [*keep, "ids"])

    kinds = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, f"{kinds}, ids array<int>")


def _encoded(codec: Codec, texts: pa.Array) -> pa.ListArray:
    made = [codec.encode(t.as_py() or "") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids count as none."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            texts = [codec.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 and same (decoded text is the text)."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for piece in pieces(batches, 1, 2 << 20):
            rows = []
            for t in piece.column(1):
                said = t.as_py() or ""
                ids = codec.encode(said)
                back = codec.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == said))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.record_batch([piece.column(0), *columns], ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "same"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_ids long, ids_sha256 string, decoded_sha256 string, same boolean")


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
