"""Byte-level BPE: texts to ids and back.

Texts are cut into pieces as the public pattern cuts them, whole batches at a time; each different piece
is encoded once per task and looked up by a 64-bit hash afterwards, its bytes compared on every hit. New pieces are encoded in padded
matrices of one length class each: every round, every row merges its leftmost pair of minimum rank,
found by hashed pair lookup, and rows are compacted.

Defined cases: a null text counts as empty and has no ids. Strings of special tokens are ordinary text.
Repeated rows have a row each. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import HashIndex, equal_spans, hash_spans, pick, pieces, utf8

#: Rows wider than this are merged with a heap, one by one: rounds over a matrix would be quadratic.
WIDE = 256
#: Pieces that a task remembers before it starts afresh.
REMEMBER = 1_000_000
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The endings that the pattern keeps together with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pattern's character class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    text = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
    back = lambda i: i + 0x800 * (i >= 0xD800)  # noqa: E731  the surrogates are not in the text
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[back(m.start()) : back(m.end() - 1) + 1] = kind
    return out


def split(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start, over all texts of the buffer."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = np.take(_classes(), code)
    bound = np.zeros(len(code) + 1, bool)  # a text starts here; the end of all counts as well
    bound[np.searchsorted(lead, offs)] = True
    edge = bound.copy()
    edge[1:-1] |= kind[1:] != kind[:-1]
    flag = edge[:-1].copy()
    # White space before something else in the same text gives its last character away.
    last = np.flatnonzero((kind == _SPACE) & edge[1:] & ~bound[1:])
    flag[last] = True
    flag[last[code[last] == 0x20] + 1] = False
    # An apostrophe that starts a piece, alone, keeps certain endings.
    for q in np.flatnonzero((code == 0x27) & flag & edge[1:] & ~bound[1:]).tolist():
        for e in ENDINGS:
            stop = q + 1 + len(e)
            if stop <= len(code) and not bound[q + 1 : stop].any() and all(code[q + 1 + i] == ord(x) for i, x in enumerate(e)):
                flag[q + 1 : stop] = False
                if stop < len(code):
                    flag[stop] = True
                break
    return lead[flag]


class Ranks:
    """The vocabulary of a rank file: pair lookup, whole pieces, and each id's bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.pairs, self.merged = HashIndex(np.array(pairs, np.uint64)), np.array(merged, np.int64)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        by_id = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.size = np.array([len(t) for t in by_id])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    NONE = np.iinfo(np.int64).max

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge (as beside the padding, -1)."""
        key = (np.maximum(a, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(b, 0).astype(np.uint64)
        at = self.pairs.find(key.ravel()).reshape(key.shape)
        return np.where((at >= 0) & (a >= 0) & (b >= 0), self.merged[at], self.NONE)

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge all rows of a padded matrix to the end."""
        out: list = [None] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), int)
            best = ranks[np.arange(len(rows)), j] if ranks.shape[1] else np.full(len(rows), self.NONE)
            over = best == self.NONE
            for r in np.flatnonzero(over):
                row = ids[r]
                out[rows[r]] = row[row >= 0]
            ids, ranks, rows, j, best = ids[~over], ranks[~over], rows[~over], j[~over], best[~over]
            if not len(rows):
                break
            every = np.arange(len(rows))
            ids[every, j] = best
            col = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, col + (col > j[:, None]), axis=1)
            col = col[:-1]
            ranks = np.take_along_axis(ranks, col + (col >= j[:, None]), axis=1)
            for side in (j - 1, j):
                ok = (side >= 0) & (side < ids.shape[1] - 1)
                ranks[every[ok], side[ok]] = self.rank(ids[every[ok], side[ok]], ids[every[ok], side[ok] + 1])
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merged = lambda a, b: self.ranks.get(self._of(a) + self._of(b))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := merged(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = right[i]
            if ids[i] != a or k >= n or ids[k] != b:
                continue
            ids[i], ids[k] = rank, -1
            right[i] = right[k]
            if right[i] < n:
                left[right[i]] = i
                if (r := merged(rank, ids[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[right[i]]))
            if left[i] >= 0 and (r := merged(ids[left[i]], rank)) is not None:
                heapq.heappush(heap, (r, left[i], ids[left[i]], rank))
        return np.array([x for x in ids if x >= 0], np.int64)

    def _of(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def encode(self, found: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [None] * len(found)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(found):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = np.array([whole])
            elif len(piece) > WIDE:
                out[i] = self._heap(piece)
            else:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in classes.items():
            for a in range(0, len(members), 1 + (1 << 18) // width):
                part = members[a : a + 1 + (1 << 18) // width]
                size = np.array([len(found[i]) for i in part])
                cells = np.zeros((len(part), width), np.uint8)
                cells[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(found[i] for i in part), np.uint8)
                ids = np.where(np.arange(width) < size[:, None], self.single[cells], -1)
                for i, row in zip(part, self._matrix(ids), strict=True):
                    out[i] = row
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        return spread(self.bytes, self.start[ids], self.size[ids])


def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every row, end to end."""
    total = int(size.sum())
    shift = start - (np.cumsum(size) - size)
    return values[np.repeat(shift, size) + np.arange(total)]


class Encoder:
    """Texts to ids through remembered pieces; `encode` gives the ids of pieces not met before. A piece is
    found by its hash and then compared byte by byte; one that shares another's hash is encoded on its own."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex(np.zeros(0, np.uint64))
        self.ids, self.raw = Rows(np.uint32), Rows(np.uint8)

    def _add(self, keys: np.ndarray, found: list[bytes]) -> None:
        self.ids.add(self.encode(found))
        self.raw.add([np.frombuffer(p, np.uint8) for p in found])
        self.index.add(keys)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts."""
        start = split(data, offs)
        end = np.append(start[1:], len(data))
        long = end - start
        codes, keys = pd.factorize(hash_spans(data, start, end))
        if len(self.index.keys) > REMEMBER:
            self._clear()
        first = np.zeros(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        rows = self.index.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw, at = data.tobytes(), first[new]
            rows[new] = np.arange(len(new)) + len(self.index.keys)
            self._add(keys[new], [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        known = (self.raw.size[rows] == long[first]) & equal_spans(data, start[first], self.raw.flat, self.raw.start[rows], np.minimum(long[first], self.raw.size[rows]), spare=True)
        like = (long == long[first][codes]) & equal_spans(data, start, data, start[first][codes], np.minimum(long, long[first][codes]))
        other = np.flatnonzero(~(like & known[codes]))
        rows = rows[codes]
        size = self.ids.size[rows].astype(np.int64)
        if len(other):
            own = self.encode([data[start[i] : end[i]].tobytes() for i in other.tolist()])
            size[other] = [len(x) for x in own]
        ends = np.append(0, np.cumsum(size))
        if len(other):
            out = np.zeros(ends[-1], np.uint32)
            rest = np.delete(np.arange(len(rows)), other)
            out[spread(np.arange(ends[-1]), ends[rest], size[rest])] = spread(self.ids.flat, self.ids.start[rows[rest]], size[rest])
            for i, x in zip(other.tolist(), own, strict=True):
                out[ends[i] : ends[i + 1]] = x
        else:
            out = spread(self.ids.flat, self.ids.start[rows], size)
        return out, ends[np.searchsorted(start, offs)]


class Rows:
    """Arrays of any length end to end, growing: row i is flat[start[i] : start[i] + size[i]], and eight cells
    at least are spare."""

    def __init__(self, kind: type):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.start, self.size, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def add(self, rows: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in rows])
        n, m, total = self.count, self.count + len(rows), self.used + int(size.sum())
        while m > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while total + 8 > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : total] = np.concatenate(rows)
        self.size[n:m], self.start[n:m] = size, self.used + np.cumsum(size) - size
        self.count, self.used = m, total


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(ranks(path).encode)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row, ids by the rank file at `path` (a path on every executor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path)
        for batch in pieces(batches):
            ids, at = encode(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of every row of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            out = [table.decode(np.asarray(v.as_py() or [], np.int64)).tobytes() for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = rank_encoder(path), ranks(path)
        sha = lambda raw, at: [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for batch in pieces(batches):
            ids, at = encode(*utf8(batch.column("text")))
            back = np.append(0, np.cumsum(table.size[ids]))[at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(sha(ids.astype("<u4").tobytes(), 4 * at), pa.string()), pa.array(sha(table.decode(ids).tobytes(), back), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
