"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference counts.

An index holds, for all documents inserted so far:
  held     (h1, h2, doc_id): which documents hold which line keys, by 128-bit digests of the keys,
  counts   (h1, h2, first, docs): keys of two documents or more, with the smallest of them,
  filters  (shard, cells): one cuckoo filter a shard, over the keys of `held`.
Inserting documents sends one 64-bit hash a key and task to the key's shard. There the filter tells which keys are
surely new: they enter the filter, and no exact count is needed. Only keys that the filter may have seen, in the
index or earlier in the same batch, are counted exactly. Removing documents counts the keys they held anew; cells
that no living key needs leave the filters. An index is a set of written tables that are never changed: every
insertion and removal returns another index, and earlier ones stay readable.

A cell is a fingerprint with its pair of buckets, each bucket being the other's partner under the fingerprint.
Keys that share a cell share one entry, so a filter holds exactly the cells of the living keys: it never
misses a key, however often keys come and go. Filters are laid out anew when they would get too full.

A key is a line without white space at its ends and with A-Z in lower case; only keys of at least `least` code
points count. A document loses all lines of a key that a document with a smaller id holds too.

Defined cases: a null or empty text is one empty line. Rows of one doc_id are one document: a line that
only they repeat stays in all of them. A row without an id holds no keys and keeps all its lines. Documents that are
inserted again, or removed without being there, change nothing. Equal keys are keys with equal digests (128 bits,
cryptographic). Other columns are not read, and `stripped` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WHITE, materialise, pick, pieces, utf8

#: Code points of a key that counts.
LEAST = 10
#: Entries of a bucket, and the share of all entries up to which a filter is filled.
SLOTS, LOAD = 4, 0.8
#: Keys a shard is laid out for, and the fewest shards.
SHARD, SHARDS = 1 << 20, 16
#: Hashes that a task collects before it sends them to the shards.
SENT = 1 << 21
#: Entries are moved at most so often before the rest goes to a filter's spill list.
MOVES = 200

_NOT_WHITE = np.ones(256, bool)
_NOT_WHITE[list(WHITE)] = False


# --- The filter -------------------------------------------------------------------------------


def _partner(bucket: np.ndarray, mark: np.ndarray, bits: int) -> np.ndarray:
    """The other bucket of a fingerprint; the partner's partner is the bucket itself."""
    return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 7) & ((1 << bits) - 1))


class Cuckoo:
    """A cuckoo filter of 2**bits buckets with 16-bit fingerprints, over 64-bit hashes, for whole arrays."""

    def __init__(self, bits: int, raw: bytes | None = None):
        self.bits, size = bits, (SLOTS << bits) * 2
        self.table = np.zeros((1 << bits, SLOTS), np.uint16) if raw is None else np.frombuffer(raw[:size], "<u2").reshape(-1, SLOTS).copy()
        self.spill = set() if raw is None else set(np.frombuffer(raw[size:], "<i8").tolist())

    def raw(self) -> bytes:
        return self.table.astype("<u2").tobytes() + np.array(sorted(self.spill), "<i8").tobytes()

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's cell: the smaller bucket of its pair and its fingerprint, as one number."""
        mark = (hashes >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64) % 0xFFFF + 1
        bucket = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return np.minimum(bucket, _partner(bucket, mark, self.bits)) << 16 | mark

    def has(self, cells: np.ndarray) -> np.ndarray:
        low, mark = cells >> 16, cells & 0xFFFF
        out = (self.table[low] == mark[:, None]).any(axis=1) | (self.table[_partner(low, mark, self.bits)] == mark[:, None]).any(axis=1)
        return out | np.isin(cells, list(self.spill)) if self.spill else out

    def add(self, cells: np.ndarray) -> None:
        """Insert different cells that are not there yet."""
        mark, bucket = cells & 0xFFFF, cells >> 16
        turn = 0
        while len(mark) and turn < MOVES:
            for _ in range(2):  # both buckets, in turn
                bucket, mark = self._place(bucket, mark)
                bucket = _partner(bucket, mark, self.bits)
            if len(mark):  # full: one entry of each bucket makes room and looks for its other bucket
                _, one = np.unique(bucket, return_index=True)
                rest = np.setdiff1d(np.arange(len(mark)), one)
                slot = (mark[one] + turn) % SLOTS
                out = self.table[bucket[one], slot].astype(np.int64)
                self.table[bucket[one], slot] = mark[one]
                mark = np.concatenate([out, mark[rest]])
                bucket = np.concatenate([_partner(bucket[one], out, self.bits), bucket[rest]])
                turn += 1
        self.spill |= set((np.minimum(bucket, _partner(bucket, mark, self.bits)) << 16 | mark).tolist())

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put what fits into the free entries of its bucket; what is left over comes back."""
        order = np.argsort(bucket, kind="stable")
        bucket, mark = bucket[order], mark[order]
        nth = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        free = self.table[bucket] == 0
        fits = nth < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free, axis=1) == (nth + 1)[:, None], axis=1)
        self.table[bucket[fits], slot[fits]] = mark[fits]
        return bucket[~fits], mark[~fits]

    def remove(self, cells: np.ndarray) -> None:
        """Take out different cells that are there."""
        for cell in cells.tolist():
            mark, low = cell & 0xFFFF, cell >> 16
            for bucket in (low, int(_partner(np.array(low), np.array(mark), self.bits))):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
            self.spill.discard(cell)

    def offer(self, hashes: np.ndarray) -> np.ndarray:
        """Insert what is surely new, and return the hashes that may have been there: seen by the filter
        before, or sharing their cell with another place of the array."""
        cells = self.cells(hashes)
        order = np.argsort(cells, kind="stable")
        first = np.ones(len(cells), bool)
        first[order[1:]] = cells[order[1:]] != cells[order[:-1]]
        known = self.has(cells)
        self.add(cells[first & ~known])
        return np.unique(hashes[known | ~first])


# --- Lines ------------------------------------------------------------------------------------


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts, and the n + 1 offsets of the texts' lines."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    at = np.searchsorted(breaks, offs) + np.arange(len(offs))  # a text has one line more than breaks
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[at[1:] - 1] = offs[1:]
    return starts, ends, at


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> list[bytes | None]:
    """The digest of each line's key, None where the key is too short to count."""
    solid = np.flatnonzero(np.take(_NOT_WHITE, data))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = first < last
    a, b = starts.copy(), starts.copy()
    a[some], b[some] = solid[first[some]], solid[last[some] - 1] + 1
    counts = points[b] - points[a] >= least
    low = np.take(LOWER, data).tobytes()
    return [hashlib.blake2b(low[x:y], digest_size=16).digest() if ok else None for x, y, ok in zip(a.tolist(), b.tolist(), counts.tolist(), strict=True)]


def held_keys(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc_id): the different keys of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offs = utf8(batch.column("text"))
            starts, ends, at = lines(data, offs)
            found = keys(data, starts, ends, least)
            each = [set(found[a:b]) - {None} for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            raw = np.frombuffer(b"".join(k for own in each for k in own), "<i8").reshape(-1, 2)
            ids = np.repeat(np.arange(len(each)), [len(own) for own in each])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(raw[:, 0])), pa.array(np.ascontiguousarray(raw[:, 1])), batch.column("doc_id").take(pa.array(ids))], ["h1", "h2", "doc_id"])

    return pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "h1 long, h2 long, doc_id long")


# --- The index --------------------------------------------------------------------------------

_HELD, _COUNTS, _FILTERS = "h1 long, h2 long, doc_id long", "h1 long, h2 long, first long, docs long", "shard int, cells binary"
#: What a shard reads, in this order: its filter, keys it only enters, keys it is offered, keys that died, living keys.
_FILTER, _OLD, _NEW, _DEAD, _LIVE = range(5)


@dataclass(frozen=True)
class Index:
    """The written tables of a line index, and the layout of its filters."""

    held: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    bits: int
    least: int = LEAST

    @staticmethod
    def empty(spark: SparkSession, least: int = LEAST) -> Index:
        none = lambda schema: spark.createDataFrame([], schema)
        return Index(none(_HELD), none(_COUNTS), none(_FILTERS), SHARDS, 0, least)

    def inserted(self, docs: DataFrame) -> Index:
        """The index with the documents of docs (doc_id, text) as well."""
        more = materialise(held_keys(docs, self.least), "keys")
        n, was = more.count(), self.held.count()
        if was:  # what is there already is not held twice
            more = materialise(more.join(self.held, ["h1", "h2", "doc_id"], "left_anti"), "new-keys")
        shards, bits, sent = self.shards, self.bits, None
        if (was + n) > LOAD * SLOTS * (shards << bits) or not bits:
            shards = max(shards, 1 << max(0, (was + n - 1) // SHARD).bit_length())
            bits = max(4, int((was + n) / (shards * SLOTS * LOAD * 0.9)).bit_length())
            sent = _sent(self.held, shards, _OLD)  # all filters are laid out anew
        else:
            sent = self.filters.select("shard", F.lit(_FILTER).alias("kind"), F.col("cells").alias("raw"))
        seen = materialise(_in_shards(sent.union(_sent(more, shards, _NEW)), bits), "filters")
        maybe = materialise(seen.where("cells IS NULL").select(F.col("h1")).distinct(), "seen")
        held = more if not was else materialise(self.held.union(more), "held")
        # Written before it is counted: a join whose rows are then grouped by its key would not be split.
        counts = _counted(materialise(held.join(maybe, "h1", "left_semi"), "candidates"))
        if was:
            counts = counts.union(self.counts.join(maybe, "h1", "left_anti"))
        return Index(held, materialise(counts, "counts"), seen.where("cells IS NOT NULL").select("shard", "cells"), shards, bits, self.least)

    def removed(self, ids: DataFrame) -> Index:
        """The index without the documents of ids (doc_id)."""
        gone_ids = materialise(pick(ids, "doc_id").where("doc_id IS NOT NULL").distinct(), "ids")
        held = materialise(self.held.join(gone_ids, "doc_id", "left_anti").select("h1", "h2", "doc_id"), "held")
        touched = materialise(self.held.join(gone_ids, "doc_id", "left_semi").select("h1", "h2").distinct(), "touched")
        living = materialise(held.join(touched, ["h1", "h2"], "left_semi"), "living")
        dead = touched.join(living, ["h1", "h2"], "left_anti")
        sent = self.filters.select("shard", F.lit(_FILTER).alias("kind"), F.col("cells").alias("raw"))
        sent = sent.union(_sent(dead, self.shards, _DEAD)).union(_sent(held, self.shards, _LIVE))
        seen = materialise(_in_shards(sent, self.bits), "filters")
        counts = self.counts.join(touched, ["h1", "h2"], "left_anti").union(_counted(living))
        return Index(held, materialise(counts, "counts"), seen.where("cells IS NOT NULL").select("shard", "cells"), self.shards, self.bits, self.least)

    def losses(self) -> DataFrame:
        """(doc_id, gone): the digests of the keys whose lines a document loses, end to end."""
        # Both sides are written tables: the rows of a very common line can be split.
        lost = self.held.join(self.counts, ["h1", "h2"]).where("doc_id <> first").select("doc_id", "h1", "h2")
        return materialise(lost.groupBy("doc_id").agg(F.collect_list("h1").alias("g1"), F.collect_list("h2").alias("g2")), "losses")


def _counted(held: DataFrame) -> DataFrame:
    """Keys that two documents or more hold, exactly."""
    each = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))  # rows of one document count once
    return each.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")).where("docs > 1")


def _sent(keyed: DataFrame, shards: int, kind: int) -> DataFrame:
    """(shard, kind, raw): what a task has of each shard's hashes as one row. A key that a task holds more than
    once goes out twice, so that the shard sees it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0

        def out() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(part) if part else np.zeros(0, np.int64), return_counts=True)
            found = np.repeat(found, np.minimum(count, 2)).view(np.uint64)
            at = (found >> np.uint64(48)).astype(np.int64) % shards
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(shards + 1))
            rows = [(s, found[order[a:b]].tobytes()) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r for _, r in rows], pa.binary())], ["shard", "kind", "raw"])

        for batch in batches:
            part.append(np.asarray(batch.column("h1")))
            size += batch.num_rows
            if size >= SENT:
                yield out()
                part, size = [], 0
        yield out()

    return keyed.select("h1").mapInArrow(run, "shard int, kind int, raw binary")


def _in_shards(sent: DataFrame, bits: int) -> DataFrame:
    """(shard, h1, cells): the filter of every shard that anything was sent to, and, in rows of their own, the
    hashes that it may have seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, dead = None, None, None

        def row(hashes: np.ndarray, raw: bytes | None) -> pa.RecordBatch:
            n = len(hashes) if raw is None else 1
            return pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int32()), pa.array(hashes.view(np.int64) if raw is None else [None], pa.int64()), pa.array([raw] * n, pa.binary())], ["shard", "h1", "cells"])

        def done() -> pa.RecordBatch:
            own.remove(dead)
            return row(dead, own.raw())

        for batch in batches:
            for shard, kind, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "raw")), strict=True):
                if shard != at:
                    if own is not None:
                        yield done()
                    at, own, dead = shard, Cuckoo(bits, raw if kind == _FILTER else None), np.zeros(0, np.int64)
                    if kind == _FILTER:
                        continue
                hashes = np.frombuffer(raw, np.uint64)
                if kind == _NEW:
                    yield row(own.offer(hashes), None)
                elif kind == _OLD:
                    own.offer(hashes)
                elif kind == _DEAD:
                    dead = np.union1d(dead, own.cells(hashes))
                elif kind == _LIVE:  # a cell that a living key needs stays
                    dead = np.setdiff1d(dead, own.cells(hashes))
        if own is not None:
            yield done()

    dealt = sent.repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "shard int, h1 long, cells binary")


# --- What documents keep ----------------------------------------------------------------------


def _kept(batch: pa.RecordBatch, least: int) -> Iterator[tuple[int, int, str]]:
    """(lines, lines dropped, text left) of each row of a batch (text, g1, g2)."""
    data, offs = utf8(batch.column("text"))
    starts, ends, at = lines(data, offs)
    text = data.tobytes()
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        g1 = batch.column("g1")[i].as_py()
        whole = text[offs[i] : offs[i + 1]]
        if not g1:
            yield b - a, 0, whole
            continue
        gone = set(np.stack([g1, batch.column("g2")[i].as_py()], axis=1).astype("<i8").view("S16").ravel().tolist())
        gone = {g.ljust(16, b"\0") for g in gone}
        part = data[offs[i] : offs[i + 1]]
        s, e = starts[a:b] - offs[i], ends[a:b] - offs[i]
        left = [whole[x:y] for x, y, key in zip(s.tolist(), e.tolist(), keys(part, s, e, least), strict=True) if key not in gone]
        yield b - a, b - a - len(left), b"\n".join(left)


def _with_losses(docs: DataFrame, index: Index) -> DataFrame:
    losses = index.losses()
    return docs.alias("d").join(losses.alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left").select("d.*", F.col("l.g1").alias("g1"), F.col("l.g2").alias("g2"))


def decisions(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of docs under the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, dropped, left = zip(*_kept(batch, index_least), strict=True)
            sha = [hashlib.sha256(x).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    index_least = index.least
    return _with_losses(pick(docs, "doc_id", "text"), index).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def stripped(docs: DataFrame, index: Index) -> DataFrame:
    """docs without the lines that they lose, with all their columns; n_chars, where there is one, is counted anew."""
    names, schema, least = docs.columns, docs.schema, index.least
    g1, g2 = (next(c for i in range(len(names) + 1) if (c := f"{g}{'_' * i}").lower() not in map(str.lower, names)) for g in ("g1", "g2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            part = pa.RecordBatch.from_arrays([batch.column(c) for c in ("text", g1, g2)], ["text", "g1", "g2"])
            _, dropped, left = zip(*_kept(part, least), strict=True)
            changed = pa.array([d > 0 for d in dropped])
            texts = pa.array([x.decode() for x in left], batch.column("text").type)
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.compute.if_else(changed, texts, batch.column("text"))
            if "n_chars" in columns:
                counted = pa.array([len(x.decode()) for x in left]).cast(columns["n_chars"].type)
                columns["n_chars"] = pa.compute.if_else(changed, counted, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    losses = index.losses().select(F.col("doc_id").alias("of"), F.col("g1").alias(g1), F.col("g2").alias(g2))
    joined = docs.alias("d").join(losses.alias("l"), F.col("d.doc_id") == F.col("l.of"), "left")
    return joined.select("d.*", F.col(f"l.{g1}"), F.col(f"l.{g2}")).mapInArrow(run, schema)


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The decisions for docs among themselves."""
    return decisions(docs, Index.empty(docs.sparkSession, least).inserted(docs))
