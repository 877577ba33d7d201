"""Suffix-array dedup: which bytes lie in a long string that also starts somewhere else.

A window is any `length` consecutive bytes of one text. Every byte of a window that occurs at two or
more places (in one text or in several) is removed; windows are judged on the input.

How the corpus is cut for suffix arrays: every window picks an anchor, the leftmost smallest gram inside
it, so that equal windows pick equal anchors at equal distances. Neighbouring windows with the same anchor
form one context. Only contexts whose anchor gram occurs again can hold repeats; equal contexts are
counted, and the different contexts of one anchor meet in one task, where a suffix array over them is
built by two-stage sorting and adjacent common prefixes of at least `length` bytes mark the windows.
An anchor with more than `GROUP` different contexts (the edge of a very common passage) is split: its
contexts are cut into blocks of windows at the same distances from the anchor, and the bytes that all
windows of a block share take the anchor's place, so that they spread over all tasks. Blocks that are still
too common are cut again, in the end to single windows. Whole contexts are taken as equal where the anchor's
hash and a 62-bit polynomial hash modulo a prime at two random bases agree.

Defined cases: a null text counts as empty; texts shorter than `length` lose nothing. Other columns are
not read. Every row is a text of its own, rows that repeat another's id or all of it too; a row without an id loses
nothing, and its strings count for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialise, mix, pick, pieces, rolling_hashes, utf8

LENGTH, GRAM = 200, 24
#: Different contexts of one anchor that one task sorts; above it they are split.
GROUP = 256
#: Windows in a block, from one splitting to the next.
SPLITS = (32, 4, 1)
#: Bytes of contexts in one suffix array.
BLOCK = 1 << 18
#: Ids that may be broadcast to pick texts; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 500_000


# --- The suffix array -------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a byte array in order of their first `depth` bytes at least. Only suffixes
    smaller than their successors are sorted directly; the others follow from scanning the buckets of
    the first byte upwards: a suffix that is larger than its successor comes, within its bucket, in the
    order in which its successor is met."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(text.astype(np.int16), append=-1)).astype(np.int8)  # the end is smallest
    at = np.where(step != 0, np.arange(n), n)
    follow = np.minimum.accumulate(at[::-1])[::-1]
    smaller = step[follow] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.as_strided(padded, (n, depth), (1, 1))[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))  # sorted by first byte already
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        own = direct[cuts[c] : cuts[c + 1]]
        part = np.concatenate(waiting[c]) if waiting[c] else own[:0]
        bucket = []
        while len(part):  # runs of one byte are larger than their successors in the same bucket
            bucket.append(part)
            before = part[part > 0] - 1
            part = before[(text[before] == c) & ~smaller[before]]
        bucket.append(own)
        whole = np.concatenate(bucket)
        if len(whole):
            out.append(whole)
            before = whole[whole > 0] - 1
            before = before[(text[before] > c) & ~smaller[before]]
            lead = text[before]
            order = np.argsort(lead, kind="stable")
            before, lead = before[order], lead[order]
            edge = np.flatnonzero(lead[1:] != lead[:-1]) + 1
            for bucket_part in np.split(before, edge) if len(lead) else ():
                waiting[text[bucket_part[0]]].append(bucket_part)
    return np.concatenate(out)


def shared_prefix(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares at least `depth` bytes with the one before it in the order."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(text) + depth, 8), (1, 1))).view(np.uint64).ravel()
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    steps = [*range(0, depth - 7, 8)] + ([depth - 8] if depth % 8 else [])
    for k in steps:
        live = live[words[order[live] + k] == words[order[live - 1] + k]]
    same[live] = True
    return same


def repeated_starts(contexts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the offsets, below its count, of windows that occur again in any of them."""
    size = np.array([len(c) + 1 for c in contexts])
    base = np.cumsum(size) - size
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    valid = np.zeros(len(text) + 1, np.int64)
    np.add.at(valid, base, 1)
    np.add.at(valid, base + counts, -1)
    valid = np.cumsum(valid)[:-1] > 0
    order = suffix_array(text, length)
    same = shared_prefix(text, order, length)
    run = np.cumsum(~same) - 1
    real = valid[order]
    again = np.bincount(run, real) >= 2
    hit = np.sort(order[real & again[run]])
    cut = np.searchsorted(hit, np.append(base, len(text)))
    return [hit[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], base, strict=True)]


def runs(starts: np.ndarray) -> list[int]:
    """Sorted offsets as flat pairs (first, last) of consecutive runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]], axis=1).reshape(-1).tolist()


# --- Anchors ----------------------------------------------------------------------------------


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of all texts: (text number, first window, number of windows, gram hash, context hash)."""
    n, span = len(data), length - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sizes = np.diff(offs)
    if n < length or not (sizes >= length).any():
        return none
    hashes = gram_hashes(data, gram)
    key = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    width, least = 1, key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, (offs[1:] - length + 1)[long], -1)
    window = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    place = (least[window] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(window) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    first, place = window[head], place[head]
    owner = np.searchsorted(offs, first, side="right") - 1
    return owner, first - offs[owner], count, hashes[place], rolling_hashes(data, first, first + count - 1 + length)


def _segments(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchors(), a stretch at a time for a text too long for 24-bit places."""
    most = 1 << 22
    if len(data) <= most:
        return anchors(data, offs, length, gram)
    parts = []
    for d in range(len(offs) - 1):
        for a in range(int(offs[d]), max(int(offs[d]) + 1, int(offs[d + 1]) - length + 1), most):
            b = min(a + most + length - 1, int(offs[d + 1]))
            _, first, *rest = anchors(data[a:b], np.array([0, b - a]), length, gram)
            parts.append((np.full(len(first), d), first + a - offs[d], *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offs = utf8(batch.column("text"))
            owner, first, count, h, c = _segments(data, offs, length, gram)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(np.diff(offs)), pa.array(sha, pa.string()), _lists(h.view(np.int64), at, pa.int64()), _lists(c.view(np.int64), at, pa.int64()), _lists(first, at, pa.int32()), _lists(count, at, pa.int32())], ["doc_id", "t", "n_bytes", "sha", "h", "c", "first", "count"])

    return docs.mapInArrow(run, "doc_id long, t long, n_bytes long, sha string, h array<long>, c array<long>, first array<int>, count array<int>")


def _texts_of(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """docs joined with one row per id and text of per_doc; a checked small number of ids is sent to the texts
    first, so that only their texts are shuffled."""
    ids = per_doc.select("doc_id").distinct()
    if per_doc.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(per_doc, ["doc_id", "t"])


def _cut(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 18):
            rows: list[tuple] = []
            for text, found in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw = (text.as_py() or "").encode()
                rows += [(x["h"], x["c"], x["count"], raw[x["first"] : x["first"] + x["count"] - 1 + length]) for x in found.as_py()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], ["h", "c", "count", "bytes"])

    return wanted.select("text", "wanted").mapInArrow(run, "h long, c long, count int, bytes binary")


def split_context(raw: bytes, count: int, length: int, gram: int, block: int) -> list[tuple[int, int, int, int, bytes]]:
    """Blocks (key, content, first window, windows, bytes) of a context. Equal windows lie at equal
    distances from their anchor, so in blocks of one key: the hash of what all windows of a block share."""
    data = np.frombuffer(raw, np.uint8)
    anchor = int((gram_hashes(data[:length], gram) >> np.uint64(24)).argmin())  # as anchors() chooses it
    window = np.arange(count)
    number = (anchor - window) // block
    head = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    n = np.diff(np.append(head, count))
    k = number[head]
    end = head + n - 1 + length
    core = anchor - k * block
    key = mix(rolling_hashes(data, core, core - block + 1 + length))
    half = head + (end - head) // 2
    content = mix(rolling_hashes(data, head, half)) ^ rolling_hashes(data, half, end)
    key ^= mix(k.astype(np.uint64))
    return [(a, b, i, m, raw[i:e]) for a, b, i, m, e in zip(key.view(np.int64).tolist(), content.view(np.int64).tolist(), head.tolist(), n.tolist(), end.tolist(), strict=True)]


def _blocks(contexts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """(h, c, off, key, content, count, bytes): each context cut into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "c", "off", "key", "content", "count", "bytes")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = []
                for h, c, count, raw in zip(*(part.column(k).to_pylist() for k in ("h", "c", "count", "bytes")), strict=True):
                    rows += [(h, c, i, key, content, n, b) for key, content, i, n, b in split_context(raw, count, length, gram, block)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return contexts.select("h", "c", "count", "bytes").mapInArrow(run, "h long, c long, off int, key long, content long, count int, bytes binary")


def _sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(h, c, runs) by suffix arrays: contexts with one h meet in one task, next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            found = repeated_starts([x[3] for x in held], np.array([x[2] for x in held]), length)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([runs(f) for f in found], pa.list_(pa.int32()))], ["h", "c", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "count", "bytes")), strict=True):
                if size > BLOCK and row[0] != last:
                    yield flush()
                    held.clear()
                    size = 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield flush()

    dealt = contexts.select("h", "c", "count", "bytes").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "h long, c long, runs array<int>").where("size(runs) > 0")


def _repeats(contexts: DataFrame, length: int, gram: int, group: int, splits: tuple[int, ...]) -> DataFrame:
    """(h, c, runs) of contexts (h, c, count, bytes), different ones all, that hold repeated windows."""
    wide = contexts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group).select("h")
    if not splits or not wide.limit(1).count():
        return _sorted_repeats(contexts, length)
    wide = materialise(wide, "wide")
    cut = materialise(_blocks(contexts.join(wide, "h", "left_semi"), length, gram, splits[0]), "blocks")
    again = materialise(cut.groupBy("key").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("varied")).where("n > 1").select("key", "varied"), "again")
    found = cut.join(again, "key")
    kinds = materialise(found.groupBy("key", "content", "varied").agg(F.count("*").alias("copies"), F.min(F.struct("count", "bytes")).alias("x")), "kinds")
    whole = kinds.where("copies > 1").select("key", "content", F.array(F.lit(0), F.col("x.count") - 1).alias("runs"))
    inner = kinds.where("varied").select(F.col("key").alias("h"), F.col("content").alias("c"), "x.count", "x.bytes")
    partly = _repeats(inner, length, gram, group, splits[1:]).select(F.col("h").alias("key"), F.col("c").alias("content"), "runs")
    partly = partly.join(kinds.where("copies > 1").select("key", "content"), ["key", "content"], "left_anti")
    repeats = materialise(partly.union(whole), "repeats")
    back = cut.select("h", "c", "off", "key", "content").join(repeats, ["key", "content"])
    hot = back.groupBy("h", "c").agg(F.flatten(F.collect_list(F.transform("runs", lambda i: i + F.col("off")))).alias("runs"))
    return _sorted_repeats(contexts.join(wide, "h", "left_anti"), length).union(hot)


def _marks(docs: DataFrame, length: int, gram: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n_bytes, sha) of all texts, and (doc_id, t, marks) of those that hold repeats; t tells texts of one
    id apart."""
    scanned = materialise(_scan(docs, length, gram), "anchors")
    flat = scanned.select("doc_id", "t", F.inline(F.arrays_zip("h", "c", "first", "count")))
    again = flat.groupBy("h").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("varied")).where("n > 1").select("h", "varied")
    again = materialise(again, "again")  # two plain sides: a very common anchor's rows can be split in the join
    found = materialise(flat.join(again, "h"), "found")

    kinds = found.groupBy("h", "c", "varied").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "t", "first", "count")).alias("rep"))
    kinds = materialise(kinds, "kinds")
    reps = kinds.where("varied").select("rep.doc_id", "rep.t", F.struct("h", "c", "rep.first", "rep.count").alias("w"))
    reps = materialise(reps.groupBy("doc_id", "t").agg(F.collect_list("w").alias("wanted")), "reps")
    contexts = materialise(_cut(_texts_of(docs, reps), length), "contexts")  # a repeated row gives its contexts twice, all of them repeats anyway

    partly = _repeats(contexts, length, gram, group, tuple(b for b in SPLITS if b == 1 or 2 * b <= length))
    whole = kinds.where("copies > 1").select("h", "c", F.array(F.lit(0), F.col("rep.count") - 1).alias("runs"))
    partly = partly.join(kinds.where("copies > 1").select("h", "c"), ["h", "c"], "left_anti")
    repeats = materialise(partly.union(whole), "repeats")
    marks = found.join(repeats, ["h", "c"]).groupBy("doc_id", "t").agg(F.collect_list(F.struct("first", "runs")).alias("marks"))
    return scanned.select("doc_id", "t", "n_bytes", "sha"), materialise(marks, "marks")


def _removed(n: int, marks: list[dict], length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for m in marks:
        pair = np.array(m["runs"], np.int64).reshape(-1, 2) + m["first"]
        np.add.at(edge, pair[:, 0], 1)
        np.add.at(edge, pair[:, 1] + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _apply(marked: DataFrame, length: int) -> DataFrame:
    """(doc_id, t, n_removed, n_spans, kept_sha256) of each marked text; a repeated row has one row here."""
    names, kinds = ["doc_id", "t", "n_removed", "n_spans", "kept_sha256"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for i, t, text, marks in zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), batch.column("text"), batch.column("marks"), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                gone = _removed(len(data), marks.as_py(), length)
                rows.append((i, t, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    done = marked.select("doc_id", "t", "text", "marks").mapInArrow(run, "doc_id long, t long, n_removed long, n_spans long, kept_sha256 string")
    return done.dropDuplicates(["doc_id", "t"])


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = pick(docs, "doc_id", "text").withColumn("t", F.xxhash64("text"))
    every, marks = _marks(texts, length, gram, group)
    cut = _apply(_texts_of(texts, marks), length)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(cut, ["doc_id", "t"], "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """docs with repeated strings cut from text; a character that loses a byte goes wholly, and a
    column n_chars follows the text. Other columns stay as they are."""
    names, schema = docs.columns, docs.schema
    _, marks = _marks(pick(docs, "doc_id", "text").withColumn("t", F.xxhash64("text")), length, gram, group)
    taken = {c.lower() for c in names}
    spare = [next(c for i in range(len(names) + 1) if (c := f"{base}{'_' * i}") not in taken) for base in ("_of", "_t", "_marks")]
    marks = marks.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "t", "marks"), spare, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = {c: batch.column(c) for c in names}
            marked = batch.column(spare[2])
            hit = np.flatnonzero(np.asarray(marked.is_valid())).tolist()
            if hit:
                left = [None] * batch.num_rows
                for i in hit:
                    data = np.frombuffer((columns["text"][i].as_py() or "").encode(), np.uint8)
                    left[i] = data[~_removed(len(data), marked[i].as_py(), length)].tobytes().decode("utf-8", "ignore")
                columns["text"] = pc.coalesce(pa.array(left, columns["text"].type), columns["text"])
                if "n_chars" in columns:
                    counted = pa.array([None if x is None else len(x) for x in left], pa.int64()).cast(columns["n_chars"].type)
                    columns["n_chars"] = pc.if_else(marked.is_valid(), counted, columns["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    same = (docs["doc_id"] == marks[spare[0]]) & (F.xxhash64(docs["text"]) == marks[spare[1]])
    joined = docs.join(marks, same, "left")  # columns by their DataFrame: the caller's may have any name
    return joined.select(*[docs[c] for c in names], marks[spare[2]]).mapInArrow(run, schema)
