"""Best-fit packing: documents of token ids into as few sequences of bounded length as possible.

A document is its ids plus one end id. One longer than the capacity is cut into pieces of the capacity;
its first piece may be shorter. Packing needs only how many pieces have each length, at most `capacity`
numbers: best-two-fit fills a bin greedily with the longest piece that fits, then replaces its smallest
piece by two others that together fill the gap more tightly, as long as that helps. The same bin is
repeated while its lengths last, so the plan's size depends on the capacity and not on the corpus. Tasks
number the pieces of each length, and the number decides the place in the plan.

Defined cases: a null or empty text is a document of the end id alone. Equal documents are packed each.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import materialise, pick, pieces, utf8

CAPACITY, END = 1024, 2


@lru_cache(maxsize=2)
def tokenizer_encoder(path: str) -> Encoder:
    """An encoder whose new pieces go through the tokenizers file at `path`."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(found: list[bytes]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(found), 2048):  # an encoding holds far more than its ids
            out += [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast([p.decode() for p in found[a : a + 2048]], add_special_tokens=False)]
        return out

    return Encoder(encode)


def tokenised(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """One row per piece. `part` and `nth` number the pieces of equal length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_encoder(path)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in pieces(batches):
            ids, at = encode(*utf8(batch.column("text")))
            ids = np.insert(ids.astype("<u4"), at[1:], end)
            size = np.diff(at) + 1
            at = np.append(0, np.cumsum(size))
            raw = ids.tobytes()
            count = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            head = size - (count - 1) * capacity
            start = np.where(piece > 0, head[owner] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[owner])
            a = 4 * (at[:-1][owner] + start)
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            doc = batch.column("doc_id").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64)), pa.array(np.full(len(owner), part)), pa.array(nth)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times) from counts[length], length up to the capacity len(counts) - 1."""
    left, capacity, plan = counts.astype(np.int64).copy(), len(counts) - 1, []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        taken: list[int] = []
        gap, longest = capacity, int(there[-1])
        while gap > 0:
            fits = np.flatnonzero(left[: min(gap, longest) + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            times = int(min(left[n], gap // n))
            taken += [n] * times
            left[n] -= times
            gap -= n * times
        while gap > 0 and taken and (better := _two_for(left, taken[-1], gap)):
            gap += taken[-1] - sum(better)
            left[taken.pop()] += 1
            for n in better:
                left[n] -= 1
                taken.append(n)
            taken.sort(reverse=True)
        uses = np.bincount(taken, minlength=capacity + 1)
        used = uses > 0
        times = 1 + int((left[used] // uses[used]).min())
        left -= uses * (times - 1)
        plan.append((taken, times))


def _two_for(left: np.ndarray, smallest: int, gap: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill gap + smallest most tightly, if better than `smallest`."""
    for total in range(min(gap + smallest, len(left) - 1), smallest, -1):
        half = total // 2
        small, large = left[1 : half + 1] > 0, left[total - half : total][::-1] > 0
        ok = small & large
        if total % 2 == 0:
            ok[half - 1] = left[half] > 1
        found = np.flatnonzero(ok)
        if len(found):
            return int(found[-1]) + 1, total - int(found[-1]) - 1
    return None


def slots(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first number, pieces a bin, first bin, offset in the bin): where a piece of that
    length goes by its number among its equals."""
    out: dict[int, list] = {}
    met: dict[int, int] = {}
    bins = 0
    for taken, times in plan:
        offset = 0
        for n in dict.fromkeys(taken):
            k = taken.count(n)
            out.setdefault(n, []).append((met.get(n, 0), k, bins, offset))
            met[n] = met.get(n, 0) + k * times
            offset += k * n
        bins += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    rows = materialise(tokenised(docs, path, capacity, end), "pieces")
    per_task = materialise(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    places = slots(best_two_fit(counts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows_ = np.flatnonzero(length == n)
                table = places[n]
                at = table[np.searchsorted(table[:, 0], number[rows_], side="right") - 1]
                inside = number[rows_] - at[:, 0]
                sequence[rows_] = at[:, 2] + inside // at[:, 1]
                offset[rows_] = at[:, 3] + inside % at[:, 1] * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return rows.join(base, ["length", "part"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
