"""Vector code compression: a vector becomes one codebook entry's number for each of its parts.

Vectors are whole numbers, cut into equal consecutive parts, with a codebook for each part. The codebooks are
small and go to all tasks; an Arrow batch computes all distances of a part at once by the expansion
|x|² - 2 x·c + |c|² with exact products of longs, and the first smallest distance decides. A task adds up what
falls to each entry; a grouped shuffle merges these sums, and the driver, which holds only the codebooks,
replaces each entry by the floor of the mean. Sums are exact at any table size.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; an empty vector has
an empty part everywhere and no error. Vectors of each length have codebooks of their own; a length that
the parts don't divide is filled up with zeros. With fewer rows than entries the codebooks are shorter. Codebooks
start from the smallest vec_ids, null ones last, and ties, as in repeated rows, go by the vector; repeated rows
count as often as they occur. Errors beyond a long are held at its end. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .whole import LIMB, LONG, expanded, held, joined, limbs, matrix, reach, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows whose distances are computed at once.
BLOCK = 1 << 14


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as (row, part, component)."""
    width = -(-x.shape[1] // parts)
    full = np.zeros((len(x), parts * width), np.int64)
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row's nearest entry, the first among equals."""
    # Every intermediate value lies below 4 * width * (largest magnitude)².
    kind = np.int64 if 4 * max(x.shape[1], 1) * max(reach(x), reach(book)) ** 2 <= LONG else object
    far = expanded(x, book, kind)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, dim, parts of their vectors) of one length at a time."""
    for batch in batches:
        for dim in sorted(set(batch.column("dim").to_pylist())):
            found = batch.filter(pa.compute.equal(batch.column("dim"), dim)) if batch.num_rows else batch
            for a in range(0, found.num_rows, BLOCK):
                rows = found.slice(a, BLOCK)
                yield rows, dim, cut(matrix(rows.column("v"), dim), parts)


def _first(rows: DataFrame, entries: int, parts: int) -> dict[int, np.ndarray]:
    """The codebooks, (part, entry, component) for each length, of the smallest ids."""
    out = {}
    for (dim,) in rows.select("dim").distinct().orderBy("dim").collect():  # lengths, not rows
        head = rows.where(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        out[dim] = cut(np.frombuffer(b"".join(bytes(r.v) for r in head), "<i8").reshape(len(head), dim), parts).transpose(1, 0, 2)
    return out


def _sums(rows: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(dim, part, entry, at, n, high, low): how many parts fall to an entry, and their component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {d: np.zeros(b.shape[:2], np.int64) for d, b in books.items()}
        high, low = ({d: np.zeros(b.shape, np.int64) for d, b in books.items()} for _ in range(2))
        for _, dim, x in _blocks(batches, len(next(iter(books.values())))):
            for p, book in enumerate(books[dim]):
                at = nearest(x[:, p], book)[0]
                up, down = limbs(x[:, p])
                count[dim][p] += np.bincount(at, minlength=len(book))
                np.add.at(high[dim][p], at, up)
                np.add.at(low[dim][p], at, down)
                high[dim][p] += low[dim][p] >> LIMB
                low[dim][p] &= (1 << LIMB) - 1
        for dim, b in books.items():
            # An empty part has one row for its count.
            part, entry, at = (g.ravel() for g in np.meshgrid(*(np.arange(max(k, 1)) for k in b.shape), indexing="ij"))
            blank = np.zeros(len(at), np.int64)
            sums = (high[dim].ravel(), low[dim].ravel()) if b.size else (blank, blank)
            columns = [np.full(len(at), dim, np.int32), part.astype(np.int32), entry.astype(np.int32), at.astype(np.int32), count[dim][part, entry], *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "part", "entry", "at", "n", "high", "low"])

    found = rows.select("dim", "v").mapInArrow(run, "dim int, part int, entry int, at int, n long, high long, low long")
    return found.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def learned(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """The codebooks after all rounds, (part, entry, component) for each length, of rows (vec_id, dim, v)."""
    books = _first(rows, entries, parts)
    for _ in range(rounds if books else 0):
        after = {d: b.copy() for d, b in books.items()}
        for r in _sums(rows, books).where("n > 0").collect():  # as many rows as the codebooks hold numbers
            if after[r["dim"]].shape[2]:
                after[r["dim"]][r["part"], r["entry"], r["at"]] = joined(r["high"], r["low"]) // r["n"]
        books = after
    return books


def coded(rows: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, label, dim, code, error): each vector's entries, two hex digits a part, and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, dim, x in _blocks(batches, len(next(iter(books.values()))) if books else 1):
            at, far = zip(*(nearest(x[:, p], book) for p, book in enumerate(books[dim])), strict=True)
            codes = [r.tobytes().hex() for r in np.stack(at, axis=1).astype(np.uint8)]
            if any(f.dtype == object for f in far):
                error = [held(sum(int(v) for v in row)) for row in zip(*far, strict=True)]
            else:
                error = np.minimum(sum(f.astype(np.float64) for f in far), LONG)  # only tells where a sum leaves a long
                error = sum(far) if error.max(initial=0) < LONG / 2 else [held(sum(map(int, row))) for row in zip(*far, strict=True)]
            yield pa.RecordBatch.from_arrays([found.column("vec_id"), found.column("label"), found.column("dim"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "dim", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label string, dim int, code string, error long")


def fingerprint(book: np.ndarray) -> str:
    """sha256 of all numbers of the codebooks of one length."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of a table (vec_id, embedding, label). At most 256
    entries, as a code has two hex digits a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds 1 to 256 entries")
    rows = whole_vectors(table, scale, "vectors")
    books = learned(rows, parts, entries, rounds)
    codes = materialise(coded(rows, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    # Written, so that the join's side of vectors can be split where a label holds many of them.
    labels = materialise(codes.groupBy("label").agg(F.least(total, F.lit(LONG)).cast("long").alias("label_error")), "labels")
    sha = F.lit(None).cast("string")
    for dim, book in books.items():
        sha = F.when(F.col("dim") == dim, fingerprint(book)).otherwise(sha)
    found = codes.alias("c").join(labels.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return found.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
