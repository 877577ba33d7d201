"""Vectors as whole numbers: what the quantiser and the clustering read, and exact sums of them.

A component x becomes floor(scale * x), with x as double, held within ±2**53: beyond it squared distances
leave a long in any case. Sums travel as two longs, `high * 2**32 + low`, so that no table size overflows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The largest component.
HELD = 1 << 53
#: The largest long: distances and their sums are held there.
LONG = (1 << 63) - 1
LIMB = 32


def finite_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for every length of the vectors that are not null and whose components are all
    neither null nor non-finite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.where(np.asarray(column.is_valid()), np.diff(np.asarray(column.offsets)), -1)
    values = column.values.cast(pa.float64())
    flat = np.asarray(values.fill_null(np.nan)) if values.null_count else np.asarray(values)
    start = np.asarray(column.offsets)[:-1]
    for dim in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = flat[start[at][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -HELD, HELD).astype(np.int64)


def whole_vectors(table: DataFrame, scale: int, name: str, dim: int | None = None) -> DataFrame:
    """(vec_id, label, dim, v): the usable rows, written, with v as little-endian longs; only those of `dim`
    components where it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite_rows(batch.column("embedding")):
                if dim is None or x.shape[1] == dim:
                    raw = np.ascontiguousarray(whole(x, scale).astype("<i8"))
                    places = pa.array(at)
                    blobs = pa.array([r.tobytes() for r in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(places), batch.column("label").take(places), pa.array(np.full(len(at), x.shape[1], np.int32)), blobs], ["vec_id", "label", "dim", "v"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return materialise(rows.mapInArrow(run, "vec_id long, label string, dim int, v binary"), name)


def matrix(blobs: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of blobs, one row each."""
    return np.frombuffer(b"".join(blobs.to_pylist()), "<i8").reshape(len(blobs), dim)


def reach(x: np.ndarray) -> int:
    """The largest magnitude."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def expanded(x: np.ndarray, c: np.ndarray, kind: type) -> np.ndarray:
    """|x|² - 2 x·c + |c|² for all rows of x and of c, in numbers of `kind`."""
    x, c = x.astype(kind), c.astype(kind)
    out = x @ c.T
    out *= -2
    out += (x * x).sum(axis=1)[:, None]
    out += (c * c).sum(axis=1)[None, :]
    return out


def limbs(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as (high, low), total = high * 2**32 + low."""
    return (total >> LIMB).astype(np.int64), (total & ((1 << LIMB) - 1)).astype(np.int64)


def joined(high, low) -> int:
    return (int(high) << LIMB) + int(low)


def held(total: int) -> int:
    """A sum of distances as a long."""
    return min(total, LONG)
