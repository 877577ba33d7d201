"""Centroid clustering of whole-number vectors, exact at any table size.

Distances to all centroids are computed block by block as |x|² - 2 x·c + |c|² by BLAS in doubles, which is exact
while every value stays below 2**53; a block that could leave that range is computed in whole numbers. A task
reduces its vectors to one sum a centroid, an RDD's treeAggregate combines the sums, and the driver, which holds
only the centroids, replaces each by the floor of the mean.

Defined cases: only vectors of exactly `dim` components take part, none of them null or non-finite; the others
have no row. Centroids start from the rows with the smallest digests of a seed and their id; rows without an id
come last, ties, as in repeated rows, go by the vector, and repeated rows count as often as they occur. With
fewer rows than centroids there are fewer centroids. A vector goes to the smaller number among equally near
centroids; a centroid without vectors stays. Distances and their sums beyond a long are held at its end. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .whole import LIMB, LONG, expanded, held, joined, limbs, matrix, reach, whole_vectors

CENTROIDS, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024, 64, 3
#: Rows whose distances are computed at once.
BLOCK = 8192
#: Doubles hold whole numbers below it.
DOUBLE = 1 << 53


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every row's nearest centroid, the first among equals."""
    # Every intermediate value lies below dim * (largest component + largest centroid's)².
    most = max(x.shape[1], 1) * (reach(x) + reach(centres)) ** 2
    far = expanded(x, centres, np.float64 if most < DOUBLE else np.int64 if most <= LONG else object)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(a, BLOCK)
            yield rows, matrix(rows.column("v"), dim)


def _merged(a: tuple, b: tuple) -> tuple:
    """Counts and sums of two parts of the table; the low parts never grow beyond 2**32."""
    low = a[2] + b[2]
    return a[0] + b[0], a[1] + b[1] + (low >> LIMB), low & ((1 << LIMB) - 1)


def sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, high, low) of the vectors nearest to each centroid and of their components."""
    k, dim = centres.shape
    blank = (np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = blank
        for _, x in _blocks(batches, dim):
            at = nearest(x, centres)[0]
            pick = np.arange(k)[:, None] == at  # (k, rows): sums as a product, in whole numbers
            up, down = limbs(x)
            whole = _merged(whole, (pick.sum(axis=1), pick.astype(np.int64) @ up, pick.astype(np.int64) @ down))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([s.ravel() for s in whole]).astype("<i8").tobytes()], pa.binary())], ["sums"])

    def opened(row) -> tuple:
        flat = np.frombuffer(bytes(row.sums), "<i8")
        return flat[:k], flat[k : k + k * dim].reshape(k, dim), flat[k + k * dim :].reshape(k, dim)

    return rows.select("v").mapInArrow(run, "sums binary").rdd.map(opened).treeAggregate(blank, _merged, _merged)


def first(rows: DataFrame, centroids: int, dim: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest digests."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    head = rows.select("v", order.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(centroids).collect()
    return np.frombuffer(b"".join(bytes(r.v) for r in head), "<i8").reshape(len(head), dim)


def learned(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The centroids after all rounds, of rows (vec_id, v)."""
    centres = first(rows, centroids, dim, seed)
    for _ in range(rounds if len(centres) else 0):
        count, high, low = sums(rows, centres)
        after = centres.copy()
        for c in np.flatnonzero(count).tolist():
            after[c] = [joined(h, w) // int(count[c]) for h, w in zip(high[c], low[c], strict=True)]
        if (after == centres).all():  # nothing moves in any later round either
            break
        centres = after
    return centres


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, x in _blocks(batches, dim):
            at, far = nearest(x, centres)
            far = [held(int(d)) for d in far] if far.dtype == object else far.astype(np.int64)
            yield pa.RecordBatch.from_arrays([found.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(table: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of a table (vec_id, embedding)."""
    rows = whole_vectors(table.withColumn("label", F.lit(None)), scale, "vectors", dim)
    centres = learned(rows, centroids, rounds, dim, seed)
    found = materialise(assigned(rows, centres), "assigned")
    parts = found.groupBy("cluster").agg(F.sum(F.shiftright("distance", LIMB)).alias("high"), F.sum(F.col("distance").bitwiseAND(F.lit((1 << LIMB) - 1))).alias("low"))
    per = {r["cluster"]: joined(r["high"], r["low"]) for r in parts.collect()}  # one row a centroid
    inertia, sha = F.lit(0).cast("long"), F.lit(None).cast("string")
    for c, centre in enumerate(centres):
        own = F.col("cluster") == c
        inertia = F.when(own, F.lit(held(per.get(c, 0))).cast("long")).otherwise(inertia)
        sha = F.when(own, hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()).otherwise(sha)
    total = F.lit(held(sum(per.values()))).cast("long").alias("inertia")
    return found.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), total, sha.alias("centroid_sha256"))
