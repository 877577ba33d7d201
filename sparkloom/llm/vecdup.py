"""Embedding near-dedup: cosine links within a label, by int8 tile products with error bounds.

Equal vectors of a label count as one with a weight. The vectors of a label are dealt over tiles of
bounded size, written as one row each, and every pair of tiles is one row of work: vectors are rounded to
int8 with a scale each, tile products of the rounded vectors are exact, and each vector's own rounding error
bounds how far a product can lie from the truth. Only pairs that may reach the threshold are recomputed in double precision. A pair
returns link counts and at most one link per vector for the components, never its pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and vectors
without a label, link with nothing and stay. Vectors of different dimensions do not link. Other columns
are not read. Rows that share an id are one vector in the components, and their links add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise
from .topk import finite

THRESHOLD, TILE = 0.98, 4096
#: Rows of a tile that are multiplied at once.
STRIP = 256


def _usable(table: DataFrame) -> DataFrame:
    """(vec_id, label, v): little-endian doubles, null where the vector takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [x.astype("<f8").tobytes() if x is not None and x.any() else None for x in finite(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(blobs, pa.binary())], ["vec_id", "label", "v"])

    rows = table.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id long, label string, v binary").withColumn("v", F.when(F.col("label").isNotNull(), F.col("v")))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, lengths of the rounded vectors, and lengths of what rounding left out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 matrices: single precision holds sums over 1024 coordinates exactly."""
    out = np.zeros((len(a), len(b)), np.float64)
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y whose cosine reaches the threshold, for a strip of x at a time."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, lx, ex), (qy, sy, ly, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    for top in range(0, len(x), STRIP):
        part = slice(top, top + STRIP)
        near = int8_product(qx[part], qy)
        near *= sx[part, None] * sy[None, :]
        near += lx[part, None] * ey[None, :]
        near += ex[part, None] * (ly + ey)[None, :]
        i, j = np.nonzero(near >= threshold - 1e-9)
        i += top
        keep = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            u, w = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            keep[a : a + (1 << 16)] = np.einsum("ij,ij->i", x[u], y[w]) / (nx[u] * ny[w]) >= threshold
        yield i[keep], j[keep]


def _group(ids: np.ndarray, weights: np.ndarray, sides: np.ndarray, v: np.ndarray, same: bool, threshold: float) -> pa.RecordBatch:
    left = np.flatnonzero(sides == 0)
    right = left if same else np.flatnonzero(sides == 1)
    order = np.argsort(ids)
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))
    links, parent = np.zeros(len(ids)), np.arange(len(ids))
    for i, j in tile_links(v[left], v[right], threshold):
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        links += np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
        a, b = place[i], place[j]
        while True:  # smallest place wins, links and jumps in turn, until nothing changes
            before = parent.copy()
            low = np.minimum(parent[a], parent[b])
            np.minimum.at(parent, parent[a], low)
            np.minimum.at(parent, parent[b], low)
            parent = parent[parent]
            if (parent == before).all():
                break
    moved = np.flatnonzero(parent != np.arange(len(ids)))
    hit = np.flatnonzero(links)
    columns = (np.append(ids[hit], ids[order][moved]), np.append(links[hit], np.zeros(len(moved))).astype(np.int64), np.append(ids[hit], ids[order][parent[moved]]))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "n", "b"])


def _blocks(reps: DataFrame, tile: int) -> DataFrame:
    """(label, dim, own, tiles, ids, weights, vs): the vectors of a label in blocks of about `tile`, one row
    each, numbered below `tiles`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        names = ("label", "dim", "own", "tiles")
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())

        def out() -> pa.RecordBatch:
            ids, weights, vs = zip(*rows, strict=True)
            blobs = (np.array(ids, "<i8").tobytes(), np.array(weights, "<i8").tobytes(), b"".join(vs))
            return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(key, kinds, strict=True)), *(pa.array([b], pa.binary()) for b in blobs)], [*names, "ids", "weights", "vs"])

        for batch in batches:
            for *k, rep, weight, v in zip(*(batch.column(c).to_pylist() for c in (*names, "rep", "weight", "v")), strict=True):
                if k != key:
                    if rows:
                        yield out()
                    key, rows = k, []
                rows.append((rep, weight, v))
        if rows:
            yield out()

    # Written first, so that the rows of a label that holds many of them can be split.
    count = materialise(reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "tiles")
    dealt = reps.join(count, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.select("label", "dim", "own", "tiles", "rep", "weight", "v").repartition("label", "dim", "own").sortWithinPartitions("label", "dim", "own")
    return dealt.mapInArrow(run, "label string, dim int, own int, tiles int, ids binary, weights binary, vs binary")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id): vectors linked directly, and the smallest id links reach."""
    rows = materialise(_usable(table), "usable")
    good = rows.where("v IS NOT NULL").withColumn("dim", F.length("v"))
    key = ["label", "dim", "v"]
    reps = materialise(good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "reps")
    blocks = materialise(_blocks(reps, tile), "blocks")
    pairs = blocks.select("label", "dim", F.col("own").alias("lo"), F.explode(F.expr("sequence(own, tiles - 1)")).alias("hi"))
    for side in ("lo", "hi"):
        pairs = pairs.join(blocks.select("label", "dim", F.col("own").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("ids", "weights", "vs")]), ["label", "dim", side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind, i=i, batch=batch: np.frombuffer(batch.column(name)[i].as_py(), kind)
                same = batch.column("lo")[i].as_py() == batch.column("hi")[i].as_py()
                sides = ("lo",) if same else ("lo", "hi")
                ids, weights, v = (np.concatenate([get(f"{s}_{c}", k) for s in sides]) for c, k in (("ids", "<i8"), ("weights", "<i8"), ("vs", "<f8")))
                number = np.repeat(range(len(sides)), [len(get(f"{s}_ids", "<i8")) for s in sides])
                yield _group(ids, weights.astype(float), number, v.reshape(len(ids), -1), same, threshold)

    wanted = ["lo", "hi", *[f"{s}_{c}" for s in ("lo", "hi") for c in ("ids", "weights", "vs")]]
    found = materialise(pairs.select(*wanted).mapInArrow(run, "a long, n long, b long"), "tiles")
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    reach = components(found.where("n = 0").select("a", "b")).withColumnRenamed("id", "rep")
    whole = reps.join(links, "rep", "left").join(reach, "rep", "left")
    whole = whole.select(*key, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(whole, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)
