"""Exact top-k search by inner product, on vectors turned into integers.

Vectors are cut into blocks in order of falling length. A query block is compared with a candidate block
in chunks, longest vectors first. Coordinates are rotated by the singular vectors of the whole table, so
that the first few carry most of every product: their partial sum plus the product of the residual
lengths (Cauchy-Schwarz) bounds the score, and only what may still reach the k-th best score so far is
computed in full, in exact integers. A small head of longest vectors gives every query a first k-th score.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, neither
as query nor as candidate. Only vectors of one dimension meet. Equal scores go to the smaller id. Scores
beyond a long are held at its ends. Other columns are not read; equal vectors are candidates each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick

#: Vectors in a block of candidates and of queries, in a chunk, and in the head.
BLOCK, QUERIES, CHUNK, HEAD = 8192, 4096, 1024, 1024
#: Coordinates in the partial sums.
PART = 16
#: Classes of length in an octave, and parts of a class, by which query blocks meet candidate blocks.
STEPS, PARTS = 16, 64


def finite(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, None where it takes no part."""
    out = []
    for v in column:
        x = v.values if v.is_valid else None
        ok = x is not None and len(x) > 0 and x.null_count == 0
        a = np.asarray(x.to_numpy(zero_copy_only=False), np.float64) if ok else None
        out.append(a if ok and np.isfinite(a).all() else None)
    return out


def integers(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dim, norm, v): floor(scale * x) as little-endian doubles that hold whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, np.floor(scale * x)) for i, x in zip(batch.column("vec_id").to_pylist(), finite(batch.column("embedding")), strict=True) if x is not None]
            rows = [(i, x) for i, x in rows if np.isfinite(x).all()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int32()), pa.array([float(np.linalg.norm(x)) for _, x in rows], pa.float64()), pa.array([x.astype("<f8").tobytes() for _, x in rows], pa.binary())], ["vec_id", "dim", "norm", "v"])

    return pick(table, "vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, norm double, v binary")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dim)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of one dimension, from a Gram matrix that tasks add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dim)
            x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(gram.ravel())], ["at", "g"])

    cells = rows.select("v").mapInArrow(run, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).toPandas()
    gram = np.zeros(dim * dim)
    gram[cells["at"]] = cells["g"]
    gram = gram.reshape(dim, dim)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def blocks(rows: DataFrame, count: int, most: int, name: str) -> DataFrame:
    """(block, n, longest, ids, vs): blocks of at most `most` vectors in order of falling length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, norms, vs = TaskContext.get().partitionId(), 0, [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([len(ids)]), pa.array([norms[0]]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(vs)], pa.binary())], ["block", "n", "longest", "ids", "vs"])

        for batch in batches:
            for i, norm, v in zip(batch.column("vec_id").to_pylist(), batch.column("norm").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                norms.append(norm)
                vs.append(v)
                if len(ids) == most:
                    yield out()
                    seq, ids, norms, vs = seq + 1, [], [], []
        if ids:
            yield out()

    dealt = rows.repartitionByRange(max(1, -(-count // most)), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return materialise(dealt.select("vec_id", "norm", "v").mapInArrow(run, "block long, n long, longest double, ids binary, vs binary"), name)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as long: by doubles where all sums stay exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def search(qids: np.ndarray, q: np.ndarray, floor: np.ndarray, cids: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best among the candidates, of those that reach its
    floor; candidates come in order of falling length."""
    cut = min(PART, q.shape[1])
    # Doubles round; the slack is far above what they can lose, and the scores are recomputed exactly.
    slack = 1e-9
    qr, cr = q @ turn, c @ turn
    qlen, clen = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    qrest, crest = np.linalg.norm(qr[:, cut:], axis=1), np.linalg.norm(cr[:, cut:], axis=1)
    floor = floor.astype(np.float64).copy()
    best: list[list[tuple[int, int]]] = [[] for _ in qids]
    for a in range(0, len(cids), CHUNK):
        part = slice(a, a + CHUNK)
        live = np.flatnonzero(qlen * clen[a] * (1 + slack) + 1 >= floor)
        if not len(live):
            break
        bound = qr[live, :cut] @ cr[part, :cut].T + qrest[live, None] * crest[None, part]
        bound += slack * qlen[live, None] * clen[None, part] + 1
        maybe = bound >= floor[live, None]
        rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if not len(rows):
            continue
        score = exact_products(q[live[rows]], c[part][cols])
        ids = cids[part][cols]
        for r, values in zip(live[rows], score, strict=True):
            hit = np.flatnonzero((values >= floor[r]) & (ids != qids[r]))
            if not len(hit):
                continue
            if len(hit) > k:
                kth = np.partition(values[hit], len(hit) - k)[len(hit) - k]
                hit = hit[values[hit] >= kth]
            best[r] = sorted(best[r] + [(-int(values[h]), int(ids[h])) for h in hit])[:k]
            if len(best[r]) == k:
                floor[r] = max(floor[r], -best[r][-1][0])
    return [(int(i), v, -s) for i, found in zip(qids, best, strict=True) for s, v in found]


def top_k(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose vec_id is divisible by `every`."""
    rows = materialise(integers(table, scale), "vectors")
    out = None
    for dim, in rows.select("dim").distinct().orderBy("dim").collect():  # dimensions, not rows
        found = _of_dimension(rows.where(F.col("dim") == dim), dim, every, k)
        out = found if out is None else out.union(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _class(length: Column) -> Column:
    """Lengths in rising classes: a longer vector is never in a lower one."""
    return F.when(length < 1, 0).otherwise(1 + F.floor(STEPS * F.log2(F.greatest(length, F.lit(1.0))))).cast("int")


def _meetings(q: DataFrame, c: DataFrame) -> DataFrame:
    """(q, block) of all query blocks and the candidate blocks whose longest vector reaches their need. They
    meet by class of length; a class that most blocks share is split into parts."""
    part = F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int")
    held = c.select("block", "longest", _class(F.col("longest")).alias("class"), part.alias("part"))
    low = F.greatest(_class(F.col("need")) - 1, F.lit(0))
    top = held.agg(F.coalesce(F.max("class"), F.lit(0))).first()[0]
    asked = q.select("q", "need", low.alias("low")).where(F.col("low") <= top)
    asked = asked.select("q", "need", F.explode(F.sequence("low", F.lit(top))).alias("class"))
    asked = asked.select("q", "need", "class", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    return asked.join(held, ["class", "part"]).where("longest >= need").select("q", "block")


def _of_dimension(rows: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    turn = rotation(rows, dim)
    asked = F.col("vec_id") % every == 0
    n, nq = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    c = blocks(rows, n, BLOCK, "candidates")
    q = blocks(rows.where(asked), nq, QUERIES, "queries")
    head = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()  # at most HEAD vectors
    hids, hv = np.array([r.vec_id for r in head], np.int64), _matrix([bytes(r.v) for r in head], dim)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, longest = [], []
            for ids, vs in zip(batch.column("ids").to_pylist(), batch.column("vs").to_pylist(), strict=True):
                ids, v = np.frombuffer(ids, "<i8"), np.frombuffer(vs, "<f8").reshape(-1, dim)
                floor = np.full(len(ids), float(-(2**63)))
                found: dict[int, list[int]] = {}
                for i, _, s in search(ids, v, floor, hids, hv, turn, k):
                    found.setdefault(i, []).append(s)
                floors.append(np.array([min(found[i]) if len(found.get(i, ())) == k else floor[0] for i in ids.tolist()]))
                longest.append(np.linalg.norm(v, axis=1))
            # The least candidate length at which some query of the block can still reach its floor.
            need = [float(np.min(np.where(f <= 0, 0.0, (f - 2) / np.maximum(m * (1 + 1e-9), 1e-300)))) for f, m in zip(floors, longest, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(need), batch.column("ids"), batch.column("vs"), pa.array([f.astype("<f8").tobytes() for f in floors])], ["q", "need", "q_ids", "q_vs", "floors"])

    q = materialise(q.select("block", "ids", "vs").mapInArrow(start, "q long, need double, q_ids binary, q_vs binary, floors binary"), "floors")
    tiles = _meetings(q, c).join(c.select("block", "ids", "vs"), "block").join(q, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind, i=i, batch=batch: np.frombuffer(batch.column(name)[i].as_py(), kind)
                found = search(get("q_ids", "<i8"), get("q_vs", "<f8").reshape(-1, dim), get("floors", "<f8"), get("ids", "<i8"), get("vs", "<f8").reshape(-1, dim), turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))], ["query_id", "vec_id", "score"])

    return tiles.select("q_ids", "q_vs", "floors", "ids", "vs").mapInArrow(run, "query_id long, vec_id long, score long")
