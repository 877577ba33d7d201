"""Language-model scoring by context-tree weighting over bytes.

A text is a run of bytes and an end. Every symbol is split into binary decisions along a Huffman tree of the
training symbols, so that a frequent symbol takes few decisions, each of which costs a context something to
learn. Each decision is predicted in the context of the last `DEPTH` bytes: a node of a context
tree holds a Krichevsky-Trofimov estimate from its counts, and weighting mixes the estimates of all depths.
With counts taken once from the training texts, the weights follow from the counts alone, level by level,
and each context and symbol gets one fixed log probability.

How it is spread: tasks count grams (context and symbol) and words of chunks of texts; everything that
grows with the corpus (gram table, tree levels, word counts) is joined and summed as rows of DataFrames.
A chunk's different grams and words go to `PARTS` parts as packed, sorted numbers, are counted there, and later meet
the scores (of words: the counts) of their part, of which only the values go back, in the order of the numbers. A part
is read row by row and holds its different numbers, a chunk its own, so nothing is broadcast and memory follows neither
the number of chunks nor of documents. Only the 257 counts of the symbols reach the driver. Written tables go as soon as nothing reads them.

Beside the model stands a unigram base over lower-cased words and one end per text, with 0.1 added to
every count; words are told apart by 64-bit hashes.

Defined cases: a null or empty text is the end alone. Without training texts all counts are zero. Equal
texts count each. Other columns are not read.
"""

from __future__ import annotations

import heapq
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, HashIndex, discard, give_back, hash_spans, materialise, pick, pieces, utf8, word_spans

DEPTH = 5
#: Bytes of text in a chunk.
CHUNK = 1 << 24
#: Parts that grams are dealt over: a prime, so that neighbouring grams spread.
PARTS = 1021
#: What comes back of a gram is rounded to single precision (7 digits of its logarithm), of a word it is exact.
VALUES = {"g": np.float32, "w": np.float64}
#: Numbers that are held before equal ones are added up.
HELD = 1 << 20
#: A symbol beside the bytes: the end after a text, and what stands before one.
EDGE = 256
SYMBOLS = 257


def grams(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position of all texts as one number, and the offsets of the texts."""
    n = len(offs) - 1
    size = np.diff(offs)
    where = np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, size)
    line = np.full(len(data) + n * (depth + 1), EDGE, np.int64)
    line[where] = data
    at = np.append(0, np.cumsum(size + 1))
    mine = np.arange(at[-1]) + np.repeat(np.arange(n) * depth + depth, size + 1)
    out = line[mine - depth]
    for i in range(depth - 1, -1, -1):
        out = out * SYMBOLS + line[mine - i]
    return out, at


def _total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts), len(u)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: the first byte of each, the second of each, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    n, size = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[4:], size * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def in_parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys in order of their parts, and the PARTS + 1 offsets of the parts."""
    part = keys % PARTS
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(PARTS + 1))


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and counts with equal keys added up, once so many are held that it pays."""
    if sum(map(len, keys)) <= HELD + 2 * len(keys[0]):
        return keys, counts
    return tuple([x] for x in _total(keys, counts))


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, at = word_spans(data, offs)
    return hash_spans(np.take(LOWER, data), start, end).view(np.int64), at


def _chunks(docs: DataFrame, depth: int, folds: int, held: int, most: int) -> DataFrame:
    """One row per chunk (part -1): its texts and training totals; and one for each part of its grams (of 'g') and of its
    words (of 'w'): the different ones, as steps between sorted numbers, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def fresh() -> dict:
            sink = io.BytesIO()
            return {"sink": sink, "out": pa.ipc.new_stream(sink, schema, options=options), "bytes": 0, "g": ([], []), "w": ([], []), "ends": 0, "words": 0}

        def close(c: dict) -> Iterator[pa.RecordBatch]:
            c["out"].close()
            chunk = part << 32 | seq
            names = ["chunk", "part", "of", "keys", "n", "ends", "words", "docs"]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
            none = lambda i: pa.nulls(1, kinds[i])
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1], pa.int32()), none(2), none(3), none(4), pa.array([c["ends"]]), pa.array([c["words"]]), pa.array([c["sink"].getvalue()], pa.binary())], names)
            for of in ("g", "w"):
                keys, n = _total(*c.pop(of))
                order, at = in_parts(keys)
                keys, n = keys[order], n[order]
                held = np.flatnonzero(np.diff(at))
                blobs = [(pack(np.diff(keys[at[p] : at[p + 1]], prepend=0)), pack(n[at[p] : at[p + 1]])) for p in held.tolist()]
                rows = [pa.array(np.full(len(held), chunk)), pa.array(held.astype(np.int32)), pa.array([of] * len(held)), *(pa.array([b[k] for b in blobs], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(len(held), k) for k in kinds[5:])], names)
                del keys, n, order, blobs, rows
            give_back()

        c = fresh()
        for batch in pieces(batches):
            data, offs = utf8(batch.column("text"))
            learn = np.array([zlib.crc32(str(i).encode()) % folds != held for i in batch.column("doc_id").to_pylist()])
            for kind, (keys, at) in (("g", grams(data, offs, depth)), ("w", _words(data, offs))):
                codes, u = pd.factorize(keys)
                train = np.repeat(learn, np.diff(at))
                c[kind][0].append(u)
                c[kind][1].append(np.bincount(codes, train, len(u)))
                c[kind] = _folded(*c[kind])
                if kind == "w":
                    c["words"] += int(train.sum())
            c["ends"] += int(learn.sum())
            c["out"].write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string())], schema=schema))
            c["bytes"] += len(data)
            if c["bytes"] >= most:
                yield from close(c)
                seq, c = seq + 1, fresh()
        if c["bytes"] or c["ends"] or c["g"][0]:
            yield from close(c)

    kinds = "chunk long, part int, of string, keys binary, n binary, ends long, words long, docs binary"
    return pick(docs, "doc_id", "text").mapInArrow(run, kinds)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers, by Stirling's series above 8."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n0, n1) -> (key, one, own): the estimate of a one and the log probability of the counts."""
    for batch in batches:
        n0, n1 = (batch.column(k).to_numpy().astype(float) for k in ("n0", "n1"))
        own = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array((n1 + 0.5) / (n0 + n1 + 1)), pa.array(own)], ["key", "one", "own"])


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of every symbol's decisions, one row a step, -1 beyond a symbol's last one: its way down the
    Huffman tree of the counts, each with one added. Nodes are numbered from the top, equal weights go by age."""
    heap = [(int(n) + 1, i, i) for i, n in enumerate(counts.tolist())]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}  # a subtree to its parent and its side
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        top = len(counts) + len(up) // 2
        up[x], up[y] = (top, 0), (top, 1)
        heapq.heappush(heap, (a + b, top, top))
    root = heap[0][2]
    ways = []
    for i in range(len(counts)):
        way, at = [], i
        while at in up:
            at, side = up[at]
            way.append((root - at, side))
        ways.append(way[::-1])
    out = np.full((2, max(map(len, ways), default=0), len(counts)), -1, np.int64)
    for i, way in enumerate(ways):
        for k, pair in enumerate(way):
            out[:, k, i] = pair
    return out[0], out[1]


def _path(batches: Iterator[pa.RecordBatch], node: np.ndarray, bit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, n) -> (gram, key, bit, n) of the decisions of its symbol; key is context and node."""
    for batch in batches:
        gram, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
        symbol, context = gram % SYMBOLS, gram // SYMBOLS
        parts = []
        for step in range(len(node)):
            live = np.flatnonzero(node[step][symbol] >= 0)
            if not len(live):
                break
            parts.append((gram[live], context[live] * 256 + node[step][symbol[live]], bit[step][symbol[live]].astype(np.int32), n[live]))
        columns = zip(*parts, strict=True) if parts else ([gram], [gram], [gram.astype(np.int32)], [n])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(x))) for x in columns], ["gram", "key", "bit", "n"])


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, p), written: log10 probability of each gram's symbol in its context, from all training counts n."""
    symbols = np.zeros(SYMBOLS, np.int64)
    for r in counts.groupBy((F.col("gram") % SYMBOLS).alias("symbol")).agg(F.sum("n").alias("n")).collect():  # 257 rows
        symbols[r["symbol"]] = r["n"]
    node, bit = decisions(symbols)
    steps = counts.mapInArrow(lambda batches: _path(batches, node, bit), "gram long, key long, bit int, n long")
    full = steps.groupBy("key").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    full = materialise(full, "counts")
    node_of = F.col("key") % 256
    shorter = lambda d: ((F.floor(F.col("key") / F.lit(256)).cast("long") % (SYMBOLS**d)) * 256 + node_of).alias("key")
    levels = {depth: full}
    for d in range(depth - 1, -1, -1):
        levels[d] = materialise(levels[d + 1].select(shorter(d), "n0", "n1").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
    tree, below = {}, None
    for d in range(depth, -1, -1):
        known = levels[d].mapInArrow(_estimates, "key long, one double, own double")
        if below is None:
            whole = known.withColumn("all", F.col("own")).withColumn("w", F.lit(1.0))
        else:
            kids = below.select(shorter(d), "all").groupBy("key").agg(F.sum("all").alias("kids"))
            top = F.greatest("own", "kids")
            both = top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("kids") - top))
            whole = known.join(kids, "key").withColumn("all", both - F.log(F.lit(2.0))).withColumn("w", F.exp(F.col("own") - both))
        tree[d] = below = materialise(whole.select("key", "one", "all", "w"), "tree")
        discard(levels.pop(d))
    mixed, last = tree[0].select("key", (F.col("w") * F.col("one")).alias("sum"), (1 - F.col("w")).alias("rest")), None
    for d in range(1, depth + 1):
        up = mixed.select(F.col("key").alias("up"), "sum", "rest")
        mixed = tree[d].withColumn("up", shorter(d - 1)).join(up, "up")
        mixed = mixed.select("key", (F.col("sum") + F.col("rest") * F.col("w") * F.col("one")).alias("sum"), (F.col("rest") * (1 - F.col("w"))).alias("rest"))
        mixed = materialise(mixed, "mixed")
        discard(tree.pop(d), *([last] if last is not None else []))
        last = mixed
    chosen = F.log10(F.when(F.col("bit") == 1, F.col("sum")).otherwise(1 - F.col("sum")))
    found = materialise(steps.join(mixed, "key").groupBy("gram").agg(F.sum(chosen).alias("p")), "scores")
    discard(*([last] if last is not None else []), *tree.values())
    return found


def _dealt(rows: DataFrame) -> DataFrame:
    """rows by part, one part after another; what comes first in a part has the smaller kind."""
    return rows.repartition("part").sortWithinPartitions("part", "kind")


def packed_counts(chunks: DataFrame, of: str, name: str) -> DataFrame:
    """(name, n) of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def out() -> pa.RecordBatch:
            keys, n = _total(*held)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], [name, "n"])

        for batch in batches:
            for part, keys, n in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "n")), strict=True):
                if part != at:
                    if at is not None:
                        yield out()
                    at, held = part, ([], [])
                held[0].append(np.cumsum(unpack(keys)))
                held[1].append(unpack(n))
                held = _folded(*held)
        if at is not None:
            yield out()
        give_back()

    rows = chunks.where(F.col("of") == of).select("part", F.lit(0).alias("kind"), "keys", "n")
    return _dealt(rows).mapInArrow(run, f"{name} long, n long")


def packed_values(chunks: DataFrame, of: str, known: DataFrame) -> DataFrame:
    """(chunk, part, of, values): what known (key, value) holds for a chunk's numbers of a part, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, values, order = None, [], [], None
        for batch in batches:
            part, kind, chunk = (np.asarray(batch.column(c)) for c in ("part", "kind", "chunk"))
            edge = np.append(0, np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1) if batch.num_rows else []
            for a, b in zip(edge, np.append(edge[1:], batch.num_rows).astype(int) if batch.num_rows else [], strict=True):
                if part[a] != at:
                    at, keys, values, order = part[a], [], [], None
                if kind[a] == 0:
                    keys.append(np.asarray(batch.column("key").slice(a, b - a)))
                    values.append(np.asarray(batch.column("value").slice(a, b - a)))
                    continue
                if order is None:
                    keys, values = np.concatenate(keys), np.concatenate(values)
                    order = np.argsort(keys)
                    keys, values = keys[order], values[order].astype(VALUES[of])
                blobs = [pack(values[np.searchsorted(keys, np.cumsum(unpack(g)))]) for g in batch.column("keys").slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[a:b].astype(np.int64)), pa.array(part[a:b].astype(np.int32)), pa.array([of] * (b - a)), pa.array(blobs, pa.binary())], ["chunk", "part", "of", "values"])

    own = known.select(F.pmod("key", F.lit(PARTS)).cast("int").alias("part"), F.lit(0).alias("kind"), "key", "value", F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("keys"))
    asked = chunks.where(F.col("of") == of).select("part", F.lit(1), F.lit(0).cast("long"), F.lit(0.0), "chunk", "keys")
    return _dealt(own.union(asked)).mapInArrow(run, "chunk long, part int, of string, values binary")


def scored(docs: DataFrame, depth: int = DEPTH, folds: int = 10, held: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row,
    learning from the rows outside the held-out fold. score counts the end of the text; bits_per_byte is
    the code length per byte, the end counted as one."""
    chunks = materialise(_chunks(docs, depth, folds, held, chunk), "chunks")
    whole = chunks.where("part < 0")
    table = materialise(packed_counts(chunks, "g", "gram"), "grams")
    p = gram_scores(table, depth)
    discard(table)
    words = materialise(packed_counts(chunks, "w", "word"), "words")
    kinds = words.where("n > 0").count()
    ends, seen = whole.agg(F.coalesce(F.sum("ends"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    tokens, kinds = ends + seen, kinds + (ends > 0)
    model = packed_values(chunks, "g", p.select(F.col("gram").alias("key"), F.col("p").alias("value")))
    model = model.union(packed_values(chunks, "w", words.select(F.col("word").alias("key"), F.col("n").cast("double").alias("value"))))
    model = materialise(model, "values")
    discard(p, words)
    own = whole.select(F.col("chunk").alias("of"), "docs")
    tasks = max(1, whole.count())  # a task reads about one chunk, however many there are

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        batches = [b for blob in left["docs"] for b in pa.ipc.open_stream(blob)]
        met, spoken = {"g": [], "w": []}, []
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            spoken.append(_words(data, offs))
            for of, keys in (("g", grams(data, offs, depth)[0]), ("w", spoken[-1][0])):
                met[of].append(pd.unique(keys))
                if sum(map(len, met[of])) > HELD + 2 * len(met[of][0]):
                    met[of] = [np.unique(np.concatenate(met[of]))]
        find, values = {}, {}
        for of, found in met.items():
            mine = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            find[of] = HashIndex(mine[in_parts(mine)[0]].view(np.uint64))
            blobs = right[right["of"] == of].sort_values("part")["values"]
            values[of] = np.concatenate([unpack(b, VALUES[of]) for b in blobs]).astype(np.float64) if len(blobs) else np.zeros(0)
        base = lambda c: np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        out = []
        for batch, (w, wa) in zip(batches, spoken, strict=True):
            data, offs = utf8(batch.column("text"))
            g, ga = grams(data, offs, depth)
            logs = np.append(0.0, np.cumsum(values["g"][find["g"].find(g.view(np.uint64))]))
            c = values["w"][find["w"].find(w.view(np.uint64))]
            sums = np.append(0.0, np.cumsum(base(c)))
            known = np.append(0, np.cumsum(c > 0))
            score = logs[ga[1:]] - logs[ga[:-1]]
            out.append(pd.DataFrame({"doc_id": batch.column("doc_id").to_pylist(), "n_tokens": np.diff(wa) + 1, "n_known": known[wa[1:]] - known[wa[:-1]] + (ends > 0), "train_tokens": tokens, "base_score": sums[wa[1:]] - sums[wa[:-1]] + base(ends), "score": score, "n_bytes": np.diff(offs), "bits_per_byte": -score * np.log2(10) / (np.diff(offs) + 1)}))
        done = pd.concat(out)
        del batches, met, spoken, find, values, out
        give_back()
        return done

    kinds_out = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    own, model = own.repartition(tasks, "of"), model.repartition(tasks, "chunk")
    return own.groupBy("of").cogroup(model.groupBy("chunk")).applyInPandas(run, kinds_out)
