"""Helpers that the operators share: shared folder, folds, text buffers, hashing, components."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.steps import discard, materialise

__all__ = ["discard", "materialise"]

# --- Spark side -------------------------------------------------------------------------------


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that decides what is held out."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others of a caller's table never meet an operator's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# --- Arrow batches to numpy -------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings end to end, and the n + 1 offsets of the strings; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system: Spark keeps its Python workers for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `most` bytes of text each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(text))[1])
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
        del batch
        give_back()


def filtered(docs: DataFrame, judge: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of docs that judge accepts, batch by batch, with all columns and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(judge(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# --- Words and hashes -------------------------------------------------------------------------

#: The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_WORD = np.ones(256, bool)
IS_WORD[list(WHITE)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: An odd multiplier.
BASE = 0x9E3779B97F4A7C15
#: Spans of more bytes are digested one by one; shorter ones are mixed eight bytes at a time.
LANES = 64
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def lanes(data: np.ndarray, spare: bool = False) -> np.ndarray:
    """The eight bytes from every position of data on as one little-endian number; zeros follow the end. Data
    with eight spare bytes at its end is read as it stands, without a copy."""
    padded = data if spare else np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: equal bytes give equal hashes wherever they stand. Every eight
    bytes go through a mixing that is not linear, and long spans through a cryptographic digest, so that no
    family of texts is known to collide."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * np.uint64(BASE))
    word = lanes(data)
    live = np.flatnonzero((size > 0) & (size <= LANES))
    at, left = start[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (word[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def equal_spans(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray, spare: bool = False) -> np.ndarray:
    """Whether the `size` bytes of a and of b from each pair of starts on are the same; spare tells that b has
    eight spare bytes at its end."""
    same = np.ones(len(size), bool)
    wa, wb = lanes(a), lanes(b, spare)
    live = np.flatnonzero((size > 0) & (size <= LANES))
    x, y, left = a_start[live], b_start[live], size[live]
    while len(live):
        ok = ((wa[x] ^ wb[y]) & _MASK[np.minimum(left, 8)]) == 0
        same[live[~ok]] = False
        ok &= left > 8
        live, x, y, left = live[ok], x[ok] + 8, y[ok] + 8, left[ok] - 8
    for i in np.flatnonzero(size > LANES).tolist():
        same[i] = a[a_start[i] : a_start[i] + size[i]].tobytes() == b[b_start[i] : b_start[i] + size[i]].tobytes()
    return same


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number of the `size` bytes from every position on, equal for equal bytes. Different grams may
    share one: it chooses and groups, and never tells that bytes are equal."""
    n = len(data) - size + 1
    word, out = lanes(data), np.full(n, size, np.uint64)
    for k in range(0, size, 8):
        out += word[k : k + n] & _MASK[min(size - k, 8)]
        out *= np.uint64(BASE)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


#: The prime 2**31 - 1 and two random bases: spans that overlap are hashed from prefix sums.
PRIME = (1 << 31) - 1
_BASES = (1083814273, 402961682)
_BYTE = np.random.default_rng(20240501).integers(1, PRIME, (2, 256), dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo the prime."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in 0 ... prime, both ends standing for zero."""
    return _folded(_folded(_folded(x)))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo the prime, for i below at least n."""
    if len(_powers.get(base, ((),))[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, PRIME)):
            out, have = np.ones(size, np.uint64), 1
            while have < size:
                out[have : 2 * have] = _reduced(out[:have] * np.uint64(pow(b, have, PRIME)))
                have *= 2
            tables.append(out)
        _powers[base] = tuple(tables)
    return _powers[base]


def rolling_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As hash_spans, for many overlapping spans in order of their starts: polynomials modulo a prime at
    two random bases, so that two different spans of n bytes meet with a chance below (n / 2**31) ** 2."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):  # a stretch at a time: the tables of powers stay small
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, low + (1 << 20))))
        part = data[low : int(end[i:j].max())]
        a, b = start[i:j] - low, end[i:j] - low
        for k, base in enumerate(_BASES):
            up, down = _power_tables(base, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_folded(np.take(_BYTE[k], part) * up[: len(part)]), out=sums[1:])
            h = _reduced(_folded(sums[b] - sums[a]) * down[a])
            h[h == PRIME] = 0
            out[i:j] |= h << np.uint64(31 * k)
        i = j
    return mix(out ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = np.take(IS_WORD, data)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    edge = inner[(inner > 0) & (inner < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of k consecutive word hashes of each text, sorted, and their offsets. A
    text with fewer words gives its whole sequence as one; a text without words gives none."""
    out, offs = [], np.zeros(len(at), np.int64)
    n = len(words)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    c = np.uint64(BASE)
    for i in range(k if len(full) else 0):
        full = full * c + words[i : n - k + 1 + i]
    full = mix(full)
    for d in range(len(at) - 1):
        a, b = int(at[d]), int(at[d + 1])
        if b - a >= k:
            u = np.unique(full[a : b - k + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for i in range(a, b):
                h = h * c + words[i : i + 1]
            u = mix(h + np.uint64(b - a))
        else:
            u = words[:0]
        out.append(u)
        offs[d + 1] = offs[d] + len(u)
    return (np.concatenate(out) if out else words[:0]), offs


class HashIndex:
    """64-bit keys to their positions, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        self._build()

    def _build(self) -> None:
        self.bits = max(4, int(2 * len(self.keys) + 1).bit_length() + 1)
        self.mask = np.int64((1 << self.bits) - 1)
        self.slot = np.full(1 << self.bits, -1, np.int32 if len(self.keys) < 1 << 30 else np.int64)
        self._insert(np.arange(len(self.keys)))

    def _insert(self, todo: np.ndarray) -> None:
        at = self._home(self.keys[todo])
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            held = self.slot[at]
            lost = (held != todo) & (self.keys[held] != self.keys[todo])
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def add(self, keys: np.ndarray) -> None:
        """Append keys that are not there yet."""
        n = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.slot):
            self._build()
        else:
            self._insert(np.arange(n, len(self.keys)))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where there is none."""
        at = self._home(keys)
        out = self.slot[at].astype(np.int64)
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.slot[at[todo]].astype(np.int64)
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        return out


# --- Connected components ---------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within a task: its links become at most one link per node, to the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        rows = [(v, r) for v in list(parent) if (r := root(v)) != v]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory: links may leave early, later rounds join them
            yield flush()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of links (a long, b long): component is the smallest id that
    links reach. Alternating large-star and small-star rounds, with a union-find in every task
    before; a node's many links meet only in combinable minima, which are written before the links join
    them: Spark splits a hot key only between plain tables. A round's tables go when the next one stands."""
    edges = materialise(pick(links, "a", "b").mapInArrow(_forest, "a long, b long"), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = materialise(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "low")
        small = large.join(low, large.a == low.u)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).where("a <> b").distinct()
        small = materialise(small, "small")
        discard(edges, least, large, low)
        edges = small
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = state
