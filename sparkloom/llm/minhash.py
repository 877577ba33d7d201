"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds its distinct shingles of k consecutive words; two documents are linked if
intersection / union of their sets reaches the threshold. `classes` gives every document the smallest
id that links reach; `keep_first` keeps one document of each class.

Defined cases: a null, empty or blank text has an empty set, links with nothing and stays. A text with
fewer words than k has its whole word sequence as one shingle. Documents with equal sets form one class
before anything is compared, so copies never multiply. Rows that share an id each
belong to the class of their own set. Other columns of the table are not read.

How exactness and skew go together: each class of equal sets sends one representative to the banding.
Within a bucket every member is verified against the bucket's smallest member, which joins almost all
true groups in a number of pairs that grows with the members. The members of buckets that are not yet of
one component are then compared across components, by their rarest shingles, which proposes every pair
that can reach the threshold but no pairs within what is already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, hash_spans, materialise, mix, pick, pieces, shingles, utf8, word_spans

#: 24 bands of 4: a pair at similarity 0.8 shares a bucket but for a chance of 3e-6.
BANDS, ROWS = 24, 4
_UNSET = np.iinfo(np.int64).max


def text_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of all texts: sorted hashes end to end, and their offsets."""
    data, offs = utf8(column)
    start, end, at = word_spans(data, offs)
    return shingles(hash_spans(np.take(LOWER, data), start, end), at, k)


#: Elements whose permutations are held at once.
ELEMENTS = 1 << 16


def super_minhash(elements: np.ndarray, offs: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (one row of m values per set). Each element deals its values out by its
    own random permutation of the m slots, the j-th value lying in [j, j + 1); so a set is done as soon
    as every slot holds a value below the next j. Level j is handled for all unfinished sets at once, for
    a bounded number of elements: a set's later elements start from what the earlier ones have reached."""
    best = np.full((len(offs) - 1, m), _UNSET, np.int64)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for a in range(0, len(elements), ELEMENTS):
        part = owner[a : a + ELEMENTS]
        low = int(part[0])
        _lower(best[low : int(part[-1]) + 1], elements[a : a + ELEMENTS], part - low, m)
    return best


def _lower(best: np.ndarray, live: np.ndarray, owner: np.ndarray, m: int) -> None:
    """Lower the signatures `best` by elements of the sets `owner`."""
    perm = np.zeros((0, m), np.uint8)
    for j in range(m):
        if not len(live):
            break
        h = mix(live + np.uint64((j + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        value = (np.int64(j) << np.int64(32)) | (h >> np.uint64(32)).astype(np.int64)
        swap = j + (((h & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = swap
        else:
            rows = np.arange(len(live))
            slot = perm[rows, swap].astype(np.int64)
            perm[rows, swap] = perm[rows, j]
        np.minimum.at(best.reshape(-1), owner * m + slot, value)
        done = best.max(axis=1) < (np.int64(j + 1) << np.int64(32))
        keep = ~done[owner]
        if j == 0:
            live, owner, first = live[keep], owner[keep], swap[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(live), 1))
            perm[np.arange(len(live)), first] = 0
        elif not keep.all():
            live, owner, perm = live[keep], owner[keep], perm[keep]


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of the key."""
    cut = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    h = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), 1))
    for r in range(rows):
        h = mix(h ^ (cut[:, :, r] + np.uint64(r + 1)))
    return h.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys): set size, fingerprint of the set, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, offs = text_sets(batch.column("text"), k)
            size = np.diff(offs)
            sums = [np.zeros(len(sets) + 1, np.uint64) for _ in range(2)]
            np.cumsum(mix(sets), out=sums[0][1:])
            np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1][1:])
            f1, f2 = ((s[offs[1:]] - s[offs[:-1]]).view(np.int64) for s in sums)
            keys = band_keys(super_minhash(sets, offs, bands * rows), bands, rows)
            flat = pa.array(keys.reshape(-1))
            at = pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(at, flat)], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles): each document's sorted set as little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, offs = text_sets(batch.column("text"), k)
            blobs = [sets[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "shingles"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def across_components(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (rep, at) in different components `at` that may reach the threshold: all
    that do are among them. With every set in one order, rarest shingles first, two sets that reach it
    share one of their first shingles, at places that leave enough room for the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.frombuffer(v.as_py(), np.int64) for v in batch.column("shingles")]
            size = np.array([len(x) for x in blobs])
            for a in range(0, len(blobs), 256):
                n = pa.array(np.repeat(np.arange(a, min(a + 256, len(blobs))), size[a : a + 256]))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(n), batch.column("at").take(n), pa.array(np.concatenate(blobs[a : a + 256]))], ["rep", "at", "s"])

    kept = sets.join(members, sets.doc_id == members.rep).select("rep", "at", "shingles")
    tokens = kept.mapInArrow(run, "rep long, at long, s long")
    # Written tables: joins of plain sides, in which a very common shingle's rows can be split.
    common = materialise(tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "common")
    ranked = tokens.join(common, "s", "left").groupBy("rep", "at").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("t"))
    ranked = ranked.select("rep", "at", F.size("t").alias("n"), "t")
    first = F.expr(f"slice(t, 1, n - cast(ceil(n * {percent} / 100) as int) + 1)")
    heads = ranked.select("rep", "at", "n", F.posexplode(first).alias("i", "x")).where("x.df > 1").select("rep", "at", "n", "i", F.col("x.s").alias("s"))
    heads = materialise(heads, "heads")
    per = heads.groupBy("s", "at").agg(F.count("*").alias("n"))  # counted by rows, so that no task holds all components of a shingle
    groups = per.groupBy("s").agg(F.count("*").alias("k"), F.max_by("at", F.struct("n", -F.col("at"))).alias("main")).where("k > 1").select("s", "main")
    heads = materialise(heads.join(materialise(groups, "groups"), "s"), "mixed")
    rest = heads.where("at <> main").select("s", *[F.col(c).alias(f"x_{c}") for c in ("rep", "at", "n", "i")])
    room = f"1 + least(x_n - x_i, n - i) - 1 >= (x_n + n) * {percent} / (100 + {percent}) - 0.001"
    pairs = rest.join(heads, "s").where(f"x_at <> at AND (at = main OR x_rep < rep) AND {room} AND {percent} * greatest(x_n, n) <= 100 * least(x_n, n)")
    return pairs.select(F.least("x_rep", "rep").alias("a"), F.greatest("x_rep", "rep").alias("b")).distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach.
    docs needs doc_id (unique, long) and text."""
    signed = materialise(signatures(docs, k, bands, rows), "signatures")
    print_ = ["n_shingles", "f1", "f2"]
    reps = signed.where("n_shingles > 0").groupBy(*print_).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    reps = materialise(reps, "reps")
    members = reps.select("rep", F.explode("keys").alias("key"))
    # Written first: the members of a very full bucket can be split only against a plain table.
    buckets = materialise(members.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead"), "leads")
    shared = materialise(members.join(buckets, "key"), "buckets")  # (key, rep, lead)

    stars = materialise(shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    compared = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(shingle_sets(pick(docs, "doc_id", "text").join(compared, "doc_id", "left_semi"), k), "sets")
    links = materialise(verified(stars, sets, percent), "links")
    found = materialise(components(links), "found")

    # What a bucket's smallest member did not catch: exact candidates across components.
    label = lambda c: F.coalesce(F.col(f"{c}_component"), F.col(c))
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    placed = shared.join(of("rep"), "rep", "left").select("key", "rep", label("rep").alias("at"), "lead")
    placed = placed.join(of("lead"), "lead", "left").select("key", "rep", "at", label("lead").alias("lead_at"))
    placed = materialise(placed, "placed")
    mixed = placed.where("at <> lead_at").select("key").distinct()
    open_ = materialise(placed.join(mixed, "key", "left_semi").select("rep", "at").distinct(), "open")
    across = materialise(across_components(sets, open_, percent), "across")
    more = verified(across, sets, percent)
    found = components(links.union(more))

    by = signed.where("n_shingles > 0").select("doc_id", *print_)
    whole = by.join(reps.select(*print_, "rep"), print_).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    whole = whole.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return whole.union(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The documents that are the smallest of their class, with all their columns."""
    kept = classes(docs, **how).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
