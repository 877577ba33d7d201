import collections
import hashlib
import math

import numpy as np
import pytest
from sparkloom.llm import clusters, codes, whole

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, v string, code string, cluster int, n int"


def rows(dims, n, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dims))
    out = []
    for i in range(n):
        v = (centre[i % 5] + rng.normal(scale=0.3, size=dims)) * scale
        out.append((i, v.astype(np.float32).tolist(), None if i % 9 == 7 else 0 if i % 3 else i % 4, 0, "", "", 0, 0))
    out += [(1000 + i, out[5][1], 2, 0, "", "", 0, 0) for i in range(12)]  # copies
    out += [(7, out[7][1], 1, 0, "", "", 0, 0), (7, out[8][1], 1, 0, "", "", 0, 0)]  # repeated ids
    odd = [None, [math.nan] * dims, [None] + [1.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1)]
    return out + [(-2000 - i, e, 1, 0, "", "", 0, 0) for i, e in enumerate(odd)]


def good(e):
    return e is not None and all(x is not None and math.isfinite(x) for x in e)


def ints(e, scale):
    return [max(-(2**53), min(2**53, math.floor(scale * float(np.float32(x))))) for x in e]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def best(x, book):
    return min(range(len(book)), key=lambda k: (far(x, book[k]), k))


def moved(vectors, book):
    """The floors of the means of what falls to each entry."""
    own = collections.defaultdict(list)
    for v in vectors:
        own[best(v, book)].append(v)
    return [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else book[k] for k in range(len(book))]


def brute_codes(table, parts, entries, rounds, scale):
    out, errors = [], collections.Counter()
    kept = [(r[0], r[2], ints(r[1], scale)) for r in table if good(r[1])]
    for dim in {len(v) for _, _, v in kept}:
        own = [(i, label, v + [0] * (-dim % parts)) for i, label, v in kept if len(v) == dim]
        w = -(-dim // parts)
        own.sort(key=lambda r: (r[0], np.array(r[2][:dim], "<i8").tobytes()))
        cut = lambda v, p, w=w: v[p * w : (p + 1) * w]
        books = []
        for p in range(parts):
            book = [cut(v, p) for _, _, v in own[:entries]]
            for _ in range(rounds):
                book = moved([cut(v, p) for _, _, v in own], book)
            books.append(book)
        sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, label, v in own:
            at = [best(cut(v, p), books[p]) for p in range(parts)]
            error = sum(far(cut(v, p), books[p][k]) for p, k in enumerate(at))
            errors[label] += error
            out.append((i, "".join(f"{k:02x}" for k in at), min(error, 2**63 - 1), label, sha))
    return sorted((i, code, error, min(errors[label], 2**63 - 1), sha) for i, code, error, label, sha in out)


@pytest.mark.parametrize(("dims", "how"), [(16, {}), (16, {"entries": 3, "rounds": 2}), (10, {"parts": 4})])
def test_codes_equal_brute_force(spark, dims, how, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    table = rows(dims, 130) + [(3000, [], 1, 0, "", "", 0, 0), (3001, [1.0, 2.0, 3.0], None, 0, "", "", 0, 0)]
    full = {"parts": 8, "entries": 16, "rounds": 6, "scale": 4096} | how
    got = codes.compressed(spark.createDataFrame(table, SCHEMA).repartition(5), **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_codes(table, **full)


def test_large_numbers_stay_exact(spark):
    table = rows(8, 40, scale=3e5) + [(5000 + i, [1e30 * (i + 1)] * 8, 1, 0, "", "", 0, 0) for i in range(3)]
    got = codes.compressed(spark.createDataFrame(table, SCHEMA).repartition(3), entries=4, rounds=3)
    assert sorted(map(tuple, got.collect())) == brute_codes(table, 8, 4, 3, 4096)
    for scale in (1.0, 1e5, 1e12):  # doubles, longs, whole numbers of any size
        table = rows(8, 60, scale=scale)
        got = clusters.clustered(spark.createDataFrame(table, SCHEMA).repartition(3), dim=8, centroids=3, rounds=4)
        assert sorted(map(tuple, got.collect())) == brute_clusters(table, 3, 4, 1024, 8)


def brute_clusters(table, centroids, rounds, scale, dim):
    kept = [(r[0], ints(r[1], scale)) for r in table if good(r[1]) and len(r[1]) == dim]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))
    book = [v for _, v in start[:centroids]]
    for _ in range(rounds):
        book = moved([v for _, v in kept], book)
    found = [(i, best(v, book), far(v, book[best(v, book)])) for i, v in kept]
    own = collections.Counter()
    for _, c, d in found:
        own[c] += d
    top = lambda n: min(n, 2**63 - 1)
    return sorted((i, c, top(d), top(own[c]), top(sum(own.values())), hashlib.sha256(",".join(map(str, book[c])).encode()).hexdigest()) for i, c, d in found)


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    table = rows(64, 300) + [(3000, [], 1, 0, "", "", 0, 0), (3001, [1.0] * 63, 1, 0, "", "", 0, 0)]
    got = clusters.clustered(spark.createDataFrame(table, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_clusters(table, 8, 10, 1024, 64)


def test_few_rows_and_none(spark):
    few = rows(64, 20)[:3]
    got = clusters.clustered(spark.createDataFrame(few, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute_clusters(few, 8, 10, 1024, 64)
    got = codes.compressed(spark.createDataFrame(few, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute_codes(few, 8, 16, 6, 4096)
    none = spark.createDataFrame([], SCHEMA)
    assert codes.compressed(none).collect() == [] and clusters.clustered(none).collect() == []
    nulls = spark.createDataFrame([(None, [1.0] * 64, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], SCHEMA)
    assert [(r.vec_id, r.code, r.error) for r in codes.compressed(nulls).collect()] == [(None, "00" * 8, 0)]
    assert [(r.vec_id, r.cluster, r.inertia) for r in clusters.clustered(nulls).collect()] == [(None, 0, 0)]


def test_limbs():
    for total in (0, -1, 2**32, -(2**32) - 5, 2**53, -(2**53)):
        assert whole.joined(*(int(x) for x in whole.limbs(np.array(total)))) == total
