import re

import numpy as np
from sparkloom.llm import minhash
from sparkloom.llm.common import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(texts, k):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").encode().translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_classes_equal_brute_force(docs, texts):
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(docs, k=k).collect()}
        assert got == brute(texts, k)


def test_residual_pairs_found_without_bands(docs, texts, monkeypatch):
    """With one band of one row buckets are wide and mostly wrong: the exact comparison must still be right
    for every pair that shares a bucket with a document of another component."""
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(docs, k=4, bands=16, rows=1).collect()}
    assert got == brute(texts, 4)


def test_keep_first_keeps_columns(docs, texts):
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(texts, 5).items() if c == i}


def test_empty_table(no_docs):
    assert minhash.classes(no_docs).collect() == []
    assert minhash.keep_first(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.unique(pool[:300]), np.unique(pool[100:])
    m = 256
    s = minhash.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), m)
    assert (s < np.iinfo(np.int64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1
    few = minhash.super_minhash(pool[:3], np.array([0, 3]), 96)
    assert (few < np.iinfo(np.int64).max).all()  # every slot is filled, whatever the size


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 20), (21, 20), (30, 31)] + [(100, 100 + i) for i in range(1, 300)] + [(i, i + 1) for i in range(500, 560)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {2: 1, 3: 1, 20: 1, 21: 1, 11: 10, 12: 10, 31: 30} | {100 + i: 100 for i in range(1, 300)} | {i: 500 for i in range(501, 561)}
    assert {k: v for k, v in got.items() if k != v} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
