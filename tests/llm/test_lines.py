import collections
import hashlib
import random

import numpy as np
import pytest
from sparkloom.llm import linededup
from sparkloom.llm.linededup import Cuckoo, Index

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    k = line.strip(WHITE).translate(LOWER)
    return k if len(k) >= 10 else None


def brute(texts):
    held = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if i is None or key(x) is None or len(held[key(x)] - {None}) < 2 or min(held[key(x)] - {None}) == i]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    common = [f"All rights reserved by the owner {i}" for i in range(6)] + ["tiny", "  ninechars", "TENLETTERS", "étéétéétéé", "漢字漢字漢字漢字漢字"]
    out = []
    for i in range(120):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {i} {j} {rng.random()}" for j in range(rng.randrange(0, 12))]
        lines += lines[:2]  # repeated within the document
        out.append((i, "\n".join(rng.choice(("", " ", "\t\r")) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(("", "\v ", "\r")) for x in lines)))
    out += [(500 + i, out[3][1]) for i in range(30)] + [(600, None), (601, ""), (602, "\n"), (603, "\n\n all rights reserved by the owner 1\n"), (604, "x" * 200_000 + "\n" + "y" * 10), (605, "y" * 10)]
    return out


SCHEMA = "doc_id long, text string, g1 string, h1 long, first long, n_chars int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "g", 1, 2, 3) for i, t in rows], SCHEMA).repartition(4)


def test_equal_brute_force(spark, pages, monkeypatch):
    monkeypatch.setattr(linededup, "SENT", 40)
    assert found(linededup.deduplicated(table(spark, pages))) == brute(pages)


def test_insertions_and_removals(spark, pages, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD", 60)  # the layout grows on the way
    monkeypatch.setattr(linededup, "SHARDS", 2)
    whole, parts = table(spark, pages), [pages[i::3] for i in range(3)]
    index, states = Index.empty(spark), []
    for part in parts:
        index = index.inserted(table(spark, part))
        states.append(index)
    assert states[-1].shards > states[0].shards
    assert found(linededup.decisions(whole, index)) == brute(pages)
    again = index.inserted(table(spark, parts[1]))  # changes nothing
    assert found(linededup.decisions(whole, again)) == brute(pages)
    gone = [i for i, _ in pages if i % 2 == 0] + [77_777]
    less = index.removed(spark.createDataFrame([(i,) for i in gone] + [(None,)], "doc_id long"))
    left = [(i, t) for i, t in pages if i not in gone]
    assert found(linededup.decisions(table(spark, left), less)) == brute(left)
    back = less.inserted(table(spark, [r for r in pages if r[0] in gone]))
    assert found(linededup.decisions(whole, back)) == brute(pages)
    first = [r for r in parts[0]]
    assert found(linededup.decisions(table(spark, first), states[0])) == brute(first)  # earlier versions stay readable


def test_filters_hold_the_living_keys(spark, pages):
    index = Index.empty(spark).inserted(table(spark, pages))
    ids = [i for i, _ in pages if i % 3]
    for state in (index, index.removed(spark.createDataFrame([(i,) for i in ids], "doc_id long"))):
        alive = np.array([r.h1 for r in state.held.select("h1").distinct().collect()], np.int64).view(np.uint64)
        cells = 0
        for r in state.filters.collect():
            own = Cuckoo(state.bits, bytes(r.cells))
            mine = alive[(alive >> np.uint64(48)).astype(np.int64) % state.shards == r.shard]
            assert own.has(own.cells(mine)).all()
            cells += (own.table > 0).sum() + len(own.spill)
            assert (own.table > 0).sum() + len(own.spill) == len(np.unique(own.cells(mine)))
        assert cells
    assert index.removed(table(spark, pages)).held.count() == 0
    assert all(not np.frombuffer(bytes(r.cells), np.uint8).any() for r in index.removed(table(spark, pages)).filters.collect())


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    for bits, n in ((4, 51), (4, 200), (10, 3200)):  # the second is far too full: the rest is spilled
        own = Cuckoo(bits)
        hashes = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        maybe = own.offer(hashes)
        assert own.has(own.cells(hashes)).all() and len(maybe) <= n // 20
        assert set(own.offer(hashes).tolist()) == set(hashes.tolist())
        same = Cuckoo(bits, own.raw())
        assert (same.table == own.table).all() and same.spill == own.spill
        half = np.unique(own.cells(hashes[: n // 2]))
        gone = np.setdiff1d(half, own.cells(hashes[n // 2 :]))
        own.remove(gone)
        assert own.has(own.cells(hashes[n // 2 :])).all()
        own.remove(np.unique(own.cells(hashes[n // 2 :])))
        assert not own.table.any() and not own.spill
    twice = np.concatenate([hashes[:5], hashes[:3]])
    assert set(Cuckoo(8).offer(twice).tolist()) == set(hashes[:3].tolist())


def test_odd_rows(spark):
    odd = [(None, "a line of ten letters"), (None, None), (4, "a line of ten letters\nA LINE of ten letters "), (2, "a line of ten letters"), (2, "a line of ten letters"), (9, None), (9, "short\nshort")]
    assert found(linededup.deduplicated(table(spark, odd))) == brute(odd)
    alone = [(2, "a line of ten letters"), (2, "a line of ten letters")]
    assert found(linededup.deduplicated(table(spark, alone))) == brute(alone)
    none = table(spark, [])
    assert found(linededup.deduplicated(none)) == []
    empty = Index.empty(spark)
    assert empty.removed(none).inserted(none).held.count() == 0
    assert found(linededup.decisions(table(spark, alone), empty.inserted(none))) == brute(alone)


def test_stripped_texts(spark, pages):
    docs = table(spark, pages)
    left = linededup.stripped(docs, Index.empty(spark).inserted(docs))
    assert left.schema.names == docs.schema.names
    want = {i: (d, sha) for i, _, d, sha in brute(pages)}
    for r in left.collect():
        dropped, sha = want[r.doc_id]
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == sha
        assert r.g1 == "g" and r.n_chars == (len(r.text) if dropped else 3)
