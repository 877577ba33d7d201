import math

import numpy as np
import pytest
from sparkloom.operators import neighbours as N

SCHEMA = "id long, v array<float>, label string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(30, 16))
    out = []
    for i in range(1500):
        v = centre[i % 30] + rng.normal(scale=0.4, size=16)
        out.append((i, v.astype(np.float32).tolist(), None if i % 41 == 0 else "hot" if i % 3 else f"l{i % 5}"))
    out += [(2000 + i, out[5][1], "rare") for i in range(4)]
    return out + [(3000, None, "hot"), (3001, [0.0] * 16, "hot"), (3002, [math.nan] * 16, "hot"), (3003, [1.0, 2.0], "hot"), (3004, [], "hot"), (3005, [None] * 16, "hot")]


def plain(rows, k, filtered):
    good = {}
    for i, v, label in rows:
        if v is not None and len(v) == 16 and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                good[i] = (x / np.linalg.norm(x), label)
    ids = np.array(sorted(good))
    matrix = np.array([good[i][0] for i in ids])
    out = {}
    for q in ids:
        if q % 25 == 0:
            x, label = good[q]
            score = np.round(matrix @ x, 9)
            found = [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q and (not filtered or (label is not None and good[i][1] == label))]
            out[int(q)] = [(i, n) for n, (_, i) in enumerate(sorted(found)[:k], 1)]
    return {q: v for q, v in out.items() if v}


def grouped(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.position)):
        out.setdefault(r.query_id, []).append((r.item, r.position))
    return out


def test_search(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = N.built(df)
    assert 1 < len(index.centres) <= 40 and 1 <= index.probes < len(index.centres)
    asked = df.where("id % 25 = 0")
    for filtered in (False, True):
        true = N.exact(index, asked, 10, filtered)
        assert grouped(true) == plain(rows, 10, filtered)
        found = N.search(index, asked, 10, filtered)
        assert N.recall(found, true) >= 0.9
    # a rare value: the probed cells alone do not hold ten
    few = spark.createDataFrame([(9000, rows[700][1], "rare")], SCHEMA)
    assert {r.item for r in N.search(index, few, 10, True).collect()} == {2000, 2001, 2002, 2003}
    late = N.searched_then_filtered(index, asked, df)
    label = {i: x for i, _, x in rows}
    kept = [tuple(r) for r in late.collect()]
    whole = {(r.query_id, r.item) for r in N.search(index, asked, 10).collect()}
    assert {(q, i) for q, i, *_ in kept} == {(q, i) for q, i in whole if label[q] is not None and label[q] == label[i]}


def test_few_rows_and_none(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    index = N.built(none)
    assert N.search(index, none).collect() == []
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert N.search(N.built(one), one).collect() == []
    three = spark.createDataFrame(rows[1:4], SCHEMA)
    assert N.search(N.built(three), three, 10).count() == 6
