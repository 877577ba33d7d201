import math

import numpy as np
import pytest
from sparkloom.llm import topk, vecdup

SCHEMA = "vec_id long, embedding array<float>, label int, score long, v string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 12))
    out = []
    for i in range(420):
        v = centre[i % 8] + rng.normal(scale=0.05 if i % 3 else 0.6, size=12)
        out.append((i, v.astype(np.float32).tolist(), None if i % 50 == 7 else i % 3, 0, ""))
    out += [(1000 + i, out[5][1], 2, 0, "") for i in range(40)]  # copies
    out += [(2000, None, 1, 0, ""), (2100, [], 1, 0, ""), (2200, [0.0] * 12, 1, 0, ""), (2300, [math.nan] + [1.0] * 11, 1, 0, ""), (2400, [None] + [1.0] * 11, 1, 0, ""), (2500, [math.inf] + [1.0] * 11, 1, 0, ""), (2600, [1.0, 2.0], 1, 0, ""), (2700, [3e7] * 12, 1, 0, ""), (2800, [-3e7] * 12, 1, 0, ""), (2601, [2.0, 4.0], 1, 0, "")]
    return out


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark, rows, monkeypatch):
    for name in ("BLOCK", "CHUNK", "HEAD", "QUERIES"):
        monkeypatch.setattr(topk, name, 37)
    ints = {r[0]: [math.floor(1024 * float(np.float32(x))) for x in r[1]] for r in rows if good(r[1])}
    want = []
    for q, a in ints.items():
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in ints.items() if c != q and len(b) == len(a))
            want += [(q, n + 1, c, -v) for n, (v, c) in enumerate(s[:10])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_duplicates_equal_brute_force(spark, rows):
    usable = {r[0]: (r[2], np.array(r[1], np.float64)) for r in rows if r[2] is not None and good(r[1]) and any(r[1])}
    links = {r[0]: set() for r in rows}
    for a, (la, x) in usable.items():
        for b, (lb, y) in usable.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    reach = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in reach:
                reach[j] = i
                todo += links[j]
    want = {i: (len(v), reach[i]) for i, v in links.items()}
    for tile in (1024, 16):
        got = vecdup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == want
    assert vecdup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 40)) * rng.exponential(size=(200, 1))
    q, s, l, e = vecdup.quantise(x)
    near = vecdup.int8_product(q, q) * s[:, None] * s[None, :]
    room = l[:, None] * e[None, :] + e[:, None] * l[None, :] + e[:, None] * e[None, :]
    assert (np.abs(near - x @ x.T) <= room + 1e-9).all()
